"""Scalar functions and row rewrites: SC*, PF*, RW*, WN6, WN7, WN11."""

from __future__ import annotations

from pyspark.sql import functions as F

from longweave.functions import sequence as S
from longweave.operators import masking, ordered, rewrite
from longweave.plans import views as V
from longweave.plans.catalog import query

REV = "translate(reverse({0}), 'ACGT', 'TGCA')"
_KMERS = f"SELECT read_id, least(m, {REV.format('m')}) AS kmer FROM (SELECT read_id, unnest(list_transform(range(1, length(seq) - 10), lambda i: substr(seq, i, 12))) AS m FROM ({V.READS_SQL}))"
_COUNT = f"SELECT kmer, count(*) AS n FROM ({_KMERS}) GROUP BY kmer"
_THR = "SELECT CASE WHEN idx < few OR n_all = few THEN 0 ELSE list_sort(vals)[CAST(idx - few AS INTEGER) + 1] END AS thr FROM (SELECT CAST(floor(count(*) * (1 - 0.001::DOUBLE)) AS BIGINT) AS idx, count(*) AS n_all, count(*) FILTER (n <= 10) AS few, list(n) FILTER (n > 10) AS vals FROM c WHERE n > 1)"


@query("sc3_repetitiveness", f"""WITH k AS MATERIALIZED ({_KMERS}), c AS MATERIALIZED (SELECT kmer, count(*) AS n FROM k GROUP BY kmer), t AS ({_THR}),
m AS (SELECT kmer FROM c, t WHERE n > greatest(1, thr)), h AS (SELECT read_id, kmer, count(*) AS n FROM k SEMI JOIN m USING (kmer) GROUP BY ALL HAVING count(*) > 1),
s AS (SELECT read_id, sum(n) AS n FROM h GROUP BY read_id)
SELECT read_id, round(coalesce(n, 0) / (greatest(length(seq) - 12, 0) + 1), 6) AS repetitiveness FROM ({V.READS_SQL}) LEFT JOIN s USING (read_id)""")  # fmt: skip
def _(spark, sf):
    reads = V.reads(spark, sf)
    out = masking.repetitiveness(reads, masking.mask(reads, 12), 12)
    return out.select("read_id", F.round("repetitiveness", 6).alias("repetitiveness"))


@query("sc5_mask_threshold", f"WITH c AS MATERIALIZED ({_COUNT}), t AS ({_THR}) SELECT CAST(thr AS BIGINT) AS thr, (SELECT count(*) FROM c WHERE n > greatest(1, thr)) AS masked FROM t")
def _(spark, sf):
    counts = masking.kmer_counts(V.reads(spark, sf), 12).cache()
    thr = masking.mask_threshold(counts, 0.001, 10)
    return counts.where(F.col("n") > max(1, thr)).agg(F.lit(thr).cast("long").alias("thr"), F.count("*").alias("masked"))


@query("ag1_kmer_spectrum", f"SELECT n AS times, count(*) AS kmers FROM ({_COUNT}) GROUP BY n")
def _(spark, sf):
    return masking.kmer_counts(V.reads(spark, sf), 12).groupBy(F.col("n").alias("times")).agg(F.count("*").alias("kmers"))


@query("sc1_canonical_kmers", f"SELECT kmer, count(*) AS n FROM (SELECT least(m, {REV.format('m')}) AS kmer FROM (SELECT unnest(list_transform(range(1, length(seq) - 2), lambda i: substr(seq, i, 4))) AS m FROM ({V.READS_SQL}))) GROUP BY kmer")
def _(spark, sf):
    return masking.kmer_rows(V.reads(spark, sf), 4).groupBy(S.canonical(F.col("kmer")).alias("kmer")).agg(F.count("*").alias("n"))


@query("sc2_reverse_complement", f"SELECT read_id, md5({REV.format('seq')}) AS rev FROM ({V.READS_SQL})")
def _(spark, sf):
    return V.reads(spark, sf).select("read_id", F.md5(S.reverse_complement(F.col("seq"))).alias("rev"))


@query("sc4_soft_mask", f"""WITH k AS MATERIALIZED (SELECT read_id, i, least(m, {REV.format('m')}) AS kmer FROM (SELECT read_id, unnest(range(1, length(seq) - 10)) AS i, unnest(list_transform(range(1, length(seq) - 10), lambda i: substr(seq, i, 12))) AS m FROM ({V.READS_SQL}))),
c AS MATERIALIZED (SELECT kmer, count(*) AS n FROM k GROUP BY kmer), t AS ({_THR}), m AS (SELECT kmer FROM c, t WHERE n > greatest(1, thr)),
p AS (SELECT DISTINCT read_id, unnest(range(i, i + 12)) AS at FROM k SEMI JOIN m USING (kmer)), s AS (SELECT read_id, count(*) AS n FROM p GROUP BY read_id)
SELECT read_id, CAST(coalesce(n, 0) AS BIGINT) AS masked FROM ({V.READS_SQL}) LEFT JOIN s USING (read_id)""")  # fmt: skip
def _(spark, sf):
    reads = V.reads(spark, sf)
    out = masking.soft_masked(reads, masking.mask(reads, 12), 12)
    return out.select("read_id", F.length(F.regexp_replace("seq", "[^a-z]", "")).cast("long").alias("masked"))


@query("sc6_recovered_mask", f"WITH c AS MATERIALIZED ({_COUNT}), t AS ({_THR}) SELECT (SELECT count(*) FROM c WHERE n > greatest(1, thr)) AS masked, CAST(0 AS BIGINT) AS lost FROM t")
def _(spark, sf):
    """Every masked k-mer is found again in the soft-masked reads."""
    reads = V.reads(spark, sf)
    mask = masking.mask(reads, 12).select("kmer").cache()
    back = masking.recovered_mask(masking.soft_masked(reads, mask, 12), 12)
    lost = mask.join(back, "kmer", "left_anti").agg(F.count("*").alias("lost"))
    return mask.agg(F.count("*").alias("masked")).crossJoin(F.broadcast(lost))  # one row each


@query("sc7_kmer_entropy", f"""WITH k AS (SELECT read_id, kmer, count(*) AS n FROM (SELECT read_id, unnest(list_transform(range(1, length(seq) + 1 - 2), lambda i: substr(seq, i, 3))) AS kmer FROM ({V.READS_SQL})) GROUP BY ALL),
f AS (SELECT read_id, n / sum(n) OVER (PARTITION BY read_id) AS f FROM k), e AS (SELECT read_id, -sum(f * ln(f)) AS e FROM f GROUP BY read_id)
SELECT read_id, round(coalesce(e, 0), 6) + 0 AS entropy FROM ({V.READS_SQL}) LEFT JOIN e USING (read_id)""")  # fmt: skip
def _(spark, sf):
    return masking.kmer_entropies(V.reads(spark, sf), 3).select("read_id", (F.round("entropy", 6) + 0).alias("entropy"))


@query("sc8_cigar_ops", f"SELECT op, count(*) AS n, CAST(sum(len) AS BIGINT) AS bases FROM (SELECT unnest(regexp_extract_all(cigar, '[0-9]+([MDI])', 1)) AS op, CAST(unnest(regexp_extract_all(cigar, '([0-9]+)[MDI]', 1)) AS BIGINT) AS len FROM ({V.CIGARS_SQL})) GROUP BY op")
def _(spark, sf):
    return V.cigars(spark, sf).select(F.explode(S.cigar_ops(F.col("cigar"))).alias("x")).groupBy("x.op").agg(F.count("*").alias("n"), F.sum("x.len").alias("bases"))


_OPS = f"SELECT *, regexp_extract_all(cigar, '[0-9]+([MDI])', 1) AS op, list_transform(regexp_extract_all(cigar, '([0-9]+)[MDI]', 1), lambda x: CAST(x AS BIGINT)) AS n FROM ({V.CIGARS_SQL})"


@query("sc9_cigar_lengths", f"SELECT node_id, CAST(list_sum(list_filter(n, lambda x, i: op[i] <> 'D')) AS BIGINT) AS query_len, CAST(list_sum(list_filter(n, lambda x, i: op[i] <> 'I')) AS BIGINT) AS ref_len FROM ({_OPS})")
def _(spark, sf):
    ops = S.cigar_ops(F.col("cigar"))
    return V.cigars(spark, sf).select("node_id", S.query_length(ops).cast("long").alias("query_len"), S.reference_length(ops).cast("long").alias("ref_len"))


_INDEL = f"""SELECT node_id, chunk, cluster, greatest(max(s), 0) AS indel FROM (SELECT node_id, chunk, cluster, list_sum(v[i:j]) AS s FROM (SELECT node_id, chunk, cluster, list_transform(n, lambda x, i: CASE WHEN op[i] = 'M' THEN -x ELSE 3 * x END) AS v, unnest(range(1, len(n) + 1)) AS i FROM ({_OPS})), range(1, 8) r(j) WHERE j >= i AND j <= len(v)) GROUP BY ALL"""


@query("sc10_max_indel", f"SELECT node_id, CAST(indel AS BIGINT) AS indel FROM ({_INDEL})")
def _(spark, sf):
    return V.cigars(spark, sf).select("node_id", S.max_indel(S.cigar_ops(F.col("cigar")), 1, 3).alias("indel"))


@query("wn11_max_interval", f"""WITH v AS (SELECT read_id, list(gap ORDER BY idx) AS g FROM ({V.NODES_SQL}) GROUP BY read_id), c AS (SELECT read_id, g, unnest(range(1, len(g) + 1)) AS i FROM v)
SELECT read_id, CAST(max(list_sum(g[i:j])) AS BIGINT) AS best FROM c, range(1, 201) r(j) WHERE j >= i AND j <= len(g) GROUP BY read_id""")  # fmt: skip
def _(spark, sf):
    """Strongest stretch of gaps along each read."""
    g = V.nodes(spark, sf).groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("idx", "gap"))).alias("g"))
    return g.select("read_id", S.kadane(F.transform("g", lambda x: x["gap"])).alias("best"))


@query("sc11_alignment_columns", f"SELECT node_id, CAST(list_sum(n) AS BIGINT) AS columns, round(list_sum(list_filter(n, lambda x, i: op[i] = 'M')) / list_sum(n), 6) AS identity FROM ({_OPS})")
def _(spark, sf):
    ops = S.cigar_ops(F.col("cigar"))
    mat = F.aggregate(ops, F.lit(0), lambda a, x: a + F.when(x["op"] == "M", x["len"]).otherwise(0))
    return V.cigars(spark, sf).select("node_id", F.aggregate(ops, F.lit(0), lambda a, x: a + x["len"]).cast("long").alias("columns"), F.round(S.identity(ops, mat), 6).alias("identity"))


@query("sc12_cigar_round_trip", f"SELECT node_id, cigar FROM ({V.CIGARS_SQL})")
def _(spark, sf):
    return V.cigars(spark, sf).select("node_id", S.cigar_text(S.cigar_ops(F.col("cigar"))).alias("cigar"))


@query("sc13_parse_si", "SELECT * FROM (VALUES ('10', 10::BIGINT), ('1k', 1000::BIGINT), ('2.5M', 2500000::BIGINT), ('3G', 3000000000::BIGINT)) t(text, value)")
def _(spark, sf):
    return spark.createDataFrame([(t, S.parse_si(t)) for t in ("10", "1k", "2.5M", "3G")], "text string, value long")


@query("sc14_logsumexp", f"SELECT vec_id, round(list_max(xs) + ln(list_sum(list_transform(xs, lambda x: exp(x - list_max(xs))))), 6) AS total FROM ({V.PROFILE_SQL})")
def _(spark, sf):
    return V.profile(spark, sf).select("vec_id", F.round(S.logsumexp(F.col("xs")), 6).alias("total"))


@query("sc15_is_biased", f"WITH p AS (SELECT vec_id, xs[1:4] AS xs FROM ({V.PROFILE_SQL})), q AS (SELECT vec_id, list_transform(xs, lambda x: exp(4 * x)) AS e FROM p) SELECT vec_id, list_max(e) / list_sum(e) >= 0.25 + 0.2 AS biased FROM q")
def _(spark, sf):
    xs = F.transform(F.slice("xs", 1, 4), lambda x: x * 4)
    return V.profile(spark, sf).select("vec_id", S.posterior(xs).alias("p")).select("vec_id", S.is_biased(F.col("p")).alias("biased"))


@query("sc16_posterior", f"SELECT vec_id, round(xs[1] - (list_max(xs) + ln(list_sum(list_transform(xs, lambda x: exp(x - list_max(xs)))))), 6) AS first FROM ({V.PROFILE_SQL})")
def _(spark, sf):
    return V.profile(spark, sf).select("vec_id", F.round(S.posterior(F.col("xs"))[0], 6).alias("first"))


@query("sc17_poisson", f"WITH c AS (SELECT chunk, count(*) AS n FROM ({V.NODES_SQL}) GROUP BY chunk) SELECT chunk, round(greatest(n * ln(5.0) - 5.0, n * ln(10.0) - 10.0, n * ln(15.0) - 15.0) - lgamma(n + 1), 5) AS lk FROM c")
def _(spark, sf):
    n = V.nodes(spark, sf).groupBy("chunk").agg(F.count("*").alias("n"))
    return n.select("chunk", F.round(S.max_poisson_log(F.col("n"), F.lit(5.0), 3), 5).alias("lk"))


@query("sc18_binomial_tail", "SELECT n, k, round(list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.1) + (n - i) * ln(0.9)))), 6) AS p FROM (SELECT CAST(unnest([5, 20, 40]) AS INTEGER) AS n), (SELECT CAST(unnest(range(0, 6)) AS INTEGER) AS k)")
def _(spark, sf):
    from longweave.operators.cluster import binomial_tail

    rows = [(n, k, float(round(binomial_tail(n, 0.1)[k], 6))) for n in (5, 20, 40) for k in range(6)]
    return spark.createDataFrame(rows, "n int, k int, p double")


_LENS = "SELECT read_id, max(pos + len) AS len FROM ({0}) GROUP BY read_id".format(V.NODES_SQL)
_EDGES = """SELECT read_id, idx, chunk AS from_chunk, cluster AS from_cluster, is_forward AS from_forward, to_chunk, to_cluster, to_forward, to_pos - pos - len AS "offset" FROM (SELECT *, lead(chunk) OVER w AS to_chunk, lead(cluster) OVER w AS to_cluster, lead(is_forward) OVER w AS to_forward, lead(pos) OVER w AS to_pos FROM ({0}) WINDOW w AS (PARTITION BY read_id ORDER BY idx)) WHERE to_chunk IS NOT NULL""".format(V.NODES_SQL)
_COV = f"""SELECT u, v, n, offsets FROM (SELECT least(from_chunk, to_chunk) AS u, greatest(from_chunk, to_chunk) AS v, count(*) AS n, CAST(sum("offset") AS BIGINT) AS offsets FROM ({_EDGES}) GROUP BY ALL)"""
_CALIB = f"""SELECT u, v, CASE WHEN factor > 0 THEN n * mean / factor ELSE 0 END AS calibrated FROM (SELECT u, v, n, greatest(CAST(trunc(offsets / n) AS BIGINT), 0) AS gap FROM ({_COV})) e,
LATERAL (SELECT sum(greatest(len - e.gap, 0)) / count(*) AS factor, avg(len) AS mean FROM ({_LENS}))"""


def lengths(spark, sf):
    return V.nodes(spark, sf).groupBy("read_id").agg(F.max(F.col("pos") + F.col("len")).alias("len"))


@query("ag37_sc19_calibrated_edges", f"SELECT u, v, round(calibrated, 4) AS calibrated FROM ({_CALIB})")
def _(spark, sf):
    out = rewrite.calibrated_edges(V.nodes(spark, sf), lengths(spark, sf))
    return out.select("u", "v", F.round("calibrated", 4).alias("calibrated"))


@query("sc20_column_cosine", f"""WITH c AS MATERIALIZED (SELECT * FROM ({V.CELLS_SQL}) WHERE abs(x) > 0.00001) SELECT a.col AS i, b.col AS j, round(sum(a.x * b.x) / sqrt(sum(a.x * a.x)) / sqrt(sum(b.x * b.x)), 6) AS cosine FROM c a JOIN c b USING (vec_id) WHERE a.col < b.col GROUP BY ALL""")
def _(spark, sf):
    x = V.profile(spark, sf).select("xs")
    from longweave.operators.cluster import column_similarities

    return column_similarities(x, 64).select("i", "j", F.round("cosine", 6).alias("cosine"))


@query("sc21_sokal_michener", f"""WITH c AS MATERIALIZED (SELECT * FROM ({V.CELLS_SQL}) WHERE abs(x) > 0.00001) SELECT a.col AS i, b.col AS j, round(greatest(count(*) FILTER (a.x * b.x > 0), count(*) FILTER (a.x * b.x <= 0)) / count(*), 6) AS similarity FROM c a JOIN c b USING (vec_id) WHERE a.col < b.col GROUP BY ALL""")
def _(spark, sf):
    from longweave.operators.cluster import column_similarities

    return column_similarities(V.profile(spark, sf).select("xs"), 64).select("i", "j", F.round("sokal_michener", 6).alias("similarity"))


@query("sc22_strand_bias", f"""WITH c AS (SELECT col, vec_id % 2 AS strand, x > 0 AS sign FROM ({V.CELLS_SQL}) WHERE abs(x) > 0.0001), t AS (SELECT col, count(*) AS n, count(*) FILTER (strand = 1) AS s1, count(*) FILTER (sign) AS p, count(*) FILTER (strand = 1 AND sign) AS o11, count(*) FILTER (strand = 1 AND NOT sign) AS o10, count(*) FILTER (strand = 0 AND sign) AS o01, count(*) FILTER (strand = 0 AND NOT sign) AS o00 FROM c GROUP BY col)
SELECT col, round(power(o11 - s1 * p / n, 2) / (s1 * p / n) + power(o10 - s1 * (n - p) / n, 2) / (s1 * (n - p) / n) + power(o01 - (n - s1) * p / n, 2) / ((n - s1) * p / n) + power(o00 - (n - s1) * (n - p) / n, 2) / ((n - s1) * (n - p) / n), 5) AS chi2 FROM t""")  # fmt: skip
def _(spark, sf):
    from longweave.operators.cluster import strand_bias

    cells = V.cells(spark, sf).select("col", (F.col("vec_id") % 2 == 1).alias("forward"), "x")
    return strand_bias(cells).select(F.col("col").cast("long").alias("col"), F.round("chi2", 5).alias("chi2"))


@query("sc23_logit", f"SELECT vec_id, round(CASE WHEN p < -80 THEN -80 WHEN p > -1.8e-35 THEN 80 ELSE p - ln(1 - exp(p)) END, 5) AS logit FROM (SELECT vec_id, -abs(xs[1]) * 100 AS p FROM ({V.PROFILE_SQL}))")
def _(spark, sf):
    return V.profile(spark, sf).select("vec_id", F.round(S.logit(-F.abs(F.col("xs")[0]) * 100), 5).alias("logit"))


@query("sc24_posterior_similarity", f"""WITH p AS (SELECT vec_id, list_transform([xs[1], xs[2]], lambda x: x - ln(exp(xs[1]) + exp(xs[2]))) AS a, list_transform([xs[3], xs[4]], lambda x: x - ln(exp(xs[3]) + exp(xs[4]))) AS b FROM ({V.PROFILE_SQL})), l AS (SELECT vec_id, ln(exp(a[1] + b[1]) / 1 + exp(a[2] + b[2]) / 2) AS l FROM p) SELECT vec_id, round(l - ln(1 - exp(l)), 5) AS similarity FROM l""")
def _(spark, sf):
    a, b = S.posterior(F.slice("xs", 1, 2)), S.posterior(F.slice("xs", 3, 2))
    return V.profile(spark, sf).select("vec_id", F.round(S.posterior_similarity(a, b, F.array(F.lit(1), F.lit(2))), 5).alias("similarity"))


@query("sc25_gfa_tags", f"SELECT chunk, 'cv:i:' || n || chr(9) || 'cp:i:' || CAST(round(n / 5.0) AS BIGINT) || chr(9) || 'ln:i:' || (chunk + 100) AS tags FROM (SELECT chunk, count(*) AS n FROM ({V.NODES_SQL}) GROUP BY chunk)")
def _(spark, sf):
    n = V.nodes(spark, sf).groupBy("chunk").agg(F.count("*").alias("n"))
    return n.select("chunk", S.gfa_tags(F.col("n"), F.col("n") / 5.0, F.col("chunk") + 100).alias("tags"))


@query("sc26_read_types", "SELECT * FROM (VALUES ('CCS', 0.05::DOUBLE, 20), ('CLR', 0.2::DOUBLE, 100), ('ONT', 0.15::DOUBLE, 60), ('None', 0.2::DOUBLE, 100)) t(name, sim_thr, band)")
def _(spark, sf):
    from longweave.schema import READ_TYPES

    return spark.createDataFrame([(k, t.sim_thr, t.band_width(2000)) for k, t in READ_TYPES.items()], "name string, sim_thr double, band int")


@query("wn6_homopolymer_runs", f"SELECT read_id, CAST(max(length(r)) AS INTEGER) AS longest, count(*) AS runs FROM (SELECT read_id, unnest(regexp_extract_all(seq, 'A+|C+|G+|T+')) AS r FROM ({V.READS_SQL})) GROUP BY read_id")
def _(spark, sf):
    n = S.homopolymer_lengths(F.col("seq"))
    own = V.reads(spark, sf).where("length(seq) > 0").select("read_id", n.alias("n"))
    runs = F.round(F.aggregate("n", F.lit(0.0), lambda a, x: a + 1.0 / x)).cast("long")
    return own.select("read_id", F.array_max("n").alias("longest"), runs.alias("runs"))


@query("io4_wn7_entry", f"SELECT read_id, length(s) AS len, md5(s) AS digest FROM (SELECT read_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(seq), '(AAA)A+', '\\1', 'g'), '(CCC)C+', '\\1', 'g'), '(GGG)G+', '\\1', 'g'), '(TTT)T+', '\\1', 'g') AS s FROM ({V.READS_SQL}))")
def _(spark, sf):
    from longweave.sources.sequences import entered

    return entered(V.reads(spark, sf), 3).select("read_id", F.length("seq").cast("long").alias("len"), F.md5("seq").alias("digest"))


@query("pf1_fixed_split", f"SELECT read_id, 500 + 2000 * unnest(range(CAST(greatest(floor((length(seq) - 1000) / 2000.0), 0) AS BIGINT))) AS start FROM ({V.READS_SQL})")
def _(spark, sf):
    out = ordered.fixed_windows(V.reads(spark, sf).select("read_id", "seq"), F.length("seq"), 2000, 500)
    return out.select("read_id", F.col("start").cast("long").alias("start"))


_PAF = "SELECT l_orderkey % 97 AS q, l_partkey % 89 AS t, 1000 AS len, l_suppkey * 7 % 400 AS qs, 600 + l_suppkey * 11 % 401 AS qe, l_linenumber * 5 AS ts, 950 + l_linenumber * 7 AS te, CAST(l_quantity AS BIGINT) AS bad, l_returnflag = 'N' AS same FROM lineitem"


def _paf(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return li.selectExpr("l_orderkey % 97 AS q", "l_partkey % 89 AS t", "1000 AS len", "l_suppkey * 7 % 400 AS qs", "600 + l_suppkey * 11 % 401 AS qe", "l_linenumber * 5 AS ts", "950 + l_linenumber * 7 AS te", "CAST(l_quantity AS BIGINT) AS bad", "l_returnflag = 'N' AS same")


@query("pf2_full_span", f"SELECT q, count(*) AS n FROM ({_PAF}) WHERE ts < 25 AND len - te < 25 GROUP BY q")
def _(spark, sf):
    return _paf(spark, sf).where(rewrite.full_span(F.col("ts"), F.col("te"), F.col("len"))).groupBy("q").agg(F.count("*").alias("n"))


@query("pf3_identity_filter", f"SELECT count(*) AS n FROM ({_OPS}) WHERE list_sum(list_filter(n, lambda x, i: op[i] = 'M')) / list_sum(n) > 1 - 0.15")
def _(spark, sf):
    ops = S.cigar_ops(F.col("cigar"))
    mat = F.aggregate(ops, F.lit(0), lambda a, x: a + F.when(x["op"] == "M", x["len"]).otherwise(0))
    return V.cigars(spark, sf).where(S.identity(ops, mat) > 1 - 0.15).agg(F.count("*").alias("n"))


_PROPER = "CASE WHEN same THEN (len - qe < 25 AND ts < 25) OR (qs < 25 AND len - te < 25) ELSE (len - qe < 25 AND len - te < 25) OR (qs < 25 AND ts < 25) END"


@query("pf4_proper_overlap", f"SELECT q, t, count(*) AS n FROM ({_PAF}) WHERE {_PROPER} GROUP BY q, t")
def _(spark, sf):
    ok = rewrite.proper_overlap(F.col("qs"), F.col("qe"), F.col("len"), F.col("ts"), F.col("te"), F.col("len"), F.col("same"))
    return _paf(spark, sf).where(ok).groupBy("q", "t").agg(F.count("*").alias("n"))


@query("pf14_overlapping_chunks", f"SELECT DISTINCT least(q, t) AS a, greatest(q, t) AS b FROM ({_PAF}) WHERE {_PROPER} AND (qe - qs - bad) / (qe - qs) > 0.95 AND qe - qs > 500 AND q <> t")
def _(spark, sf):
    p = _paf(spark, sf).select(F.col("q").alias("qname"), F.col("t").alias("tname"), F.col("len").alias("qlen"), F.col("qs").alias("qstart"), F.col("qe").alias("qend"), F.col("len").alias("tlen"), F.col("ts").alias("tstart"), F.col("te").alias("tend"), F.when(F.col("same"), "+").otherwise("-").alias("strand"), (F.col("qe") - F.col("qs") - F.col("bad")).alias("matches"), (F.col("qe") - F.col("qs")).alias("block"))
    return rewrite.overlapping_chunks(p, 1000, 0.95)


@query("pf5_frequent_chunks", f"SELECT chunk, count(*) AS n FROM ({V.NODES_SQL}) GROUP BY chunk HAVING count(*) > 10 * (7 + 3)")
def _(spark, sf):
    return rewrite.frequent_chunks(V.nodes(spark, sf), 9.5, 7)


_CHUNKS = f"SELECT chunk, least(greatest(CAST(floor(count(*) / 25) AS INTEGER), 0), 8) AS copy_num, CAST(count(DISTINCT cluster) AS INTEGER) AS cluster_num FROM ({V.NODES_SQL}) GROUP BY chunk"


def chunks(spark, sf):
    return V.nodes(spark, sf).groupBy("chunk").agg(F.least(F.floor(F.count("*") / 25).cast("int"), F.lit(8)).alias("copy_num"), F.countDistinct("cluster").cast("int").alias("cluster_num"))


@query("pf6_purge_multiplicity", f"SELECT read_id, count(*) AS n FROM ({V.NODES_SQL}) JOIN ({_CHUNKS}) USING (chunk) WHERE copy_num < 5 AND copy_num <> 0 GROUP BY read_id")
def _(spark, sf):
    return rewrite.purge_multiplicity(V.nodes(spark, sf), chunks(spark, sf), 5).groupBy("read_id").agg(F.count("*").alias("n"))


@query("pf7_purge_large_indels", f"""WITH n AS (SELECT node_id, chunk, cluster, CAST(indel AS BIGINT) AS indel FROM ({_INDEL})), g AS (SELECT chunk, cluster, count(*) AS n, count(*) FILTER (indel > 26) AS large, count(*) FILTER (indel > 13) AS over FROM n GROUP BY ALL)
SELECT node_id FROM n JOIN g USING (chunk, cluster) JOIN ({_CHUNKS}) USING (chunk) WHERE indel > 13 AND CASE WHEN copy_num <= 1 THEN large >= 1 AND large < ceil(n * (1 - 0.2 / 2)) ELSE large > floor(5.0 * 0.2) AND over < ceil(greatest(n - floor(5.0 * 0.2), 0)) END""")  # fmt: skip
def _(spark, sf):
    n = V.cigars(spark, sf).withColumn("indel", S.max_indel(S.cigar_ops(F.col("cigar")), 1, 3))
    return rewrite.purge_large_indels(n, chunks(spark, sf), 5.0, 26, 0.2).select("node_id")


_EFFECT = f"SELECT chunk, cluster, avg(gap) / 100 AS effect FROM ({V.NODES_SQL}) GROUP BY ALL"


@query("pf8_purge_diverged", f"""WITH e AS (SELECT *, effect > 0.1 AS bad, bool_and(effect > 0.1) OVER (PARTITION BY chunk) AS allbad FROM ({_EFFECT})), k AS (SELECT chunk, cluster, row_number() OVER (PARTITION BY chunk ORDER BY cluster) - 1 AS new FROM e WHERE NOT bad OR allbad)
SELECT node_id, new AS cluster FROM ({V.NODES_SQL}) JOIN k USING (chunk, cluster)""")  # fmt: skip
def _(spark, sf):
    n = V.nodes(spark, sf)
    return rewrite.purge_diverged(n, n.groupBy("chunk", "cluster").agg((F.avg("gap") / 100).alias("effect"))).select("node_id", "cluster")


_COARSE = V.NODES_SQL.replace("CAST(json_extract_string(props, '$.k') AS BIGINT) AS chunk", "CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 AS chunk")


def coarse(spark, sf):
    return V.nodes(spark, sf).withColumn("chunk", F.expr("chunk div 10"))


_CALIB10 = _CALIB.replace(V.NODES_SQL, _COARSE)


@query("pf9_erroneous_nodes", f"""WITH n AS MATERIALIZED ({_COARSE}), c AS MATERIALIZED ({_CALIB10}), low AS (SELECT list_sort(list(calibrated))[count(*) // 4 + 1] / 4 * 3.5 AS low FROM c), w AS (SELECT u, v, calibrated FROM c, low WHERE calibrated < low),
t AS (SELECT lag(chunk) OVER o AS prev, chunk AS a, lead(chunk) OVER o AS b, lead(chunk, 2) OVER o AS next FROM n WINDOW o AS (PARTITION BY read_id ORDER BY idx)),
s AS (SELECT least(a, b) AS u, greatest(a, b) AS v, CASE WHEN a <= b THEN next ELSE prev END AS pv, CASE WHEN a <= b THEN prev ELSE next END AS pu FROM t WHERE b IS NOT NULL),
p AS (SELECT u, v, calibrated, v AS removed, least(u, pv) AS x, greatest(u, pv) AS y FROM s JOIN w USING (u, v) WHERE pv IS NOT NULL UNION SELECT u, v, calibrated, u, least(v, pu), greatest(v, pu) FROM s JOIN w USING (u, v) WHERE pu IS NOT NULL)
SELECT p.u, p.v, max(removed) AS removed FROM p JOIN c ON c.u = x AND c.v = y WHERE c.calibrated > 1.2 * p.calibrated GROUP BY ALL""")  # fmt: skip
def _(spark, sf):
    """With a laxer threshold than a stage takes, as the stand-in graph is nearly even."""
    return rewrite.edges_to_break(coarse(spark, sf), lengths(spark, sf), better=1.2, quarter=3.5)


@query("pf11_compacted", f"SELECT node_id, CAST(dense_rank() OVER (ORDER BY chunk) - 1 AS BIGINT) AS chunk FROM ({V.NODES_SQL}) JOIN ({_CHUNKS}) USING (chunk)")
def _(spark, sf):
    return rewrite.compacted(V.nodes(spark, sf), chunks(spark, sf))[0].select("node_id", "chunk")


@query("rw2_encoded_reads", f"SELECT read_id, count(*) AS n_nodes, CAST(min(pos) AS BIGINT) AS leading_gap, CAST(50 AS BIGINT) AS trailing_gap, CAST(sum(len) AS BIGINT) AS covered FROM ({V.NODES_SQL}) GROUP BY read_id")
def _(spark, sf):
    return rewrite.encoded_reads(V.nodes(spark, sf), lengths(spark, sf).select("read_id", (F.col("len") + 50).alias("length")))


@query("rw3_recovered_reads", "SELECT conv_id, md5(string_agg(coalesce(text, ''), '' ORDER BY turn, text)) AS digest FROM conversations GROUP BY conv_id")
def _(spark, sf):
    c = V.table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return rewrite.recovered_text(c, "conv_id", "turn", "text").select("conv_id", F.md5("seq").alias("digest"))


@query("rw1_deleted_nodes", f"SELECT node_id, CAST(row_number() OVER (PARTITION BY read_id ORDER BY idx) - 1 AS INTEGER) AS idx FROM ({V.NODES_SQL}) WHERE cluster <> 1")
def _(spark, sf):
    return rewrite.reindexed(V.nodes(spark, sf).where("cluster <> 1")).select("node_id", "idx")


@query("rw5_saved_labels", f"SELECT node_id, CASE WHEN gap < 0 THEN 9 ELSE cluster END AS cluster FROM ({V.NODES_SQL})")
def _(spark, sf):
    n = V.nodes(spark, sf)
    return rewrite.saved_labels(n.where("gap >= 0"), n.withColumn("cluster", F.lit(9).cast("long"))).select("node_id", "cluster")


@query("rw6_reset_labels", f"SELECT chunk, count(*) AS n, CAST(0 AS BIGINT) AS cluster FROM ({V.NODES_SQL}) GROUP BY chunk")
def _(spark, sf):
    from longweave.operators.summaries import reset_labels

    return reset_labels(V.nodes(spark, sf)).groupBy("chunk", "cluster").agg(F.count("*").alias("n"))


@query("rw7_normalised_clusters", f"""WITH n AS ({V.NODES_SQL}), c AS (SELECT chunk, cluster, row_number() OVER (PARTITION BY chunk ORDER BY count(*) DESC, cluster DESC) - 1 AS new FROM n GROUP BY chunk, cluster) SELECT node_id, new AS cluster FROM n JOIN c USING (chunk, cluster)""")
def _(spark, sf):
    return rewrite.normalised_clusters(V.nodes(spark, sf)).select("node_id", "cluster")


@query("rw8_squished_clusters", f"SELECT node_id, CASE WHEN copy_num >= 4 THEN 0 ELSE cluster END AS cluster FROM ({V.NODES_SQL}) JOIN ({_CHUNKS}) USING (chunk)")
def _(spark, sf):
    c = chunks(spark, sf)
    return rewrite.squished(V.nodes(spark, sf), c, c.where("copy_num >= 4"))[0].select("node_id", "cluster")


@query("rw9_violations", f"""WITH n AS ({V.NODES_SQL}), c AS (SELECT * FROM ({_CHUNKS}) WHERE chunk <> 7) SELECT * FROM (SELECT 'nodes have a chunk' AS rule, count(*) AS n FROM n WHERE chunk = 7 UNION ALL SELECT 'clusters are no more than copies', count(*) FROM c WHERE cluster_num > copy_num UNION ALL SELECT 'labels are within the clusters', count(*) FROM n JOIN c USING (chunk) WHERE cluster > cluster_num) WHERE n > 0""")
def _(spark, sf):
    """The sanity check, on nodes of which one chunk is missing."""
    return rewrite.violations(V.nodes(spark, sf), chunks(spark, sf).where("chunk <> 7"))


_SCORED = f"SELECT *, node_id % 17 AS score FROM (SELECT * REPLACE (chunk // 34 AS chunk, CAST(pos * 0.9 AS BIGINT) AS pos) FROM ({V.NODES_SQL}))"


def _scored(spark, sf):
    n = V.nodes(spark, sf).withColumn("chunk", F.expr("chunk div 34")).withColumn("pos", F.round(F.col("pos") * 0.9).cast("long"))
    return n.withColumn("score", F.col("node_id") % 17)


@query("pf12_slippy")
def _(spark, sf):
    return rewrite.without_slippy(_scored(spark, sf)).select("node_id", "read_id", "pos", "len", "chunk", "is_forward", "score")


@query("pf13_contained")
def _(spark, sf):
    n = _scored(spark, sf).withColumn("len", F.col("len") * (1 + F.col("node_id") % 3))
    return rewrite.without_contained(n).select("node_id", "read_id", "pos", "len", "score")
