"""Aggregations: AG*, and the order statistics SL4, SL5."""

from __future__ import annotations

from pyspark.sql import functions as F

from longweave.functions import stats
from longweave.operators import graph, joins, rewrite, summaries
from longweave.plans import views as V
from longweave.plans.catalog import query
from longweave.plans.scalar_queries import _CHUNKS, _COV, chunks

_N = f"SELECT chunk, count(*) AS n FROM ({V.NODES_SQL}) GROUP BY chunk"


def counts(spark, sf):
    return summaries.chunk_counts(V.nodes(spark, sf))


@query("ag2_chunk_counts", _N)
def _(spark, sf):
    return counts(spark, sf)


@query("ag3_cluster_counts", f"SELECT chunk * 1000000 + cluster AS node, count(*) AS occ FROM ({V.NODES_SQL}) GROUP BY ALL")
def _(spark, sf):
    return graph.build(V.nodes(spark, sf))[0]


@query("ag4_edge_counts", _COV)
def _(spark, sf):
    return rewrite.edge_coverage(V.nodes(spark, sf))


@query("ag6_haploid_coverage", f"SELECT list_sort(list(n))[count(*) // 2 + 1] / 2 AS coverage FROM ({_N})")
def _(spark, sf):
    return rewrite.haploid_coverage(V.nodes(spark, sf))


@query("ag7_count_threshold", f"SELECT CAST(list_sort(list(n))[count(*) // 2 + 1] // 4 AS BIGINT) AS thr FROM ({_N})")
def _(spark, sf):
    return counts(spark, sf).agg(F.floor(stats.upper_median(F.col("n")) / 4).alias("thr"))


@query("ag8_error_quantile", "SELECT l_returnflag, list_sort(list(l_discount))[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1] AS q FROM lineitem GROUP BY l_returnflag")
def _(spark, sf):
    at = F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)
    return stats.picked(V.table(spark, sf, "lineitem"), "l_discount", ["l_returnflag"], at).withColumnRenamed("l_discount", "q")


@query("ag9_error_profile", """WITH m AS (SELECT list_sort(list(l_discount))[count(*) // 2 + 1] AS median FROM lineitem), d AS (SELECT median, abs(l_discount - median) AS far FROM lineitem, m)
SELECT median, round(list_sort(list(far))[count(*) // 2 + 1], 6) AS mad FROM d GROUP BY median""")  # fmt: skip
def _(spark, sf):
    return stats.median_and_mad(V.table(spark, sf, "lineitem"), "l_discount").select("median", F.round("mad", 6).alias("mad"))


@query("ag10_lower_quartile", f"SELECT list_sort(list(n))[count(*) // 4 + 1] AS q FROM ({_COV})")
def _(spark, sf):
    n = rewrite.edge_coverage(V.nodes(spark, sf)).select(F.col("n").alias("value"))
    return stats.picked(n, "value", [], F.floor(F.col("n") / 4)).select(F.col("value").alias("q"))


@query("ag11_pileup", "SELECT l_partkey AS chunk, count(*) AS n, md5(string_agg(l_suppkey || ':' || CAST(l_quantity AS BIGINT), ',' ORDER BY l_quantity, l_suppkey)) AS digest FROM lineitem GROUP BY l_partkey")
def _(spark, sf):
    g = summaries.pileups(V.table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "chunk"), "chunk", "l_quantity", "l_suppkey")
    text = F.array_join(F.transform("xs", lambda x: F.concat(x["l_suppkey"].cast("string"), F.lit(":"), x["l_quantity"].cast("long").cast("string"))), ",")
    return g.select("chunk", "n", F.md5(text).alias("digest"))


@query("ag13_soft_counts", f"""WITH p AS (SELECT label, vec_id, xs[1:4] AS xs FROM ({V.PROFILE_SQL})), e AS (SELECT label, unnest(range(4)) AS cluster, unnest(list_transform(xs, lambda x: exp(x) / list_sum(list_transform(xs, lambda y: exp(y))))) AS p FROM p)
SELECT label, cluster, round(sum(p), 5) AS n FROM e GROUP BY ALL""")  # fmt: skip
def _(spark, sf):
    from longweave.functions.sequence import posterior

    p = V.profile(spark, sf).select("label", F.posexplode(posterior(F.slice("xs", 1, 4))).alias("cluster", "lp"))
    return p.groupBy("label", F.col("cluster").cast("long").alias("cluster")).agg(F.round(F.sum(F.exp("lp")), 5).alias("n"))


@query("ag14_occurrence_spread", f"SELECT copy_num, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS sd FROM ({_N}) JOIN ({_CHUNKS}) USING (chunk) GROUP BY copy_num")
def _(spark, sf):
    j = counts(spark, sf).join(chunks(spark, sf), "chunk")
    return j.groupBy("copy_num").agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("sd"))


@query("ag15_column_gains", f"SELECT col, round(sum(x), 5) AS gain, count(*) AS positive FROM ({V.CELLS_SQL}) WHERE x > 0.00001 GROUP BY col")
def _(spark, sf):
    return summaries.column_gains(V.cells(spark, sf)).withColumn("gain", F.round("gain", 5))


@query("ag16_read_stats", f"SELECT count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS bases, CAST(sum(length(seq)) // count(*) AS BIGINT) AS mean, CAST(min(length(seq)) AS BIGINT) AS least, CAST(max(length(seq)) AS BIGINT) AS most FROM ({V.READS_SQL})")
def _(spark, sf):
    from longweave.plans.stages import read_stats

    return read_stats(V.reads(spark, sf)).drop("masked")


@query("ag17_n50", "WITH r AS (SELECT n_chars, sum(n_chars) OVER (ORDER BY n_chars DESC) AS upto, sum(n_chars) OVER () AS total FROM documents) SELECT max(n_chars) AS n50 FROM r WHERE upto >= floor(total * 0.5)")
def _(spark, sf):
    return stats.n50(V.table(spark, sf, "documents"), "n_chars")


@query("ag18_sl3_top_and_histogram", "SELECT 'top' AS what, n_chars AS value, count(*) AS n FROM (SELECT n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20) GROUP BY ALL UNION ALL SELECT 'bin', n_chars // 1000, count(*) FROM documents GROUP BY ALL")
def _(spark, sf):
    return summaries.longest_and_histogram(V.table(spark, sf, "documents"), "n_chars", "doc_id")


@query("ag19_encoding_stats", f"""WITH e AS (SELECT read_id, count(*) AS n, sum(len) AS covered, max(pos + len) - min(pos) AS length FROM ({V.NODES_SQL}) GROUP BY read_id), r AS (SELECT doc_id AS read_id FROM documents)
SELECT count(*) FILTER (n IS NULL) AS gap_reads, CAST(sum(n) AS BIGINT) AS nodes, round(sum(covered) / sum(length), 6) AS rate FROM r LEFT JOIN e USING (read_id)""")  # fmt: skip
def _(spark, sf):
    return summaries.encoding_stats(V.reads(spark, sf), V.nodes(spark, sf)).withColumn("rate", F.round("rate", 6))


@query("ag20_chunk_occupancy", f"SELECT min(n) AS least, arg_min(chunk, n * 1000000 + chunk) AS least_chunk, max(n) AS most, arg_max(chunk, n * 1000000 + chunk) AS most_chunk, round(avg(n), 6) AS mean FROM ({_N})")
def _(spark, sf):
    return summaries.occupancy(counts(spark, sf)).withColumn("mean", F.round("mean", 6))


@query("ag21_chunk_lengths", f"SELECT count(*) AS n, CAST(sum(chunk + 100) AS BIGINT) AS bases, CAST(sum(chunk + 100) // count(*) AS BIGINT) AS mean FROM ({_N})")
def _(spark, sf):
    return summaries.length_stats(counts(spark, sf), F.col("chunk") + 100)


_PAIRS = "SELECT quality AS a, toxic AS b FROM labels"
_ARI = """WITH c AS (SELECT a, b, count(*) AS c FROM ({p}) GROUP BY a, b), s AS (SELECT sum(c * (c - 1) / 2) AS alike, sum(c) AS n FROM c), x AS (SELECT sum(c * (c - 1) / 2) AS v FROM (SELECT sum(c) AS c FROM c GROUP BY a)), y AS (SELECT sum(c * (c - 1) / 2) AS v FROM (SELECT sum(c) AS c FROM c GROUP BY b))"""


@query("ag23_adjusted_rand", _ARI.format(p=_PAIRS) + "SELECT CAST(n AS BIGINT) AS n, round((t * alike - x.v * y.v) / (floor(t * (x.v + y.v) / 2) - x.v * y.v), 6) AS ari FROM (SELECT *, n * (n - 1) / 2 AS t FROM s), x, y")
def _(spark, sf):
    return stats.adjusted_rand(V.table(spark, sf, "labels"), "quality", "toxic").select("n", F.round("ari", 6).alias("ari"))


@query("ag24_rand_index", _ARI.format(p=_PAIRS) + "SELECT CAST(n AS BIGINT) AS n, round(1 - (x.v + y.v - 2 * alike) / t, 6) AS rand FROM (SELECT *, n * (n - 1) / 2 AS t FROM s), x, y")
def _(spark, sf):
    return stats.rand_index(V.table(spark, sf, "labels"), "quality", "toxic").select("n", F.round("rand", 6).alias("rand"))


@query("ag25_cramers_v", """WITH c AS (SELECT l_returnflag AS a, l_linenumber AS b, count(*) AS c FROM lineitem GROUP BY ALL), a AS (SELECT a, sum(c) AS na FROM c GROUP BY a), b AS (SELECT b, sum(c) AS nb FROM c GROUP BY b), n AS (SELECT sum(c) AS n FROM c)
SELECT round(sqrt(sum(power(coalesce(c, 0) - na * nb / n, 2) / (na * nb / n)) / any_value(n) / (least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) - 1)), 6) AS cramers_v FROM a CROSS JOIN b CROSS JOIN n LEFT JOIN c USING (a, b)""")  # fmt: skip
def _(spark, sf):
    return stats.cramers_v(V.table(spark, sf, "lineitem"), "l_returnflag", "l_linenumber").select(F.round("cramers_v", 6).alias("cramers_v"))


@query("ag26_cluster_correlation", f"""WITH k AS (SELECT read_id, chunk, min(cluster) AS k FROM ({V.NODES_SQL}) GROUP BY ALL), p AS MATERIALIZED (SELECT x.chunk AS a, y.chunk AS b, x.k AS ka, y.k AS kb FROM k x JOIN k y USING (read_id) WHERE x.chunk < y.chunk),
c AS (SELECT a, b, ka, kb, count(*) AS c FROM p GROUP BY ALL), s AS (SELECT a, b, sum(c * (c - 1) / 2) AS alike, sum(c) AS n FROM c GROUP BY ALL), x AS (SELECT a, b, sum(c * (c - 1) / 2) AS xv FROM (SELECT a, b, sum(c) AS c FROM c GROUP BY a, b, ka) GROUP BY ALL), y AS (SELECT a, b, sum(c * (c - 1) / 2) AS yv FROM (SELECT a, b, sum(c) AS c FROM c GROUP BY a, b, kb) GROUP BY ALL)
SELECT a, b, CAST(n AS BIGINT) AS n, round(CASE WHEN xv = t AND yv = t THEN 1 WHEN floor(t * (xv + yv) / 2) = xv * yv THEN 0 ELSE (t * alike - xv * yv) / (floor(t * (xv + yv) / 2) - xv * yv) END, 6) AS ari FROM (SELECT *, n * (n - 1) / 2 AS t FROM s JOIN x USING (a, b) JOIN y USING (a, b)) WHERE n > 7""")  # fmt: skip
def _(spark, sf):
    return joins.cluster_correlation(V.nodes(spark, sf)).select("a", "b", "n", F.round("ari", 6).alias("ari"))


@query("ag27_purity", f"SELECT chunk, cluster, count(*) FILTER (read_id % 2 = 0) AS hap1, count(*) FILTER (read_id % 2 = 1) AS hap2, round(greatest(count(*) FILTER (read_id % 2 = 0), count(*) FILTER (read_id % 2 = 1)) / count(*), 6) AS purity FROM ({V.NODES_SQL}) GROUP BY ALL")
def _(spark, sf):
    return summaries.haplotype_counts(V.nodes(spark, sf), ["chunk", "cluster"], F.col("read_id") % 2 == 0).withColumn("purity", F.round("purity", 6))


@query("ag28_contig_tags", "SELECT c_nationkey % 5 AS contig, CAST(floor(avg(c_acctbal)) AS BIGINT) AS mean_occ, CAST(round(avg(c_custkey % 4)) AS BIGINT) AS copies, string_agg(DISTINCT CAST(c_nationkey AS VARCHAR), ',' ORDER BY CAST(c_nationkey AS VARCHAR)) AS members FROM customer GROUP BY ALL")
def _(spark, sf):
    c = V.table(spark, sf, "customer").select((F.col("c_nationkey") % 5).alias("contig"), F.col("c_acctbal").alias("occ"), (F.col("c_custkey") % 4).alias("copies"), F.col("c_nationkey").alias("name"))
    return summaries.contig_tags(c)


@query("ag29_qv", "SELECT l_returnflag, round(-10 * log10(sum(l_discount) / sum(l_quantity)), 6) AS qv FROM lineitem GROUP BY l_returnflag")
def _(spark, sf):
    return V.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(stats.qv(F.sum("l_discount"), F.sum("l_quantity")), 6).alias("qv"))


@query("ag30_pileup_coverage", f"SELECT chunk, CAST(sum(len) // count(*) AS BIGINT) AS mean, CAST(least(sum(len) // count(*) // 5, 2) AS BIGINT) AS thr FROM ({V.NODES_SQL}) GROUP BY chunk")
def _(spark, sf):
    return summaries.pileup_coverage(V.nodes(spark, sf))


@query("ag31_insertion_candidates", f"SELECT chunk, cluster, is_forward, count(*) AS n, CAST(trunc(sum(gap) / count(*)) AS BIGINT) AS mean_offset FROM ({V.NODES_SQL}) GROUP BY ALL HAVING count(*) >= 3")
def _(spark, sf):
    return summaries.insertion_offsets(V.nodes(spark, sf))


@query("ag32_protected_clusters", f"SELECT chunk FROM ({_N}) JOIN ({_CHUNKS}) USING (chunk) WHERE n * (cluster_num - 1) / cluster_num * 0.5 < 40 AND cluster_num > 1")
def _(spark, sf):
    j = counts(spark, sf).join(chunks(spark, sf), "chunk")
    return j.where("cluster_num > 1 AND n * (cluster_num - 1) / cluster_num * 0.5 < 40").select("chunk")


@query("ag33_low_quantile", f"SELECT list_sort(list(n))[CAST(least(ceil(count(*) * 0.05), count(*) - 1) AS BIGINT) + 1] AS q FROM ({_N})")
def _(spark, sf):
    n = counts(spark, sf).select(F.col("n").alias("value"))
    return stats.picked(n, "value", [], F.least(F.ceil(F.col("n") * 0.05), F.col("n") - 1)).select(F.col("value").alias("q"))


@query("sl4_training_pileups", f"WITH c AS ({_N}), m AS (SELECT list_sort(list(n))[count(*) // 2 + 1] AS m FROM c) SELECT chunk, n FROM c, m WHERE abs(n - m) <= 2 ORDER BY chunk LIMIT 5")
def _(spark, sf):
    c = counts(spark, sf)
    m = c.agg(stats.upper_median(F.col("n")).alias("m"))
    return c.crossJoin(F.broadcast(m)).where("abs(n - m) <= 2").orderBy("chunk").limit(5).select("chunk", "n")  # m: one row


@query("sl5_median_length", "WITH m AS (SELECT source, list_sort(list(n_chars))[count(*) // 2 + 1] AS n_chars FROM documents GROUP BY source) SELECT source, min(doc_id) AS doc_id FROM documents JOIN m USING (source, n_chars) GROUP BY source")
def _(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    m = stats.picked(d, "n_chars", ["source"], F.floor(F.col("n") / 2))
    return d.join(m, ["source", "n_chars"]).groupBy("source").agg(F.min("doc_id").alias("doc_id"))


@query("lb19_cumulative_lengths", "SELECT lang, doc_id, round(sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) / sum(n_chars) OVER (PARTITION BY lang), 6) AS share FROM documents")
def _(spark, sf):
    return summaries.cumulative_share(V.table(spark, sf, "documents").select("lang", "doc_id", "n_chars"), "lang", "n_chars", "doc_id").select("lang", "doc_id", F.round("share", 6).alias("share"))
