"""Window-style operators, sorting, sampling and set operations: WN*, SL*, ST*, IO16."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from longweave.operators import graph, ordered, rewrite, sampling, summaries
from longweave.plans import views as V
from longweave.plans.aggregate_queries import _N, counts
from longweave.plans.catalog import query
from longweave.plans.scalar_queries import _EDGES, _LENS, lengths


@query("wn1_adjacency", _EDGES)
def _(spark, sf):
    return ordered.adjacency(V.nodes(spark, sf))


_CANON = f"""SELECT CASE WHEN flip THEN to_chunk ELSE from_chunk END AS u, CASE WHEN flip THEN NOT to_forward ELSE from_forward END AS u_forward, CASE WHEN flip THEN from_chunk ELSE to_chunk END AS v, CASE WHEN flip THEN NOT from_forward ELSE to_forward END AS v_forward, "offset", read_id, idx FROM (SELECT *, (to_chunk, NOT to_forward, from_chunk, NOT from_forward) < (from_chunk, from_forward, to_chunk, to_forward) AS flip FROM ({_EDGES}))"""


@query("wn2_canonical_edges", f"SELECT u, u_forward, v, v_forward, count(*) AS n FROM ({_CANON}) GROUP BY ALL")
def _(spark, sf):
    return ordered.canonical_edges(ordered.adjacency(V.nodes(spark, sf))).groupBy("u", "u_forward", "v", "v_forward").agg(F.count("*").alias("n"))


@query("wn3_neighbour_offsets", f"SELECT node_id, CAST(pos - lag(pos + len) OVER w AS BIGINT) AS before, CAST(lead(pos) OVER w - pos - len AS BIGINT) AS after FROM ({V.NODES_SQL}) WINDOW w AS (PARTITION BY read_id ORDER BY idx)")
def _(spark, sf):
    return ordered.neighbour_offsets(V.nodes(spark, sf)).select("node_id", "before", "after")


@query("wn4_suffix_sums", f"SELECT len, n, CAST(sum(n) OVER w AS BIGINT) AS longer, CAST(sum(n * len) OVER w AS BIGINT) AS longer_sum FROM (SELECT len, count(*) AS n FROM ({_LENS}) GROUP BY len) WINDOW w AS (ORDER BY len DESC)")
def _(spark, sf):
    return ordered.suffix_sums(lengths(spark, sf))


@query("wn5_exclusive_sums", f'SELECT node_id, CAST(coalesce(sum(len) OVER (PARTITION BY read_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM ({V.NODES_SQL})')
def _(spark, sf):
    return ordered.exclusive_sums(V.nodes(spark, sf), "len", ["read_id"], ["idx"]).select("node_id", "offset")


@query("wn8_merged_intervals", f"""WITH s AS (SELECT read_id, idx, pos AS a, pos + len AS b, max(pos + len) OVER (PARTITION BY read_id ORDER BY pos, pos + len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ({V.NODES_SQL})), g AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT read_id, CAST(min(a) AS BIGINT) AS start, CAST(max(b) AS BIGINT) AS "end" FROM g GROUP BY read_id, island""")  # fmt: skip
def _(spark, sf):
    n = V.nodes(spark, sf).select("read_id", F.col("pos").alias("a"), (F.col("pos") + F.col("len")).alias("b"))
    return ordered.merged_intervals(n, "read_id", "a", "b")


@query("wn9_io16_binned_coverage", f"""WITH n AS (SELECT read_id, greatest(pos, 0) AS a, pos + len AS b FROM ({V.NODES_SQL})), x AS (SELECT *, unnest(range(CAST(a // 1000 AS BIGINT), CAST((b - 1) // 1000 AS BIGINT) + 1)) AS bin FROM n WHERE b > a)
SELECT read_id, bin, CAST(sum(least(b, (bin + 1) * 1000) - greatest(a, bin * 1000)) AS BIGINT) AS covered FROM x GROUP BY ALL""")  # fmt: skip
def _(spark, sf):
    n = V.nodes(spark, sf)
    return ordered.binned_coverage(n, "read_id", F.greatest("pos", F.lit(0)), F.col("pos") + F.col("len"), 1000)


@query("wn10_polishing_windows", f"SELECT \"window\", count(*) AS parts, CAST(sum(least(b, (\"window\" + 1) * 500) - greatest(a, \"window\" * 500)) AS BIGINT) AS bases FROM (SELECT *, unnest(range(CAST(a // 500 AS BIGINT), CAST((b - 1) // 500 AS BIGINT) + 1)) AS \"window\" FROM (SELECT greatest(pos, 0) AS a, pos + len AS b FROM ({V.NODES_SQL})) WHERE b > a) GROUP BY ALL")
def _(spark, sf):
    n = V.nodes(spark, sf).select(F.greatest("pos", F.lit(0)).alias("a"), (F.col("pos") + F.col("len")).alias("b"))
    return ordered.split_alignment(n, "a", "b", 500).groupBy("window").agg(F.count("*").alias("parts"), F.sum(F.col("to") - F.col("from")).alias("bases"))


@query("sl1_weighted_sample")
def _(spark, sf):
    c = V.table(spark, sf, "part").select("p_partkey", (1 - F.col("p_size") / 60.0).alias("weight"))
    return sampling.weighted_sample(c, "p_partkey", "weight", 50)


@query("sl6_best_candidate", f"SELECT chunk, cluster, n FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY n DESC, cluster DESC) AS r FROM (SELECT chunk, cluster, count(*) AS n FROM ({V.NODES_SQL}) GROUP BY ALL)) WHERE r = 1")
def _(spark, sf):
    return summaries.best_cluster(V.nodes(spark, sf))


@query("sl7_strongest_focus", f'SELECT from_chunk, to_chunk, "offset" FROM (SELECT *, row_number() OVER (PARTITION BY from_chunk ORDER BY "offset" DESC, to_chunk, read_id, idx) AS r FROM ({_EDGES})) WHERE r = 1')
def _(spark, sf):
    w = Window.partitionBy("from_chunk").orderBy(F.desc("offset"), "to_chunk", "read_id", "idx")
    return ordered.adjacency(V.nodes(spark, sf)).withColumn("r", F.row_number().over(w)).where("r = 1").select("from_chunk", "to_chunk", "offset")


_SIM = f"SELECT least(from_chunk, to_chunk) % 12 AS i, greatest(from_chunk, to_chunk) % 13 AS j, count(*) / 20 AS s FROM ({_EDGES}) GROUP BY ALL"


@query("sl8_pruned_similarity", f"""WITH s AS MATERIALIZED ({_SIM}), t AS (SELECT i, greatest(list_sort(list(s))[8], 0.51) AS thr FROM s GROUP BY i), k AS (SELECT i, j FROM s JOIN t USING (i) WHERE s >= thr), b AS (SELECT i, j FROM k UNION SELECT j, i FROM k)
SELECT i, j, round(CASE WHEN b.i IS NULL THEN 0 ELSE s END, 6) AS s FROM s LEFT JOIN b USING (i, j)""")  # fmt: skip
def _(spark, sf):
    e = ordered.adjacency(V.nodes(spark, sf)).groupBy((F.least("from_chunk", "to_chunk") % 12).alias("i"), (F.greatest("from_chunk", "to_chunk") % 13).alias("j")).agg((F.count("*") / 20).alias("s"))
    return sampling.pruned(e, 7, 0.51, 0.0).select("i", "j", F.round("s", 6).alias("s"))


@query("sl9_split_reads", "WITH o AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY md5('7:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM documents) SELECT doc_id, coalesce(before, 0) < 200000 AS taken FROM o")
def _(spark, sf):
    return sampling.split_by_budget(V.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 200_000, seed=7)


@query("st1_union_changed", f"SELECT chunk FROM ({_N}) WHERE n > 105 UNION SELECT chunk FROM ({_N}) WHERE n < 95")
def _(spark, sf):
    n = counts(spark, sf)
    return n.where("n > 105").select("chunk").union(n.where("n < 95").select("chunk")).distinct()


@query("st2_difference", f"SELECT chunk FROM ({_N}) WHERE n > 95 EXCEPT SELECT chunk FROM ({_N}) WHERE n > 105")
def _(spark, sf):
    n = counts(spark, sf)
    return n.where("n > 95").select("chunk").exceptAll(n.where("n > 105").select("chunk"))


@query("st3_subset", f"WITH r AS (SELECT read_id, list_distinct(list(chunk)) AS c FROM ({V.NODES_SQL}) GROUP BY read_id) SELECT a.read_id AS a, b.read_id AS b FROM r a JOIN r b ON a.read_id < b.read_id WHERE len(list_filter(a.c, lambda x: NOT list_contains(b.c, x))) <= 20")
def _(spark, sf):
    """Reads whose chunks, but for at most twenty, another has too."""
    return summaries.nearly_contained(V.nodes(spark, sf), 20)


@query("st4_dedup", f"SELECT DISTINCT least(from_chunk, to_chunk) AS a, greatest(from_chunk, to_chunk) AS b FROM ({_EDGES})")
def _(spark, sf):
    return ordered.adjacency(V.nodes(spark, sf)).select(F.least("from_chunk", "to_chunk").alias("a"), F.greatest("from_chunk", "to_chunk").alias("b")).dropDuplicates()


@query("st5_io17_extract", f"SELECT 'READ' AS kind, read_id AS id, length(seq) AS length, CAST(NULL AS BIGINT) AS copies FROM ({V.READS_SQL}) UNION ALL SELECT 'UNIT', chunk, chunk + 100, n FROM ({_N})")
def _(spark, sf):
    from longweave.plans.stages import extracted

    units = counts(spark, sf).select("chunk", (F.col("chunk") + 100).alias("length"), F.col("n").alias("copies"))
    return extracted(V.reads(spark, sf), units)


@query("sl2_pf10_top_components")
def _(spark, sf):
    n = V.nodes(spark, sf)
    return graph.reads_in_components(n, 1).groupBy("read_id").agg(F.count("*").alias("n"))


@query("pf5_rounds", f"SELECT read_id, count(*) AS n FROM ({V.NODES_SQL}) SEMI JOIN (SELECT chunk FROM ({_N}) WHERE n <= 100) USING (chunk) GROUP BY read_id")
def _(spark, sf):
    n = V.nodes(spark, sf)
    return rewrite.reindexed(rewrite.without_chunks(n, rewrite.frequent_chunks(n, 10.0, 7))).groupBy("read_id").agg(F.count("*").alias("n"))
