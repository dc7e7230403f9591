"""Joins: JN*, AG12, AG34 to AG36, and the tools that are joins of text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from longweave.operators import joins, ordered, summaries
from longweave.plans import views as V
from longweave.plans.aggregate_queries import _N, counts
from longweave.plans.catalog import query
from longweave.plans.order_queries import _CANON
from longweave.plans.scalar_queries import _CHUNKS, chunks


@query("jn1_reads_and_alignments", "SELECT o_orderkey, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS bases FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def _(spark, sf):
    o, li = V.table(spark, sf, "orders"), V.table(spark, sf, "lineitem")
    return summaries.with_alignments(o, li, "o_orderkey", "l_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("bases"))


@query("jn2_nodes_and_chunks", f"SELECT read_id, CAST(sum(copy_num) AS BIGINT) AS copies FROM ({V.NODES_SQL}) JOIN ({_CHUNKS}) USING (chunk) GROUP BY read_id")
def _(spark, sf):
    return joins.of_chunks(V.nodes(spark, sf), chunks(spark, sf)).groupBy("read_id").agg(F.sum("copy_num").alias("copies"))


@query("jn3_encoded_and_raw", f"SELECT r.read_id, count(*) AS nodes, any_value(length(seq)) AS len FROM ({V.NODES_SQL}) n JOIN ({V.READS_SQL}) r USING (read_id) GROUP BY ALL")
def _(spark, sf):
    return summaries.encoded_lengths(V.reads(spark, sf), V.nodes(spark, sf))


@query("jn4_anti", "SELECT count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def _(spark, sf):
    li = V.table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return summaries.without(V.table(spark, sf, "part"), li, "p_partkey").agg(F.count("*").alias("n"))


@query("jn5_semi", "SELECT count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def _(spark, sf):
    li = V.table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return summaries.only(V.table(spark, sf, "part"), li, "p_partkey").agg(F.count("*").alias("n"))


@query("jn6_never_encoded", f"SELECT count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS bases FROM ({V.READS_SQL}) ANTI JOIN ({V.NODES_SQL}) n USING (read_id)")
def _(spark, sf):
    return joins.never_encoded(V.reads(spark, sf), V.nodes(spark, sf)).agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("bases"))


@query("jn7_chunk_pairs", f"SELECT least(a.chunk, b.chunk) AS a, greatest(a.chunk, b.chunk) AS b, count(*) AS n FROM ({V.NODES_SQL}) a JOIN ({V.NODES_SQL}) b ON a.read_id = b.read_id AND a.idx < b.idx GROUP BY ALL")
def _(spark, sf):
    return joins.chunk_pairs(V.nodes(spark, sf))


@query("jn8_overlaps", f"SELECT a.node_id AS a, b.node_id AS b, CAST(least(a.pos + a.len, b.pos + b.len) - greatest(a.pos, b.pos) AS BIGINT) AS overlap FROM ({V.NODES_SQL}) a JOIN ({V.NODES_SQL}) b ON a.read_id = b.read_id AND a.idx < b.idx WHERE least(a.pos + a.len, b.pos + b.len) - greatest(a.pos, b.pos) > 10")
def _(spark, sf):
    return joins.overlaps_in_read(V.nodes(spark, sf), F.lit(10)).select("a", "b", "overlap")


@query("jn10_candidate_reads", f"""WITH k AS (SELECT chunk, cluster, is_forward, read_id, count(*) AS c FROM ({V.NODES_SQL}) GROUP BY ALL)
SELECT a.read_id AS a, b.read_id AS b, CAST(sum(least(a.c, b.c)) AS BIGINT) AS same FROM k a JOIN k b USING (chunk, cluster, is_forward) WHERE a.read_id < b.read_id GROUP BY ALL HAVING sum(least(a.c, b.c)) >= 2""")  # fmt: skip
def _(spark, sf):
    return joins.candidate_reads(V.nodes(spark, sf))


_TILES = "SELECT p_partkey % 100 AS chunk, p_size % 5 AS cluster, p_partkey // 100 AS contig, p_partkey % 100 AS at, p_size % 2 = 0 AS forward FROM part"


def tiles(spark, sf):
    return V.table(spark, sf, "part").selectExpr("p_partkey % 100 AS chunk", "CAST(p_size % 5 AS BIGINT) AS cluster", "p_partkey div 100 AS contig", "p_partkey % 100 AS at", "p_size % 2 = 0 AS forward")


@query("jn11_tile_matches", f"SELECT contig, count(*) AS n, count(*) FILTER (is_forward = forward) AS same_strand FROM ({V.NODES_SQL}) JOIN ({_TILES}) USING (chunk, cluster) GROUP BY contig")
def _(spark, sf):
    return joins.tile_matches(V.nodes(spark, sf), tiles(spark, sf)).groupBy("contig").agg(F.count("*").alias("n"), F.count(F.when(F.col("same_strand"), 1)).alias("same_strand"))


_FILL = f"SELECT u, u_forward, v, v_forward, count(*) AS n, max(\"offset\") AS label FROM ({_CANON}) GROUP BY ALL HAVING count(*) > 1"


def canon(spark, sf):
    return ordered.canonical_edges(ordered.adjacency(V.nodes(spark, sf)))


@query("ag34_filled_edges", _FILL)
def _(spark, sf):
    return canon(spark, sf).groupBy("u", "u_forward", "v", "v_forward").agg(F.count("*").alias("n"), F.max("offset").alias("label")).where("n > 1")


@query("jn12_filled_reads", f"SELECT read_id, count(*) AS n, CAST(sum(label) AS BIGINT) AS labels FROM ({_CANON}) c JOIN ({_FILL}) f USING (u, u_forward, v, v_forward) GROUP BY read_id")
def _(spark, sf):
    c = canon(spark, sf)
    fills = c.groupBy("u", "u_forward", "v", "v_forward").agg(F.count("*").alias("__n"), F.max("offset").alias("label")).where("__n > 1")
    return joins.filled(c, fills).groupBy("read_id").agg(F.count("*").alias("n"), F.sum("label").alias("labels"))


_TIP = f"SELECT chunk, is_forward, count(*) AS n FROM (SELECT *, max(idx) OVER (PARTITION BY read_id) AS last FROM ({V.NODES_SQL})) WHERE idx = last GROUP BY ALL HAVING count(*) > 1"


@query("ag35_filled_tips", _TIP)
def _(spark, sf):
    return summaries.tip_counts(V.nodes(spark, sf))


@query("jn13_tips_and_fills", f"SELECT read_id, t.n FROM (SELECT *, max(idx) OVER (PARTITION BY read_id) AS last FROM ({V.NODES_SQL})) x JOIN ({_TIP}) t USING (chunk, is_forward) WHERE idx = last")
def _(spark, sf):
    n = V.nodes(spark, sf)
    return summaries.last_nodes(n).join(summaries.tip_counts(n), ["chunk", "is_forward"]).select("read_id", "n")


@query("jn14_spanning_counts", f"SELECT h.chunk % 10 AS head, t.chunk % 7 AS tail, count(DISTINCT h.read_id) AS n FROM ({V.NODES_SQL}) h JOIN ({V.NODES_SQL}) t USING (read_id) WHERE h.cluster = 1 AND t.cluster = 2 GROUP BY ALL")
def _(spark, sf):
    n = V.nodes(spark, sf)
    keys = n.select("chunk", "cluster").distinct()
    return joins.spanning_counts(n, keys.where("cluster = 1").withColumn("head", F.col("chunk") % 10), keys.where("cluster = 2").withColumn("tail", F.col("chunk") % 7))


@query("jn15_contig_links", "WITH e AS (SELECT DISTINCT o_custkey AS read_id, o_orderkey % 23 AS contig FROM orders) SELECT a.contig AS a, b.contig AS b, count(*) AS n FROM e a JOIN e b USING (read_id) WHERE a.contig < b.contig GROUP BY ALL")
def _(spark, sf):
    return joins.contig_links(V.table(spark, sf, "orders").select(F.col("o_custkey").alias("read_id"), (F.col("o_orderkey") % 23).alias("contig")))


@query("jn16_lb4_compared_encodings", f"SELECT chunk, a, b, count(*) AS n FROM (SELECT chunk, cluster AS a, (cluster + node_id) % 5 AS b FROM ({V.NODES_SQL})) GROUP BY ALL")
def _(spark, sf):
    n = V.nodes(spark, sf)
    return joins.zipped(n, n.withColumn("cluster", (F.col("cluster") + F.col("node_id")) % 5)).groupBy("chunk", "a", "b").agg(F.count("*").alias("n"))


@query("jn9_overlap_suppression")
def _(spark, sf):
    n = V.nodes(spark, sf)
    a = n.select(F.col("read_id").alias("query"), F.col("pos").alias("qstart"), (F.col("pos") + F.col("len") * 2).alias("qend"), (F.col("gap") / 10).alias("score"), F.col("node_id").alias("id"))
    return joins.without_suppressed(a)


_FIRST = f"SELECT read_id, min(idx) AS i FROM ({V.NODES_SQL}) WHERE chunk = 17 AND cluster = 3 GROUP BY read_id"


@query("ag36_layered_counts", f"SELECT CAST(idx - i AS INTEGER) AS dist, chunk, cluster, count(*) AS n FROM ({V.NODES_SQL}) JOIN ({_FIRST}) USING (read_id) WHERE idx > i GROUP BY ALL")
def _(spark, sf):
    return joins.layered_counts(V.nodes(spark, sf), 17, 3)


@query("lb6_contig_purity", "SELECT l_suppkey AS contig, count(*) FILTER (l_partkey % 2 = 0) AS hap1, count(*) FILTER (l_partkey % 2 = 1) AS hap2 FROM lineitem GROUP BY ALL")
def _(spark, sf):
    return summaries.haplotype_counts(V.table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "contig"), ["contig"], F.col("l_partkey") % 2 == 0).drop("purity")


@query("lb9_filtered_range", "SELECT l_orderkey - 100 AS at, l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey BETWEEN 100 AND 5000 GROUP BY ALL")
def _(spark, sf):
    """Features of a region, with positions counted from its start."""
    return summaries.in_range(V.table(spark, sf, "lineitem"), "l_orderkey", 100, 5000).groupBy(F.col("l_orderkey").alias("at"), "l_linenumber").agg(F.count("*").alias("n"))


@query("lb10_regions", "SELECT n_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey AND c_custkey BETWEEN n_nationkey * 40 AND n_nationkey * 80 GROUP BY ALL")
def _(spark, sf):
    n = V.table(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") * 40).alias("first"), (F.col("n_nationkey") * 80).alias("last"))
    return summaries.in_regions(V.table(spark, sf, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), n, "n_nationkey", "c_custkey").groupBy("n_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("s"))


@query("lb11_lb12_tagged_reads", "SELECT hap, count(*) AS n FROM (SELECT doc_id, unnest(CASE WHEN quality IS NULL THEN [1, 2] ELSE [quality + 1] END) AS hap FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY hap")
def _(spark, sf):
    """Reads by haplotype; those without a tag go to both."""
    return summaries.by_haplotype(V.table(spark, sf, "documents").select("doc_id"), V.table(spark, sf, "labels"), "doc_id", "quality").groupBy("hap").agg(F.count("*").alias("n"))


@query("lb17_contig_summary", "SELECT c_nationkey % 4 AS cp, count(*) AS n, CAST(sum(length(c_name)) AS BIGINT) AS bases FROM customer GROUP BY ALL")
def _(spark, sf):
    return summaries.bases_by(V.table(spark, sf, "customer"), F.col("c_nationkey") % 4, F.length("c_name"))


@query("lb13_pileup_rows", f"SELECT chunk, node_id, read_id, cluster FROM ({V.NODES_SQL}) SEMI JOIN (SELECT chunk FROM ({_N}) WHERE n > 110) c USING (chunk)")
def _(spark, sf):
    return V.nodes(spark, sf).join(counts(spark, sf).where("n > 110"), "chunk", "left_semi").select("chunk", "node_id", "read_id", "cluster")
