"""Filters and rewrites of nodes, chunks and reads. Edges and gaps are derived from nodes, never spliced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longweave.functions.stats import picked, upper_median
from longweave.operators.ordered import adjacency, calibrated
from longweave.session import saved

#: Bases that an alignment may lack at either end of what it should span.
SLACK = 25


def full_span(start: Column, end: Column, length: Column, slack: int = SLACK) -> Column:
    return (start < slack) & (length - end < slack)


def proper_overlap(qs: Column, qe: Column, ql: Column, ts: Column, te: Column, tl: Column, same_strand: Column, slack: int = SLACK) -> Column:
    """Whether an alignment joins the end of one sequence to the start of the other, in any orientation."""
    q_head, q_tail, t_head, t_tail = qs < slack, ql - qe < slack, ts < slack, tl - te < slack
    return F.when(same_strand, (q_tail & t_head) | (q_head & t_tail)).otherwise((q_tail & t_tail) | (q_head & t_head))


def frequent_chunks(nodes: DataFrame, coverage: float, copies: int) -> DataFrame:
    """(chunk, n): chunks that occur more often than ``copies`` + 3 times the coverage explain."""
    from math import ceil

    return nodes.groupBy("chunk").agg(F.count("*").alias("n")).where(F.col("n") > ceil(coverage) * (copies + 3))


def without_chunks(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    return nodes.join(chunks.select("chunk"), "chunk", "left_anti")


def reindexed(nodes: DataFrame) -> DataFrame:
    """``nodes`` with idx dense from 0 in each read, after nodes have gone."""
    return nodes.withColumn("idx", (F.row_number().over(Window.partitionBy("read_id").orderBy("idx")) - 1).cast("int"))


def purge_multiplicity(nodes: DataFrame, chunks: DataFrame, upper: int) -> DataFrame:
    """Nodes whose chunk has a copy number from 1 to below ``upper``; reads left empty go with their nodes."""
    bad = chunks.where((F.col("copy_num") >= upper) | (F.col("copy_num") == 0))
    return without_chunks(nodes, bad)


def purge_large_indels(nodes: DataFrame, chunks: DataFrame, coverage: float, indel_size: int, fraction: float, compress: bool = False) -> DataFrame:
    """Nodes (with indel: their strongest stretch of indels) that groups with outlying indels lose.

    A group is a chunk, or a chunk's cluster unless ``compress``. Of single-copy chunks a group loses
    nodes if some but not nearly all have a large indel; of others if more have one than ``fraction`` of
    the coverage, and that many stay. What goes are the nodes above half the size.
    """
    from math import ceil

    keys = ["chunk"] if compress else ["chunk", "cluster"]
    half = ceil(indel_size * 0.5)
    g = nodes.groupBy(*keys).agg(F.count("*").alias("n"), F.sum((F.col("indel") > indel_size).cast("int")).alias("large"), F.sum((F.col("indel") > half).cast("int")).alias("over")).join(chunks.select("chunk", "copy_num"), "chunk")
    single = (F.col("large") >= 1) & (F.col("large") < F.ceil(F.col("n") * (1 - fraction / 2)))
    low = F.floor(F.lit(coverage * fraction))
    multi = (F.col("large") > low) & (F.col("over") < F.ceil(F.greatest(F.col("n") - low, F.lit(0))))
    hit = g.where(F.when(F.col("copy_num") <= 1, single).otherwise(multi)).select(*keys)
    return nodes.where(F.col("indel") > half).join(hit, keys, "left_semi")


def purge_diverged(nodes: DataFrame, effects: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Nodes without the clusters whose effect exceeds the threshold, clusters renumbered from 0.

    A chunk of which all clusters have diverged keeps them. The posterior, if there is one, loses its
    entries of clusters that went.
    """
    e = effects.withColumn("bad", F.col("effect") > threshold)
    e = e.withColumn("all_bad", F.min("bad").over(Window.partitionBy("chunk"))).withColumn("keep", ~F.col("bad") | F.col("all_bad"))
    new = e.where("keep").withColumn("new", (F.row_number().over(Window.partitionBy("chunk").orderBy("cluster")) - 1).cast("long"))
    left = new.groupBy("chunk").agg(F.sort_array(F.collect_list("cluster")).alias("kept"))
    out = nodes.join(new.select("chunk", "cluster", "new"), ["chunk", "cluster"]).join(left, "chunk")
    if "posterior" in nodes.columns:
        out = out.withColumn("posterior", F.filter("posterior", lambda x, i: F.array_contains("kept", i.cast("long"))))
    return out.withColumn("cluster", F.col("new")).select(*nodes.columns)


def edge_coverage(nodes: DataFrame) -> DataFrame:
    """(u, v, n, offsets): adjacent chunks in either order, how often, and the sum of their offsets."""
    return adjacency(nodes).groupBy(F.least("from_chunk", "to_chunk").alias("u"), F.greatest("from_chunk", "to_chunk").alias("v")).agg(F.count("*").alias("n"), F.sum("offset").alias("offsets"))


def calibrated_edges(nodes: DataFrame, lengths: DataFrame) -> DataFrame:
    """(u, v, calibrated): edge coverage calibrated at the mean offset, at least 0."""
    gap = F.greatest(F.expr("offsets div n"), F.lit(0))
    return calibrated(edge_coverage(nodes).select("u", "v", F.col("n").alias("obs"), gap.alias("gap")), lengths).select("u", "v", "calibrated")


def edges_to_break(nodes: DataFrame, lengths: DataFrame, better: float = 3.0, quarter: float = 1.0) -> DataFrame:
    """(u, v, removed): weak adjacencies with a much stronger way around, and the chunk to drop.

    Weak is below a quarter (times ``quarter``) of the lower quartile. Going on from u past v (or from v past u) an edge
    must be ``better`` times as strong. Where both ends qualify v goes.
    """
    cov = saved(calibrated_edges(nodes, lengths), "coverage")
    low = picked(cov, "calibrated", [], F.floor(F.col("n") / 4)).select((F.col("calibrated") / 4 * quarter).alias("low"))
    weak = cov.crossJoin(F.broadcast(low)).where("calibrated < low").select("u", "v", "calibrated")  # low: one row
    own = Window.partitionBy("read_id").orderBy("idx")
    trio = nodes.select(F.lag("chunk").over(own).alias("prev"), F.col("chunk").alias("a"), F.lead("chunk").over(own).alias("b"), F.lead("chunk", 2).over(own).alias("next")).where("b IS NOT NULL")
    ahead = F.col("a") <= F.col("b")
    sides = trio.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.when(ahead, F.col("next")).otherwise(F.col("prev")).alias("past_v"), F.when(ahead, F.col("prev")).otherwise(F.col("next")).alias("past_u"))
    probe = sides.join(weak, ["u", "v"]).select("u", "v", "calibrated", F.explode(F.array(F.struct(F.col("u").alias("end"), F.col("v").alias("drop"), F.col("past_v").alias("far")), F.struct(F.col("v").alias("end"), F.col("u").alias("drop"), F.col("past_u").alias("far")))).alias("p")).where("p.far IS NOT NULL")
    probe = probe.select("u", "v", "calibrated", F.col("p.drop").alias("removed"), F.least("p.end", "p.far").alias("x"), F.greatest("p.end", "p.far").alias("y")).distinct()
    strong = cov.select(F.col("u").alias("x"), F.col("v").alias("y"), F.col("calibrated").alias("way"))
    return probe.join(strong, ["x", "y"]).where(F.col("way") > better * F.col("calibrated")).groupBy("u", "v").agg(F.max("removed").alias("removed"))


def without_erroneous_nodes(nodes: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes but for those that an edge to break names."""
    cut = edges_to_break(nodes, lengths)
    adj = adjacency(nodes).select("read_id", "idx", "from_chunk", F.least("from_chunk", "to_chunk").alias("u"), F.greatest("from_chunk", "to_chunk").alias("v"))
    gone = adj.join(cut, ["u", "v"]).select("read_id", F.when(F.col("removed") == F.col("from_chunk"), F.col("idx")).otherwise(F.col("idx") + 1).alias("idx")).distinct()
    return reindexed(nodes.join(gone, ["read_id", "idx"], "left_anti"))


def compacted(nodes: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, chunks) with chunk ids dense from 0 in order of id. One row a chunk is ordered, never nodes."""
    new = chunks.select("chunk", (F.row_number().over(Window.orderBy("chunk")) - 1).cast("long").alias("__new"))
    swap = lambda df: df.join(new, "chunk").withColumn("chunk", F.col("__new")).select(*df.columns)
    return swap(nodes), swap(chunks)


def without_slippy(nodes: DataFrame) -> DataFrame:
    """One node of consecutive ones of equal chunk and strand that overlap: the best score, the first of ties.

    The fold goes node by node, as what stays decides what the next is compared with.
    """
    item = F.struct("pos", "len", "chunk", "is_forward", "score", "node_id")
    folded = nodes.groupBy("read_id").agg(F.sort_array(F.collect_list(item)).alias("xs"))
    empty = F.filter("xs", lambda x: F.lit(False))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        slip = (F.size(acc) > 0) & (last["chunk"] == x["chunk"]) & (last["is_forward"] == x["is_forward"]) & (x["pos"] < last["pos"] + last["len"])
        kept = F.when(x["score"] > last["score"], F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(x))).otherwise(acc)
        return F.when(slip, kept).otherwise(F.concat(acc, F.array(x)))

    stay = folded.select(F.explode(F.aggregate("xs", empty, step)).alias("x")).select("x.node_id")
    return nodes.join(stay, "node_id", "left_semi")


def without_contained(nodes: DataFrame) -> DataFrame:
    """Nodes of which none is contained in the one beside it: the lower score goes, again and again."""

    def run(key, t):
        import pyarrow as pa

        rows = sorted(t.to_pylist(), key=lambda r: (r["pos"], r["pos"] + r["len"], r["node_id"]))
        at = 0
        while at + 1 < len(rows):
            a, b = rows[at], rows[at + 1]
            inside = (a["pos"] <= b["pos"] and b["pos"] + b["len"] <= a["pos"] + a["len"]) or (b["pos"] <= a["pos"] and a["pos"] + a["len"] <= b["pos"] + b["len"])
            if inside:
                rows.pop(at if a["score"] < b["score"] else at + 1)
                at = max(0, at - 1)
            else:
                at += 1
        return pa.table({"node_id": pa.array([r["node_id"] for r in rows], pa.int64())})

    stay = nodes.select("read_id", "node_id", "pos", "len", "score").groupBy("read_id").applyInArrow(run, "node_id long")
    return nodes.join(stay, "node_id", "left_semi")


def encoded_reads(nodes: DataFrame, lengths: DataFrame) -> DataFrame:
    """(read_id, n_nodes, leading_gap, trailing_gap, covered): what nodes leave of a read, by coordinates."""
    n = nodes.groupBy("read_id").agg(F.count("*").alias("n_nodes"), F.min("pos").alias("leading_gap"), F.max(F.col("pos") + F.col("len")).alias("end"), F.sum("len").alias("covered"))
    return n.join(lengths, "read_id").select("read_id", "n_nodes", "leading_gap", F.greatest(F.col("length") - F.col("end"), F.lit(0)).alias("trailing_gap"), "covered")


def recovered_text(parts: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, seq): the parts of a read joined in order."""
    return parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("p")).select(key, F.array_join(F.transform("p", lambda x: x[text]), "").alias("seq"))


def saved_labels(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` nodes with the clusters that ``nodes`` of the same node_id had; other labels stay."""
    old = nodes.select("node_id", F.col("cluster").alias("__old"))
    return new.join(old, "node_id", "left").withColumn("cluster", F.coalesce("__old", "cluster")).drop("__old")


def normalised_clusters(nodes: DataFrame) -> DataFrame:
    """Clusters of each chunk renumbered by size, largest first, the greater label first on ties.

    A posterior moves along with the labels.
    """
    n = nodes.groupBy("chunk", "cluster").agg(F.count("*").alias("__n"))
    rank = n.withColumn("new", (F.row_number().over(Window.partitionBy("chunk").orderBy(F.desc("__n"), F.desc("cluster"))) - 1).cast("long"))
    out = nodes.join(rank.select("chunk", "cluster", "new"), ["chunk", "cluster"])
    if "posterior" in nodes.columns:
        order = rank.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("new", "cluster"))).alias("__o"))
        out = out.join(order, "chunk").withColumn("posterior", F.transform("__o", lambda o: F.get("posterior", o["cluster"].cast("int"))))
    return out.withColumn("cluster", F.col("new")).select(*nodes.columns)


def squished(nodes: DataFrame, chunks: DataFrame, suspicious: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, chunks) in which suspicious chunks have one cluster again."""
    bad = suspicious.select("chunk", F.lit(True).alias("__bad"))
    n = nodes.join(bad, "chunk", "left").withColumn("cluster", F.when(F.col("__bad"), F.lit(0).cast("long")).otherwise(F.col("cluster")))
    if "posterior" in nodes.columns:
        n = n.withColumn("posterior", F.when(F.col("__bad"), F.array(F.lit(0.0))).otherwise(F.col("posterior")))
    c = chunks.join(bad, "chunk", "left").withColumn("cluster_num", F.when(F.col("__bad"), F.lit(1)).otherwise(F.col("cluster_num")))
    return n.select(*nodes.columns), c.select(*chunks.columns)


def violations(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(rule, n): rows that break an invariant; no row for a rule that holds."""
    twice = chunks.groupBy("chunk").count().where("count > 1").select(F.lit("chunk ids are unique").alias("rule"))
    lost = nodes.join(chunks, "chunk", "left_anti").select(F.lit("nodes have a chunk").alias("rule"))
    more = chunks.where("cluster_num > copy_num").select(F.lit("clusters are no more than copies").alias("rule"))
    high = nodes.join(chunks, "chunk").where("cluster > cluster_num").select(F.lit("labels are within the clusters").alias("rule"))
    return twice.unionByName(lost).unionByName(more).unionByName(high).groupBy("rule").agg(F.count("*").alias("n"))


def overlapping_chunks(paf: DataFrame, chunk_len: int, identity: float) -> DataFrame:
    """(a, b): chunks with a proper overlap of high identity over more than half a chunk."""
    ok = proper_overlap(F.col("qstart"), F.col("qend"), F.col("qlen"), F.col("tstart"), F.col("tend"), F.col("tlen"), F.col("strand") == "+")
    hit = paf.where(ok & (F.col("matches") / F.col("block") > identity) & (F.col("block") > chunk_len / 2) & (F.col("qname") != F.col("tname")))
    return hit.select(F.least("qname", "tname").alias("a"), F.greatest("qname", "tname").alias("b")).distinct()


def haploid_coverage(nodes: DataFrame) -> DataFrame:
    """One row, coverage: half the upper median of how often chunks occur."""
    n = nodes.groupBy("chunk").agg(F.count("*").alias("n"))
    return n.agg((upper_median(F.col("n")) / 2).alias("coverage"))
