"""The algebra of nodes in the order of their reads: neighbours, canonical edges, runs, bins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order() -> Window:
    return Window.partitionBy("read_id").orderBy("idx")


def adjacency(nodes: DataFrame) -> DataFrame:
    """(read_id, idx, from_*, to_*, offset): each node with the next of its read.

    offset is the start of the next less the end of this; negative where they overlap.
    """
    keep = ["chunk", "cluster", "is_forward", "pos", "len"]
    nxt = F.lead(F.struct(*keep)).over(_order())
    edges = nodes.select("read_id", "idx", *keep, nxt.alias("next")).where("next IS NOT NULL")
    return edges.select(
        "read_id", "idx", F.col("chunk").alias("from_chunk"), F.col("cluster").alias("from_cluster"), F.col("is_forward").alias("from_forward"),
        F.col("next.chunk").alias("to_chunk"), F.col("next.cluster").alias("to_cluster"), F.col("next.is_forward").alias("to_forward"),
        (F.col("next.pos") - F.col("pos") - F.col("len")).alias("offset"),
    )


def canonical_edges(edges: DataFrame) -> DataFrame:
    """``edges`` with u, u_forward, v, v_forward: the lesser of an edge and the same edge read backwards."""
    ahead = F.struct(F.col("from_chunk").alias("u"), F.col("from_forward").alias("u_forward"), F.col("to_chunk").alias("v"), F.col("to_forward").alias("v_forward"))
    back = F.struct(F.col("to_chunk").alias("u"), (~F.col("to_forward")).alias("u_forward"), F.col("from_chunk").alias("v"), (~F.col("from_forward")).alias("v_forward"))
    return edges.withColumn("__e", F.least(ahead, back)).select(*edges.columns, "__e.*")


def neighbour_offsets(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the gaps to the node before and after; null at the ends of a read."""
    end = F.col("pos") + F.col("len")
    return nodes.withColumn("before", F.col("pos") - F.lag(end).over(_order())).withColumn("after", F.lead("pos").over(_order()) - end)


def suffix_sums(lengths: DataFrame, length: str = "len") -> DataFrame:
    """(len, n, longer, longer_sum): for each length how many reads are as long or longer, and their sum."""
    n = lengths.groupBy(F.col(length).alias("len")).agg(F.count("*").alias("n"))
    down = Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return n.select("len", "n", F.sum("n").over(down).alias("longer"), F.sum(F.col("n") * F.col("len")).over(down).alias("longer_sum"))


def calibrated(observed: DataFrame, lengths: DataFrame, length: str = "len") -> DataFrame:
    """``observed`` (with obs and gap) and ``calibrated``: coverage as if the gap were one base.

    obs * mean length / mean over reads of what a read has beyond the gap; 0 where no read is as long.
    The lengths enter as their distinct values, which stay few however many reads there are.
    """
    steps = suffix_sums(lengths, length)
    total = steps.agg(F.max("longer").alias("all"), F.max("longer_sum").alias("sum"), F.collect_list(F.struct("len", "longer", "longer_sum")).alias("steps"))
    at = F.array_min(F.filter(F.col("steps"), lambda s: s["len"] >= F.col("gap")))
    out = observed.crossJoin(F.broadcast(total)).withColumn("__s", at)  # one row of distinct lengths
    factor = (F.col("__s.longer_sum") - F.col("gap") * F.col("__s.longer")) / F.col("all")
    value = F.when(F.col("__s").isNull(), F.lit(0.0)).when(factor > 0, F.col("obs") * (F.col("sum") / F.col("all")) / factor)
    return out.withColumn("calibrated", value).drop("all", "sum", "steps", "__s")


def exclusive_sums(df: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``offset``: the sum of the values before."""
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("offset", F.coalesce(F.sum(value).over(own), F.lit(0)))


def merged_intervals(hits: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end): unions of intervals that overlap or touch."""
    own = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1))
    new = hits.withColumn("__new", F.coalesce((F.col(start) > before).cast("int"), F.lit(1)))
    islands = new.withColumn("__island", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy(key, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("__island")


def binned_coverage(intervals: DataFrame, key: str, start: Column, end: Column, width: int) -> DataFrame:
    """(key, bin, covered): bases of half-open intervals in each bin; an interval gives a row a bin it meets."""
    own = intervals.select(key, start.alias("s"), end.alias("e")).where("e > s")
    bins = own.withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))))
    part = F.least(F.col("e"), (F.col("bin") + 1) * width) - F.greatest(F.col("s"), F.col("bin") * width)
    return bins.groupBy(key, "bin").agg(F.sum(part).alias("covered"))


def fixed_windows(df: DataFrame, length: Column, size: int, margin: int) -> DataFrame:
    """``df`` with start: windows of ``size`` from ``margin`` on, that end ``margin`` before the end at least."""
    n = F.floor((length - 2 * margin) / size).cast("int")
    return df.where(n > 0).withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * size + margin)))


def split_alignment(df: DataFrame, start: str, end: str, size: int) -> DataFrame:
    """``df`` with window, from, to: an alignment cut at multiples of ``size`` of the reference."""
    own = df.where(F.col(end) > F.col(start)).withColumn("window", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor((F.col(end) - 1) / size))))
    return own.withColumn("from", F.greatest(F.col(start), F.col("window") * size)).withColumn("to", F.least(F.col(end), (F.col("window") + 1) * size))
