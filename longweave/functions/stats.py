"""Exact order statistics and measures of agreement, over groups of a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_fraction(x: Column, numerator: int, denominator: int) -> Column:
    """Aggregate: the value at index floor(n * numerator / denominator) in ascending order.

    Gathers a group's values, so it is for groups of bounded size; see :func:`picked` for others.
    """
    at = F.floor(F.count(x) * numerator / denominator).cast("int")
    return F.get(F.sort_array(F.collect_list(x)), F.least(at, F.count(x).cast("int") - 1))


def upper_median(x: Column) -> Column:
    return at_fraction(x, 1, 2)


def picked(df: DataFrame, value: str, keys: list[str], index: Column) -> DataFrame:
    """(keys, value) at ``index`` (of columns ``n`` and the keys) in ascending order, without gathering groups.

    Equal values are counted before they are ordered, so a window holds distinct values of a group only.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    own = Window.partitionBy(*keys)
    upto = own.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = n.withColumn("__to", F.sum("__n").over(upto)).withColumn("n", F.sum("__n").over(own)).withColumn("__at", index)
    return ranked.where((F.col("__at") < F.col("__to")) & (F.col("__at") >= F.col("__to") - F.col("__n"))).select(*keys, value)


def n50(df: DataFrame, length: str, fraction: float = 0.5) -> DataFrame:
    """One row, n50: the first length in descending order at which the running sum reaches the fraction."""
    n = df.where(F.col(length).isNotNull()).groupBy(length).agg((F.count("*") * F.col(length)).alias("s"))
    down = Window.orderBy(F.desc(length)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = n.withColumn("upto", F.sum("s").over(down)).withColumn("all", F.sum("s").over(Window.partitionBy()))
    return runs.where(F.col("upto") >= F.floor(F.col("all") * fraction)).agg(F.max(length).alias("n50"))


def _pairs(x: Column) -> Column:
    return x * (x - 1) / 2


def contingency(df: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, both, of_a, of_b, all): numbers of items, and of pairs alike in both, in a, in b, and of all."""
    keys = keys or []
    cells = df.groupBy(*keys, a, b).agg(F.count("*").alias("c"))

    def alike(by: list[str], name: str) -> DataFrame:
        return cells.groupBy(*keys, *by).agg(F.sum("c").alias("c")).groupBy(*keys).agg(F.sum(_pairs(F.col("c"))).alias(name))

    parts = [alike([a, b], "both"), alike([a], "of_a"), alike([b], "of_b"), cells.groupBy(*keys).agg(F.sum("c").alias("n"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys) if keys else out.crossJoin(F.broadcast(p))  # one row each
    return out.withColumn("all", _pairs(F.col("n")))


def adjusted_rand(df: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, ari); null where the index isn't defined."""
    c = contingency(df, a, b, keys)
    product = F.col("of_a") * F.col("of_b")
    half = F.floor(F.col("all") * (F.col("of_a") + F.col("of_b")) / 2)
    return c.select(*(keys or []), "n", F.when(half != product, (F.col("all") * F.col("both") - product) / (half - product)).alias("ari"))


def rand_index(df: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, rand): the share of pairs on which both labellings agree; null below two items."""
    c = contingency(df, a, b, keys)
    return c.select(*(keys or []), "n", F.when(F.col("all") > 0, 1 - (F.col("of_a") + F.col("of_b") - 2 * F.col("both")) / F.col("all")).alias("rand"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row, cramers_v; null if a label has one value only."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("c"))
    ra, rb = cells.groupBy(a).agg(F.sum("c").alias("na")), cells.groupBy(b).agg(F.sum("c").alias("nb"))
    n = cells.agg(F.sum("c").alias("n"))
    # chi² = n (sum of c² / (na nb) - 1), so that empty cells need no row
    s = cells.join(ra, a).join(rb, b).agg(F.sum(F.col("c") * F.col("c") / (F.col("na") * F.col("nb"))).alias("s"))
    k = ra.agg(F.count("*").alias("ka")).crossJoin(F.broadcast(rb.agg(F.count("*").alias("kb"))))
    one = s.crossJoin(F.broadcast(n)).crossJoin(F.broadcast(k))  # of one row each
    least = F.least("ka", "kb") - 1
    return one.select(F.when(least > 0, F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / least)).alias("cramers_v"))


def median_and_mad(df: DataFrame, value: str) -> DataFrame:
    """One row: the upper median and the upper median of the distances from it."""
    mid = picked(df, value, [], F.floor(F.col("n") / 2)).withColumnRenamed(value, "median")
    far = df.crossJoin(F.broadcast(mid)).select("median", F.abs(F.col(value) - F.col("median")).alias("far"))
    return picked(far, "far", ["median"], F.floor(F.col("n") / 2)).select("median", F.col("far").alias("mad"))


def qv(distance: Column, covered: Column) -> Column:
    """-10 log10 of the edit distance over the bases covered."""
    return -10 * F.log10(distance / covered)
