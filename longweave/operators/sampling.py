"""Seeded sampling and pruning. Seeds enter a hash of the key, so partitioning changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, each next one with a chance by its weight; all if there are no more.

    The n least of -ln(u) / weight with u from a hash are such a sample, so one pass keeps n rows a task.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return df.withColumn("__r", -F.log(u) / F.greatest(F.col(weight), F.lit(1e-10))).orderBy("__r", key).limit(n).drop("__r")


def split_by_budget(df: DataFrame, key: str, size: str, budget: int, seed: int = 42) -> DataFrame:
    """(key, taken): rows in a seeded random order, taken until the budget is reached; the crossing one is in.

    Running sums are kept within ranges of the hash, and the ranges' own sums are added up, so no task
    orders the whole table.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    rows = df.select(key, size, h.alias("__h"), F.substring(h, 1, 2).alias("__range"))
    sums = rows.groupBy("__range").agg(F.sum(size).alias("__s"))  # 256 rows at most
    before = sums.select("__range", F.coalesce(F.sum("__s").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    own = Window.partitionBy("__range").orderBy("__h", key).rowsBetween(Window.unboundedPreceding, -1)
    upto = rows.join(F.broadcast(before), "__range").withColumn("__upto", F.col("__base") + F.coalesce(F.sum(size).over(own), F.lit(0)))
    return upto.select(key, (F.col("__upto") < budget).alias("taken"))


def pruned(similarities: DataFrame, nth: int, least: float, small: float = 1e-16) -> DataFrame:
    """(i, j, s): s stays where it reaches its row's ``nth`` order statistic (from 0) and ``least``, in either direction.

    A row shorter than ``nth`` keeps nothing of its own. What doesn't stay becomes ``small``.
    """
    w = Window.partitionBy("i").orderBy("s", "j")
    at = similarities.withColumn("__r", F.row_number().over(w) - 1)
    thr = at.where(F.col("__r") == nth).select("i", F.greatest("s", F.lit(least)).alias("__t"))
    keep = similarities.join(thr, "i").where("s >= __t").select("i", "j")
    keep = keep.unionByName(keep.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct().withColumn("__k", F.lit(True))
    out = similarities.join(keep, ["i", "j"], "left")
    return out.select("i", "j", F.when(F.col("__k"), F.col("s")).otherwise(F.lit(small)).alias("s"))
