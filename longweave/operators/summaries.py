"""Counts, shares and small reports of nodes, reads and contigs; each is one aggregate with sums on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_counts(nodes: DataFrame) -> DataFrame:
    """(chunk, n): how often each chunk occurs."""
    return nodes.groupBy("chunk").agg(F.count("*").alias("n"))


def pileups(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """(key, n, xs): what belongs to each key, as structs of ``order`` in that order. For keys of bounded size."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(*order))).alias("xs"))


def column_gains(cells: DataFrame, least: float = 1e-5) -> DataFrame:
    """(col, gain, positive): sum and number of the cells (col, x) above ``least``."""
    return cells.where(F.col("x") > least).groupBy(F.col("col").cast("long").alias("col")).agg(F.sum("x").alias("gain"), F.count("*").alias("positive"))


def longest_and_histogram(reads: DataFrame, length: str, key: str, top: int = 20, width: int = 1000) -> DataFrame:
    """(what, value, n): the ``top`` greatest lengths, the least key first on ties, and how many reads each bin of ``width`` holds."""
    first = reads.orderBy(F.desc(length), key).limit(top).groupBy(length).agg(F.count("*").alias("n")).select(F.lit("top").alias("what"), F.col(length).alias("value"), "n")
    bins = reads.groupBy(F.floor(F.col(length) / width).alias("value")).agg(F.count("*").alias("n")).select(F.lit("bin").alias("what"), "value", "n")
    return first.unionByName(bins)


def encoding_stats(reads: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: reads without nodes, nodes, and the share of what reads span that nodes cover."""
    e = nodes.groupBy("read_id").agg(F.count("*").alias("n"), F.sum("len").alias("covered"), (F.max(F.col("pos") + F.col("len")) - F.min("pos")).alias("length"))
    j = reads.select("read_id").join(e, "read_id", "left")
    return j.agg(F.count(F.when(F.col("n").isNull(), 1)).alias("gap_reads"), F.sum("n").alias("nodes"), (F.sum("covered") / F.sum("length")).alias("rate"))


def occupancy(counts: DataFrame) -> DataFrame:
    """One row: least and most of (chunk, n) with their chunks, the greater chunk on ties of the most, and the mean."""
    key = F.struct("n", "chunk")
    return counts.agg(F.min("n").alias("least"), F.min_by("chunk", key).alias("least_chunk"), F.max("n").alias("most"), F.max_by("chunk", key).alias("most_chunk"), F.avg("n").alias("mean"))


def length_stats(df: DataFrame, length: Column) -> DataFrame:
    """One row: how many, their bases, and the whole part of the mean."""
    return df.select(length.cast("long").alias("x")).agg(F.count("*").alias("n"), F.sum("x").alias("bases"), F.expr("sum(x) div count(*)").alias("mean"))


def haplotype_counts(df: DataFrame, keys: list[str], first: Column) -> DataFrame:
    """(keys, hap1, hap2, purity): rows for which ``first`` holds and doesn't, and the share of the more frequent kind."""
    g = df.groupBy(*keys).agg(F.count(F.when(first, 1)).alias("hap1"), F.count(F.when(~first, 1)).alias("hap2"))
    return g.withColumn("purity", F.greatest("hap1", "hap2") / (F.col("hap1") + F.col("hap2")))


def contig_tags(members: DataFrame, occ: str = "occ", copies: str = "copies", name: str = "name") -> DataFrame:
    """(contig, mean_occ, copies, members): tags of each contig from its members."""
    return members.groupBy("contig").agg(F.floor(F.avg(occ)).alias("mean_occ"), F.round(F.avg(copies)).cast("long").alias("copies"), F.array_join(F.sort_array(F.collect_set(F.col(name).cast("string"))), ",").alias("members"))


def pileup_coverage(nodes: DataFrame, part: int = 5, most: int = 2) -> DataFrame:
    """(chunk, mean, thr): the whole part of the mean length, and a ``part`` of it but ``most`` at most."""
    g = nodes.groupBy("chunk").agg(F.expr("sum(len) div count(*)").alias("mean"))
    return g.withColumn("thr", F.least(F.expr(f"mean div {int(part)}"), F.lit(most)))


def insertion_offsets(nodes: DataFrame, least: int = 3) -> DataFrame:
    """(chunk, cluster, is_forward, n, mean_offset): nodes that ``least`` places or more have, with the whole part of their mean gap."""
    g = nodes.groupBy("chunk", "cluster", "is_forward").agg(F.count("*").alias("n"), F.expr("sum(gap) div count(*)").alias("mean_offset"))
    return g.where(F.col("n") >= least)


def with_alignments(reads: DataFrame, alignments: DataFrame, read: str, query: str) -> DataFrame:
    """Reads with their alignments; those without any drop out."""
    return reads.join(alignments, reads[read] == alignments[query])


def encoded_lengths(reads: DataFrame, nodes: DataFrame) -> DataFrame:
    """(read_id, nodes, len): reads with nodes, how many, and the raw length."""
    n = nodes.groupBy("read_id").agg(F.count("*").alias("nodes"))
    return n.join(reads.select("read_id", F.length("seq").cast("long").alias("len")), "read_id")


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` isn't among ``ids``."""
    return df.join(ids.select(key), key, "left_anti")


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is among ``ids``."""
    return df.join(ids.select(key), key, "left_semi")


def last_nodes(nodes: DataFrame) -> DataFrame:
    """(read_id, chunk, is_forward) of each read's last node."""
    return nodes.groupBy("read_id").agg(F.max_by(F.struct("chunk", "is_forward"), "idx").alias("x")).select("read_id", "x.*")


def tip_counts(nodes: DataFrame, least: int = 2) -> DataFrame:
    """(chunk, is_forward, n): last nodes that ``least`` reads or more have."""
    return last_nodes(nodes).groupBy("chunk", "is_forward").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def best_cluster(nodes: DataFrame) -> DataFrame:
    """(chunk, cluster, n): each chunk's most frequent cluster, the greater on ties."""
    n = nodes.groupBy("chunk", "cluster").agg(F.count("*").alias("n"))
    return n.groupBy("chunk").agg(F.max(F.struct("n", "cluster")).alias("best")).select("chunk", "best.cluster", "best.n")


def nearly_contained(nodes: DataFrame, most: int = 0) -> DataFrame:
    """(a, b): reads a < b of which b has all of a's chunks but for ``most``, and at least one."""
    c = nodes.select("read_id", "chunk").distinct()
    size = c.groupBy(F.col("read_id").alias("a")).agg(F.count("*").alias("size"))
    both = c.withColumnRenamed("read_id", "a").join(c.withColumnRenamed("read_id", "b"), "chunk").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    return both.join(size, "a").where(F.col("size") - F.col("both") <= most).select("a", "b")


def reset_labels(nodes: DataFrame) -> DataFrame:
    """``nodes`` with all in cluster 0."""
    return nodes.withColumn("cluster", F.lit(0).cast("long"))


def in_range(features: DataFrame, at: str, first: int, last: int) -> DataFrame:
    """Features from ``first`` to ``last``, with ``at`` counted from the first."""
    return features.where(F.col(at).between(first, last)).withColumn(at, F.col(at) - first)


def in_regions(rows: DataFrame, regions: DataFrame, key: str, at: str) -> DataFrame:
    """Rows with the region (key, first, last) of their key that they lie in; Spark broadcasts the regions while they are small."""
    return rows.join(regions, key).where(F.col(at).between(F.col("first"), F.col("last")))


def by_haplotype(reads: DataFrame, tags: DataFrame, key: str, tag: str, haplotypes: int = 2) -> DataFrame:
    """Reads with ``hap`` from 1; those without a tag go to all haplotypes."""
    everywhere = F.array(*[F.lit(i + 1) for i in range(haplotypes)])
    haps = F.when(F.col(tag).isNull(), everywhere).otherwise(F.array((F.col(tag) + 1).cast("int")))
    return reads.join(tags.select(key, tag), key, "left").withColumn("hap", F.explode(haps)).drop(tag)


def bases_by(contigs: DataFrame, key: Column, length: Column) -> DataFrame:
    """(cp, n, bases): contigs and their bases by a key such as the copy number."""
    return contigs.groupBy(key.alias("cp")).agg(F.count("*").alias("n"), F.sum(length.cast("long")).alias("bases"))


def cumulative_share(df: DataFrame, key: str, length: str, order: str) -> DataFrame:
    """``df`` with ``share``: of all bases of its key, what contigs of this length or more hold."""
    w = Window.partitionBy(key)
    upto = w.orderBy(F.desc(length), order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("share", F.sum(length).over(upto) / F.sum(length).over(w))
