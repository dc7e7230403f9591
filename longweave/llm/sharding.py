"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets split.

Rows are summed into cells of STEP more prefix bits at a time; the bit by bit splits of a round are
worked out on the cells' sums, and only rows of buckets that are still too large go into the next round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longweave.llm.common import fresh
from longweave.session import saved

#: Bits of the hash, and bits that a round looks at. A round's sums are at most 2**STEP for a bucket.
BITS, STEP = 60, 10
LIMIT = 1 << 20
#: Directory rows of a round up to which they are broadcast.
BROADCAST_ROWS = 200_000


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_bytes): 60 bits of a hash of id and text, and the text's bytes in UTF-8."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long").alias("h"), F.octet_length(text).cast("long").alias("n_bytes"))


def _prefix(h: str, depth) -> F.Column:
    return F.expr(f"shiftright({h}, {BITS} - {depth})")


def assigned(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, depth, prefix, shard, shard_bytes, oversized.

    ``shard`` spells the prefix in bits ('' is the only shard of a small table). A bucket splits while
    it has more than ``limit`` bytes and more than one hash. What can't split any more, one text above
    the limit or repeated equal rows, is ``oversized``. Null texts have no bytes; null ids hash as
    empty; repeated rows share a shard; an empty table gives no rows; other columns are not read.
    """
    left = saved(keyed(docs), "keys")
    done = []
    for at in range(0, BITS, STEP):
        to = at + STEP
        cells = saved(left.groupBy(_prefix("h", to).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.min("h").alias("lo"), F.max("h").alias("hi")), "cells")
        depths = F.explode(F.sequence(F.lit(at), F.lit(to))).alias("depth")
        by = cells.select("*", depths).withColumn("prefix", F.expr(f"shiftright(cell, {to} - depth)"))
        sums = by.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi")) | (F.col("depth") == BITS))
        leaf = by.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"])
        leaf = leaf.groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("leaf"))
        leaf = saved(leaf, "directory")
        found = F.broadcast(leaf) if leaf.count() <= BROADCAST_ROWS else leaf
        rows = left.withColumn("cell", _prefix("h", to)).join(found, "cell", "left")
        done.append(rows.where("leaf IS NOT NULL").select("doc_id", "n_bytes", "leaf.*"))
        if leaf.count() == cells.count():
            break
        left = saved(rows.where("leaf IS NULL").select("doc_id", "h", "n_bytes"), "keys")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return out.select("doc_id", "n_bytes", F.col("depth").cast("int").alias("depth"), "prefix", bits.alias("shard"), F.col("shard_bytes").cast("long").alias("shard_bytes"), (F.col("shard_bytes") > limit).alias("oversized"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write whole rows of ``docs`` below ``path``, a folder ``shard=<bits>`` for each shard ('root' if there is one)."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    where = assigned(docs, limit).select("depth", "prefix", F.when(F.col("shard") == "", "root").otherwise(F.col("shard")).alias("shard")).distinct()
    where = saved(where, "shards")
    few = where.count() <= BROADCAST_ROWS
    h = F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")
    at, prefix, found = *fresh(docs, "__lw_h", "__lw_prefix"), []
    rows = docs.drop("shard").withColumn(at, h)
    for depth in sorted(r[0] for r in where.select("depth").distinct().collect()):  # BITS + 1 depths at most; a row is in one shard
        name = fresh(rows, f"__lw_s{depth}")[0]
        own = where.where(F.col("depth") == depth).select(F.col("prefix").alias(prefix), F.col("shard").alias(name))
        rows = rows.join(F.broadcast(own) if few else own, F.expr(f"shiftright(`{at}`, {BITS} - {depth})") == F.col(prefix), "left").drop(prefix)
        found.append(name)
    if not found:
        return
    rows = rows.withColumn("shard", F.coalesce(*found)).drop(at, *found)
    rows.repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(8))).write.partitionBy("shard").parquet(path)


SQL = f"""
WITH doc AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, {BITS // 4}) AS BIGINT) AS h FROM documents),
spread AS (SELECT doc_id, n_bytes, h, depth, h >> ({BITS} - depth) AS prefix FROM doc, (SELECT CAST(unnest(range({BITS + 1})) AS INTEGER) AS depth)),
bucket AS (SELECT depth, prefix, sum(n_bytes) AS shard_bytes FROM spread GROUP BY depth, prefix HAVING sum(n_bytes) <= {LIMIT} OR min(h) = max(h) OR depth = {BITS}),
pick AS (SELECT doc_id, h, n_bytes, min(struct_pack(d := depth, p := prefix, b := shard_bytes)) AS leaf FROM spread JOIN bucket USING (depth, prefix) GROUP BY doc_id, h, n_bytes)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, leaf.d AS depth, leaf.p AS prefix, CASE WHEN leaf.d = 0 THEN '' ELSE lpad(bin(leaf.p), leaf.d, '0') END AS shard, CAST(leaf.b AS BIGINT) AS shard_bytes, leaf.b > {LIMIT} AS oversized FROM pick
"""
