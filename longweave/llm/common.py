"""What the operators of this subpackage share: reading tables, folds, words, stripes and forests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longweave.session import saved

#: Rows and bytes in an Arrow batch that goes to a Python worker; they bound a worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores after them as it takes for ``df`` to have no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def small_batches(spark: SparkSession) -> None:
    """Hand long texts to Python in small Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def tidy(run):
    """``run`` over Arrow batches, giving memory back when its task ends.

    Spark keeps Python workers for later tasks and stages, and what a stage's caches took would stay
    with the worker otherwise.
    """

    def own(batches):
        try:
            yield from run(batches)
        finally:
            released()

    return own


def released() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: memory is given back when it likes


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: bytes | str | None) -> list[bytes]:
    """The words of a text in UTF-8, with A-Z in lower case; only the six ASCII spaces split words."""
    if isinstance(text, str):
        text = text.encode("utf-8", "surrogatepass")
    return text.lower().split() if text else []


def as_bytes(column) -> list[bytes | None]:
    """The texts of an Arrow string column as UTF-8, without a round trip through str."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def forest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Indices of the edges of a minimum spanning forest over nodes 0..n-1; least ``d`` first.

    Ties go to the earlier edge, so keys are unique and rounds of picking each tree's least edge
    can't make a cycle.
    """
    root, chosen = np.arange(n), []
    order = np.argsort(d, kind="stable")
    a, b = a[order], b[order]
    idx = np.arange(len(a))
    while True:
        ra, rb = root[a], root[b]
        live = ra != rb
        if not live.any():
            break
        a, b, idx, ra, rb = a[live], b[live], idx[live], ra[live], rb[live]
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, ra, idx)
        np.minimum.at(best, rb, idx)
        pick = np.unique(best[best < np.iinfo(np.int64).max])
        chosen.append(pick)
        at = np.searchsorted(idx, pick)
        x, y = ra[at], rb[at]
        up = np.arange(n)
        while True:  # flatten the picked edges onto the least root of each tree
            lx, ly = up[x], up[y]
            if (lx == ly).all():
                break
            np.minimum.at(up, np.maximum(lx, ly), np.minimum(lx, ly))
            while (up != up[up]).any():
                up = up[up]
        root = up[root]
    return order[np.concatenate(chosen)] if chosen else np.zeros(0, dtype=np.int64)


#: Ids up to which a list of them is broadcast, 8 bytes each and about as much again for the hash table.
BROADCAST_IDS = 4_000_000


def beside(ids: DataFrame) -> DataFrame:
    """``ids`` (saved, one long column) marked for a broadcast join if they are within BROADCAST_IDS.

    What they are joined with then needs no shuffle; beyond the bound Spark joins by shuffle.
    """
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def merged(counts: list[int], rows: int) -> list[list[int]]:
    """Runs of neighbouring parts that have about ``rows`` rows together; one part if it has more."""
    out: list[list[int]] = []
    size = rows
    for at, n in enumerate(counts):
        if size + n > rows:
            out.append([])
            size = 0
        out[-1].append(at)
        size += n
    return out


#: Entries (cell, stripe) up to which the table of cells is broadcast, 16 bytes each.
BROADCAST_CELLS = 1_000_000


def dealt_to_cells(parts: DataFrame, members: list[list[int]], low: np.ndarray, high: np.ndarray, near) -> tuple[DataFrame, int]:
    """(each row once for every cell, a pair of stripes, that it takes part in; the number of cells).

    members: the parts of each stripe; low, high: a row of bounds for each stripe. Stripes s <= t make a
    cell if ``near(low_s, high_s, lows, highs)`` holds. Executors test the pairs, a row of stripes at a
    time, so the driver holds the stripes alone. Adds ``cell`` and ``side`` (0: first stripe of the
    cell, 1: second, 2: both are the same); column ``part`` goes.
    """
    import pyarrow as pa

    spark, n = parts.sparkSession, len(members)
    boxes = spark.sparkContext.broadcast((low, high))

    def paired(batches):
        lows, highs = boxes.value
        for batch in batches:
            stripe, cell, side = [], [], []
            for s in batch.column(0).to_pylist():
                t = s + np.nonzero(near(lows[s], highs[s], lows[s:], highs[s:]))[0]
                other = t[t != s]
                stripe += [np.full(len(t), s), other]
                cell += [s * n + t, s * n + other]
                side += [np.where(t == s, 2, 0), np.ones(len(other), np.int64)]
            cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cat(x)) for x in (stripe, cell, side)], ["stripe", "cell", "side"])

    tasks = max(1, min(n, 4 * spark.sparkContext.defaultParallelism))
    cells = saved(spark.range(0, n, 1, tasks).mapInArrow(paired, "stripe long, cell long, side long"), "cells")
    entries, total = cells.agg(F.count("*"), F.count(F.when(F.col("side") != 1, 1))).first()
    of_part = spark.createDataFrame([(p, s) for s, own in enumerate(members) for p in own] or [(-1, -1)], "part int, stripe long")
    cells = cells.groupBy("stripe").agg(F.collect_list(F.struct("cell", "side")).alias("c"))
    own = parts.join(F.broadcast(of_part), "part").join(F.broadcast(cells) if entries <= BROADCAST_CELLS else cells, "stripe")
    return own.withColumn("c", F.explode("c")).select("*", "c.cell", F.col("c.side").cast("int").alias("side")).drop("c", "part", "stripe"), total
