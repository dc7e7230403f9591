"""k-mer counts, the mask of repetitive k-mers, soft-masking, and how repetitive a read is.

k-mers are coded in numpy as two bits a base, first base in the low bits, the lesser of both strands;
what is no base is coded as A. Counts are summed by batch before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longweave.session import saved

from longweave.functions.stats import picked

_CODE = np.zeros(256, dtype=np.uint64)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i


def codes(seq: str | None, k: int) -> np.ndarray:
    """Canonical codes of all k-mers in order; 1 <= k <= 31."""
    if not 1 <= k <= 31:
        raise ValueError(f"k must lie between 1 and 31: {k}")
    x = _CODE[np.frombuffer((seq or "").encode("latin-1", "replace"), np.uint8)]
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    forward, back = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for i in range(k):
        forward |= x[i : i + n] << np.uint64(2 * i)
        back |= (np.uint64(3) - x[i : i + n]) << np.uint64(2 * (k - 1 - i))
    return np.minimum(forward, back)


def kmer_rows(df: DataFrame, k: int, key: str = "read_id") -> DataFrame:
    """(key, at, kmer): all k-mers of ``seq`` as text, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = max(0, len(s or "") - k + 1)
                yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array([s[j : j + k] for j in range(n)], pa.string())], [key, "at", "kmer"])

    return df.select(key, "seq").mapInArrow(run, f"{key} long, at int, kmer string")


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    """(kmer long, n): how often each canonical k-mer occurs in all reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [codes(s, k) for s in batch.column(0).to_pylist()]
            u, n = np.unique(np.concatenate(own) if own else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(n.astype(np.int64))], ["kmer", "n"])

    return reads.select("seq").mapInArrow(run, "kmer long, n long").groupBy("kmer").agg(F.sum("n").alias("n"))


def mask_threshold(counts: DataFrame, freq: float, least: int) -> int:
    """Count above which k-mers are masked; 0 if all that occur twice are.

    Of the k-mers that occur twice or more, the most frequent share ``freq`` is masked, but none that
    occurs ``least`` times or less, unless fewer than that share occur more often.
    """
    n = counts.where("n > 1").agg(F.count("*").alias("all"), F.coalesce(F.sum((F.col("n") <= least).cast("long")), F.lit(0)).alias("few")).first()
    at = int(np.floor(n["all"] * (1 - freq)))
    if at < n["few"] or n["all"] == n["few"]:
        return 0
    many = counts.where(F.col("n") > max(1, least)).select(F.col("n").alias("value"))
    return picked(many, "value", [], F.lit(at - n["few"])).first()[0]


def mask(reads: DataFrame, k: int, freq: float = 0.001, least: int = 10) -> DataFrame:
    """(kmer, n): the masked k-mers."""
    counts = saved(kmer_counts(reads, k), "kmers")
    above = mask_threshold(counts, freq, least)
    return counts.where(F.col("n") > max(1, above))


#: Masked k-mers up to which the mask is broadcast, 8 bytes each; beyond it reads and mask are joined.
BROADCAST_KMERS = 4_000_000


def repetitiveness(reads: DataFrame, masked: DataFrame, k: int) -> DataFrame:
    """(read_id, repetitiveness): masked k-mers that a read has twice or more, over all its k-mers."""
    size = F.greatest(F.length("seq") - k, F.lit(0)) + 1
    if masked.count() <= BROADCAST_KMERS:
        kept = reads.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in masked.select("kmer").toLocalIterator()], dtype=np.uint64)))

        def run(batches):
            for batch in batches:
                out = []
                for s in batch.column(1).to_pylist():
                    u, n = np.unique(codes(s, k), return_counts=True)
                    at = np.searchsorted(kept.value, u)
                    ok = (at < len(kept.value)) & (n > 1)
                    ok[ok] = kept.value[at[ok]] == u[ok]
                    out.append(int(n[ok].sum()) / (max(len(s or "") - k, 0) + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["read_id", "repetitiveness"])

        return reads.select("read_id", "seq").mapInArrow(run, "read_id long, repetitiveness double")

    def each(batches):
        for batch in batches:
            ids, kmer, count = [], [], []
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u, n = np.unique(codes(s, k), return_counts=True)
                u, n = u[n > 1], n[n > 1]
                ids.append(np.full(len(u), i))
                kmer.append(u.astype(np.int64))
                count.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (ids, kmer, count)], ["read_id", "kmer", "n"])

    twice = reads.select("read_id", "seq").mapInArrow(each, "read_id long, kmer long, n long")
    hits = twice.join(masked.select("kmer"), "kmer").groupBy("read_id").agg(F.sum("n").alias("hits"))
    return reads.join(hits, "read_id", "left").select("read_id", (F.coalesce("hits", F.lit(0)) / size).alias("repetitiveness"))


def soft_masked(reads: DataFrame, masked: DataFrame, k: int) -> DataFrame:
    """``reads`` with what masked k-mers cover in lower case.

    The mask is broadcast in blocks of BROADCAST_KMERS, a pass over the reads for each.
    """
    at = reads.columns.index("seq")
    blocks = max(1, -(-masked.count() // BROADCAST_KMERS))
    for block in range(blocks):
        own = masked.select("kmer") if blocks == 1 else masked.select("kmer").where(F.pmod(F.xxhash64("kmer"), F.lit(blocks)) == block)
        kept = reads.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in own.toLocalIterator()], dtype=np.uint64)))

        def run(batches, kept=kept):
            mask_ = kept.value
            for batch in batches:
                out = []
                for s in batch.column(at).to_pylist():
                    own = codes(s, k)
                    found = np.searchsorted(mask_, own)
                    hit = found < len(mask_)
                    hit[hit] = mask_[found[hit]] == own[hit]
                    cover = np.zeros(len(s or "") + 1, dtype=np.int64)
                    where = np.nonzero(hit)[0]
                    cover[where] += 1  # each place once
                    cover[where + k] -= 1
                    x = np.frombuffer((s or "").encode("latin-1", "replace"), np.uint8).copy()
                    x[np.cumsum(cover[:-1]) > 0] |= 0x20
                    out.append(x.tobytes().decode("latin-1") if s is not None else None)
                yield batch.set_column(at, "seq", pa.array(out, pa.string()))

        reads = reads.mapInArrow(run, reads.schema)
    return reads


def recovered_mask(reads: DataFrame, k: int) -> DataFrame:
    """(kmer): the canonical k-mers of windows that are in lower case throughout."""

    def run(batches):
        for batch in batches:
            found = []
            for s in batch.column(0).to_pylist():
                x = np.frombuffer((s or "").encode("latin-1", "replace"), np.uint8)
                low = ((x >= 97) & (x <= 122)).astype(np.int64)
                if len(low) >= k:
                    found.append(codes(s, k)[np.convolve(low, np.ones(k, np.int64), "valid") == k])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64))], ["kmer"])

    return reads.select("seq").mapInArrow(run, "kmer long").distinct()


def kmer_entropies(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, entropy): entropy in nats of a read's k-mer frequencies; 0 for a sequence shorter than k. Counted in place, without a shuffle."""

    def run(batches):
        for batch in batches:
            out = []
            for s in batch.column(1).to_pylist():
                x = np.frombuffer((s or "").encode("utf-32-le"), np.uint32)
                if len(x) < k:
                    out.append(0.0)
                    continue
                rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, k))
                n = np.unique(rows.view(np.dtype((np.void, 4 * k))).ravel(), return_counts=True)[1]
                out.append(float(np.log(n.sum()) - (n * np.log(n)).sum() / n.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["read_id", "entropy"])

    return reads.select("read_id", "seq").mapInArrow(run, f"read_id {dict(reads.dtypes)['read_id']}, entropy double")
