"""Benchmark decontamination by SimHash over windows of an item's size.

A window can only be similar to an item if it holds one of the item's shingles, so windows are laid
around those alone. Each such window's fingerprint is looked up among the items of its size in four
tables from a block of sixteen bits to the items that have it. Fingerprints within RADIUS bits agree
on some block within its share of the radius, so the lookup misses none within it. What is within the
radius and shares a shingle is verified by the exact similarity of the weighted shingles. At similarity
0.8 the expected distance is 10 bits of 64, with a deviation of 3, so a best window right at 0.8 lies
beyond the radius with chance 1e-5, and a likelier one less.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longweave.llm.common import as_bytes, small_batches, tidy, words_of
from longweave.llm.simhash import hashed, majority, shingles

K, THRESHOLD, RADIUS = 5, 0.8, 22
BLOCKS = 4
#: Items in a broadcast index; a larger benchmark is worked through in so many at a time.
INDEX_ITEMS = 20_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _rolled(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k successive word numbers; only proposes."""
    h = np.zeros(len(ids) - k + 1, dtype=np.uint64)
    for i in range(k):
        h = (h ^ ids[i : i + len(h)]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of the lesser over sum of the greater weights; a shingle weighs as often as it occurs."""
    both = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


class Buckets:
    """Fingerprints by their blocks: for each block the sorted values that occur, and the items that have them."""

    def __init__(self, fp: np.ndarray, radius: int) -> None:
        self.fp, self.radius = fp, radius
        spare = radius + 1 - BLOCKS  # shares t of the blocks with sum(t + 1) > radius
        self.shares = [spare // BLOCKS + (b < spare % BLOCKS) for b in range(BLOCKS)]
        self.tables = []
        for column in fp.view(np.uint16).reshape(len(fp), BLOCKS).T:
            order = np.argsort(column, kind="stable")
            value, first = np.unique(column[order], return_index=True)
            self.tables.append((value, np.append(first, len(fp)), order))

    def candidates(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``fp``, item) of pairs that agree within its share on some block."""
        found = []
        for (value, first, order), column, share in zip(self.tables, np.ascontiguousarray(fp).view(np.uint16).reshape(len(fp), BLOCKS).T, self.shares, strict=True):
            own, at = np.unique(column, return_inverse=True)
            x, y = np.nonzero(np.bitwise_count(own[:, None] ^ value[None, :]) <= share)
            near = np.split(y, np.searchsorted(x, np.arange(1, len(own))))  # values near each own value
            items = [np.concatenate([order[first[v] : first[v + 1]] for v in vs]) if len(vs) else np.zeros(0, np.int64) for vs in near]
            size = np.array([len(v) for v in items])[at]
            if size.sum():
                found.append(np.repeat(np.arange(len(fp)), size) * len(self.fp) + np.concatenate([items[v] for v in at]))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs // len(self.fp), pairs % len(self.fp)

    def within(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that are within the radius."""
        q, i = self.candidates(fp)
        ok = np.bitwise_count(fp[q] ^ self.fp[i]) <= self.radius
        return q[ok], i[ok]


class Index:
    """Items by their number of words, with their shingles and the buckets of their fingerprints."""

    def __init__(self, items: list[tuple[int, bytes | None]], k: int = K, radius: int = RADIUS) -> None:
        self.k = k
        self.vocab: dict[bytes, int] = {}
        seeds: dict[int, tuple[list, list]] = {}
        sizes: dict[int, list] = {}
        where = []  # for each item with words, in order: its size and its place among those of that size
        for item, text in sorted(items):
            w = words_of(text)
            if not w:
                continue
            s = shingles(w, k)
            ids = np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], dtype=np.uint64)
            at = seeds.setdefault(min(k, len(w)), ([], []))
            h = np.unique(_rolled(ids, min(k, len(w))))
            own = sizes.setdefault(len(w), [])
            at[0].append(h)
            at[1].append(np.full(len(h), len(where)))
            where.append((len(w), len(own)))
            own.append((item, majority(hashed(s)), Counter(s)))
        self.where = np.array(where, dtype=np.int64).reshape(-1, 2)
        self.seeds = {}
        for n, (h, item) in seeds.items():
            h, item = np.concatenate(h), np.concatenate(item)
            order = np.argsort(h, kind="stable")
            self.seeds[n] = (h[order], item[order])
        self.sizes = {n: ([x[0] for x in own], Buckets(np.array([x[1] for x in own], dtype=np.uint64), radius), [x[2] for x in own]) for n, own in sizes.items()}
        self.windows = self.verified = 0

    def hits(self, text: bytes | None, threshold: float = THRESHOLD) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window of each item that the text holds."""
        w = words_of(text)
        if not w:
            return []
        ids = np.fromiter(map(self.vocab.get, w, repeat(0)), np.uint64, len(w))
        if not ids.any():
            return []
        best: dict[int, tuple[float, int, int]] = {}
        known = ids > 0
        for k, (seed, item) in self.seeds.items():
            if len(w) < k:
                continue
            whole = np.ones(len(w) - k + 1, dtype=bool)
            for i in range(k):
                whole &= known[i : i + len(whole)]
            at = np.nonzero(whole)[0]
            if not len(at):
                continue
            h = _rolled(ids, k)[at]
            lo, hi = np.searchsorted(seed, h, "left"), np.searchsorted(seed, h, "right")
            if not (hi > lo).any():
                continue
            place = np.repeat(at, hi - lo)
            mine = np.concatenate([item[a:b] for a, b in zip(lo, hi, strict=True) if b > a])
            size, own = self.where[mine].T
            for n in np.unique(size).tolist():
                self._windows(w, n, place[size == n], own[size == n], threshold, best)
        return [(item, *x) for item, x in sorted(best.items())]

    def _windows(self, w: list[bytes], n: int, place: np.ndarray, own: np.ndarray, threshold: float, best: dict) -> None:
        """All windows of n words that hold a shingle of an item (``own``, at ``place``)."""
        if len(w) < n:
            return
        k = min(self.k, n)
        per = n - k + 1
        items, buckets, weights = self.sizes[n]
        seeded = {i: np.sort(place[own == i]) for i in np.unique(own).tolist()}
        starts = np.zeros(len(w) - n + 2, dtype=np.int64)
        np.add.at(starts, np.clip(place - per + 1, 0, len(starts) - 1), 1)
        np.add.at(starts, np.clip(place + 1, 0, len(starts) - 1), -1)
        starts = np.nonzero(np.cumsum(starts[:-1]) > 0)[0]
        for run in np.split(starts, np.nonzero(np.diff(starts) > 1)[0] + 1):
            for lo in range(0, len(run), 4096):
                part = run[lo : lo + 4096]
                if not len(part):
                    continue
                first = int(part[0])
                s = shingles(w[first : int(part[-1]) + n], k)
                bits = np.unpackbits(hashed(s).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                total = np.vstack([np.zeros((1, 64), np.int64), np.cumsum(bits, axis=0, dtype=np.int64)])
                ones = total[per:] - total[:-per]
                fp = np.packbits(2 * ones > per, axis=1, bitorder="little").view(np.uint64).ravel()
                self.windows += len(fp)
                q, i = buckets.within(fp)
                kept: dict[int, Counter] = {}
                for a, b in zip(q.tolist(), i.tolist(), strict=True):
                    at = seeded.get(b)
                    if at is None or (j := int(np.searchsorted(at, first + a))) == len(at) or at[j] >= first + a + per:
                        continue  # no shingle of this item in the window
                    self.verified += 1
                    got = kept.get(a)
                    if got is None:
                        got = kept[a] = Counter(s[a : a + per])
                    sim = weighted_similarity(got, weights[b])
                    if sim >= threshold - 1e-12 and sim > best.get(items[b], (0.0,))[0]:
                        best[items[b]] = (sim, first + a, n)


def _indexes(benchmark: DataFrame):
    """Broadcast indexes of up to INDEX_ITEMS items or so, one after the other."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    blocks = max(1, -(-items.count() // INDEX_ITEMS))
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else items
        yield benchmark.sparkSession.sparkContext.broadcast(Index([(r["item_id"], bytes(r["text"])) for r in own.collect()]))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words): each item that a row's text holds, with its best window.

    Words are split at ASCII white space, A-Z in lower case; items shorter than K words are one shingle
    as a whole, and items without words are in no text. Of windows alike the first counts. The index
    holds up to INDEX_ITEMS items and is broadcast; a larger benchmark is taken in blocks, a pass for
    each. Null and empty texts hold nothing. Repeated rows give repeated hits; a null doc_id stays null;
    rows of ``benchmark`` without an id are left out; other columns are not read.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, similarity double, start long, n_words long"
    out = None
    for index in _indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True) for hit in index.value.hits(t, threshold)]
                cols = zip(*rows, strict=True) if rows else [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "similarity", "start", "n_words"])

        found = texts.mapInArrow(tidy(run), schema)
        out = found if out is None else out.unionByName(found)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text holds an item; others stay as they are, without a shuffle.

    Null, empty and very long texts are judged like any other, repeated rows alike; columns may have any
    names but ``text``; an empty table or benchmark changes nothing.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for index in _indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not index.value.hits(t, threshold) for t in as_bytes(batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
