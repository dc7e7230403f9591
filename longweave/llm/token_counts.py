"""Token counts without a shuffle: a broadcast table of frequent pre-tokens, then workers' caches.

BPE works inside pre-tokens, so a text's count is the sum over its pre-tokens. Those that are
frequent are looked up in a compact table that goes to every worker once; the rest are encoded by the
library and kept in the worker's cache. No pre-token ever leaves the task that reads it.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longweave.llm.common import small_batches, tidy
from longweave.session import drop_saved, saved

#: Entries of the broadcast table. It only saves encoding: what it holds changes no count.
TABLE_ENTRIES = 65_536
#: Words that a task's summary holds; beyond that the rarer half of them is forgotten.
SUMMARY_WORDS = 300_000
#: Pre-tokens that a worker keeps besides the table.
CACHE_ENTRIES = 400_000
#: Characters of the longest pre-token that a worker keeps.
LONGEST_KEPT = 200
#: Byte-level pre-tokens; fixed by the format of the tokenizer file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _loaded(path: str):
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("counts by pre-token are proven for byte-level tokenizers without a normalizer only")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that take in what stands beside them aren't supported")
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok, [t["content"] for t in spec["added_tokens"]]


class Lengths(dict):
    """Tokens of each pre-token; a missing one is encoded and kept, within CACHE_ENTRIES."""

    def __init__(self, tok, table: dict[str, int]) -> None:
        super().__init__(table)
        self.tok, self.table, self.misses = tok, table, 0

    def __missing__(self, pre: str) -> int:
        n = len(self.tok.encode_batch_fast([pre], add_special_tokens=False)[0].ids)
        self.misses += 1
        if len(pre) > LONGEST_KEPT:
            return n
        if len(self) >= len(self.table) + CACHE_ENTRIES:
            self.clear()
            self.update(self.table)
        self[pre] = n
        return n


class Counts:
    """Counts tokens of whole texts like the tokenizer at ``path``."""

    def __init__(self, path: str, table: dict[str, int] | None = None) -> None:
        tok, special = _loaded(path)
        self.lengths = Lengths(tok, table or {})
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pre = regex.compile(PATTERN)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        find, length = self.pre.findall, self.lengths.__getitem__
        return len(parts) - 1 + sum(sum(map(length, find(p))) for p in parts)


class Summary:
    """Counts of the words that follow a space, in bounded memory."""

    def __init__(self, most: int = SUMMARY_WORDS) -> None:
        self.n, self.most, self.total = Counter(), most, 0

    def add(self, counts: dict[str, int], total: int) -> None:
        self.total += total
        self.n.update(counts)
        if len(self.n) > self.most:
            self.n = Counter(dict(self.n.most_common(self.most // 2)))

    def row(self) -> pa.RecordBatch:
        """One row with what makes up TABLE_ENTRIES'th of all words or more, so that many entries at most.

        A word that is so frequent in the corpus is so in some part of it.
        """
        some = [(w, n) for w, n in self.n.items() if n * TABLE_ENTRIES >= self.total and len(w) <= LONGEST_KEPT]
        columns = [pa.array([[w for w, _ in some]], pa.list_(pa.string())), pa.array([[n for _, n in some]], pa.list_(pa.int64())), pa.array([self.total], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["words", "n", "total"])


def frequent_lengths(docs: DataFrame, tokenizer: str) -> dict[str, int]:
    """The table: the most frequent pre-tokens of all texts, with their tokens.

    Each task sums the words that it reads in a bounded summary and hands on one row; rows are merged by
    executors down to the square root of their number before the driver merges those. No pre-token is
    shuffled. Words are taken apart into pre-tokens at the end.
    """
    schema = "words array<string>, n array<long>, total long"

    def count(batches):
        own = Summary()
        for batch in batches:
            words = [w for t in batch.column(0).to_pylist() if t for w in t.split(" ")[1:]]
            own.add(Counter(words), len(words))
        yield own.row()

    def merge(batches):
        own = Summary()
        for batch in batches:
            for words, n, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own.add(dict(zip(words, n, strict=True)), total)
        yield own.row()

    parts = saved(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(count), schema), "summaries")
    several = max(1, isqrt(parts.count()))
    all_ = Summary(4 * TABLE_ENTRIES)
    for r in parts.repartition(several).mapInArrow(merge, schema).toLocalIterator():
        all_.add(dict(zip(r["words"], r["n"], strict=True)), r["total"])
    drop_saved(parts)
    tok, _ = _loaded(tokenizer)
    pre, got = regex.compile(PATTERN), Counter()
    for w, n in all_.n.items():
        for p in pre.findall(" " + w):
            got[p] += n
    pres = [p for p, _ in sorted(got.items(), key=lambda x: (-x[1], x[0]))[:TABLE_ENTRIES]]
    return {p: len(e.ids) for p, e in zip(pres, tok.encode_batch_fast(pres, add_special_tokens=False), strict=True)} if pres else {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Special strings inside texts count as one token each, as the library has it by default. Null and
    empty texts count zero. Repeated rows and null doc_ids stay; an empty table gives no rows; other
    columns are not read.
    """
    small_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counts(tokenizer, table.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [count(t) for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
