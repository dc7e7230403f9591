"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longweave.llm.common import held_out, small_batches, tidy

#: Buckets of the hashed n-grams, and the n-grams' lengths.
BUCKETS, ORDERS = 1 << 16, (1, 2, 3)
#: About so many documents of each language are learned from, by a hash of their id.
TRAIN_DOCS = 5000
#: Characters scored at once.
SLICE = 100_000

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters; made once in a worker."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text with a space for each run of what is no letter."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    ok = letters()[np.minimum(x, 0x10FFFF)]
    x = np.where(ok, x, np.uint32(32))
    keep = ok.copy()
    keep[1:] |= ok[:-1]  # the first of each run of others
    keep[:1] = ok[:1]
    return x[keep]


def grams(x: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a sequence of code points, one array for each order."""
    for n in ORDERS:
        if len(x) < n:
            continue
        h = np.full(len(x) - n + 1, n, dtype=np.uint32)
        for i in range(n):
            h = (h ^ x[i : i + len(h)]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        yield (h & np.uint32(BUCKETS - 1)).astype(np.int32)


def trained(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities by bucket and language, with the priors in the last row).

    Learns from text and non-null lang of rows that aren't held out. Of a language with more than
    ``train_docs`` such rows, those with the smallest hashes of their id are taken, about so many;
    the priors come from all of them.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(n)
    if not langs:
        return [], np.zeros((BUCKETS + 1, 0), dtype=np.float32)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, train_docs / n[k])))])
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("text", "lang")

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.setdefault(g, np.zeros(BUCKETS, dtype=np.int64))
                for b in grams(codes(t)):
                    u, c = np.unique(b, return_counts=True)
                    total[g][u] += c
        for g, c in total.items():
            at = np.nonzero(c)[0]
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "bucket", "n"])

    counts = np.zeros((BUCKETS, len(langs)))
    at = {k: i for i, k in enumerate(langs)}
    for r in some.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["bucket"], at[r["lang"]]] = r["n"]
    logp = np.log(counts + 0.5) - np.log(counts.sum(axis=0) + 0.5 * BUCKETS)
    prior = np.log(np.array([n[k] for k in langs], dtype=float) / sum(n.values()))
    return langs, np.vstack([logp, prior]).astype(np.float32)


def scores(text: str | None, logp: np.ndarray) -> np.ndarray | None:
    """Log-probabilities of the languages; None without a letter."""
    x = codes(text) if text else np.zeros(0, np.uint32)
    if not len(x):
        return None
    s = logp[-1].astype(np.float64)
    for g in grams(x):
        for i in range(0, len(g), SLICE):
            b = g[i : i + SLICE]
            if len(b) > 4096:  # many n-grams fall together: weigh each bucket once
                c = np.bincount(b, minlength=BUCKETS)
                u = np.nonzero(c)[0]
                s += c[u] @ logp[u].astype(np.float64)
            else:
                s += logp[b].sum(axis=0, dtype=np.float64)
    return s


def batch_scores(texts: list[str | None], logp: np.ndarray) -> np.ndarray:
    """Log-probabilities of the languages for each text, a row each; NaN for texts without a letter.

    A batch is a sparse matrix of texts by buckets, whose entries are met in order of the texts, in
    parts of about SLICE entries; longer texts go one by one.
    """
    out = np.full((len(texts), logp.shape[1]), np.nan)
    own = [codes(t) if t else np.zeros(0, np.uint32) for t in texts]
    at = [i for i, x in enumerate(own) if len(x)]
    lo = 0
    while lo < len(at):
        hi, size = lo, 0
        while hi < len(at) and (hi == lo or size + len(own[at[hi]]) <= SLICE):
            size += len(own[at[hi]])
            hi += 1
        part = at[lo:hi]
        if len(part) == 1:
            out[part[0]] = scores(texts[part[0]], logp)
        else:
            x, row = np.concatenate([own[i] for i in part]), np.repeat(np.arange(len(part)), [len(own[i]) for i in part])
            sums = np.tile(logp[-1].astype(np.float64), (len(part), 1))
            for n, bucket in zip(ORDERS, grams(x), strict=False):
                of = row[: len(bucket)]
                inside = of == row[n - 1 :]  # n-grams that cross texts don't count
                bucket, of = bucket[inside], of[inside]
                first = np.searchsorted(of, np.arange(len(part)))
                live = first < np.append(first[1:], len(of))
                if live.any():
                    sums[live] += np.add.reduceat(logp[bucket], first[live], axis=0, dtype=np.float64)
            out[part] = sums
        lo = hi
    return out


def identified(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (the language's posterior).

    ``und`` with score 0 for texts that are null or have no letter, and for all if no row can be
    learned from. Ties go to the first language by name. Repeated rows stay; a null doc_id isn't held
    out; an empty table gives no rows; columns other than doc_id, text and lang are not read. The
    model is languages by BUCKETS numbers, whatever the input's size.
    """
    small_batches(docs.sparkSession)
    langs, logp = trained(docs, train_docs)
    model = docs.sparkSession.sparkContext.broadcast(logp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = model.value
        for batch in batches:
            s = batch_scores(batch.column(2).to_pylist(), logp)
            if langs:
                none = np.isnan(s[:, 0])
                s[none] = 0.0
                best = s.argmax(axis=1)
                prob = np.where(none, 0.0, 1.0 / np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1))
                pred = ["und" if x else langs[k] for k, x in zip(best, none, strict=True)]
            else:
                pred, prob = ["und"] * len(s), np.zeros(len(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(prob, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")
