"""Toxicity by a subsequence string kernel, a support vector machine and Nyström landmarks.

The kernel compares two strings by the subsequences of three characters that they share, each weighed
down by the gaps it spans, so an insult with letters left out or characters put in between stays close
to the insult. A labelled sentence is a bag of strings: its words, runs of single letters, and short
words beside one another with the gap between them. It scores as its worst string and the document as
its worst sentence. Training goes from sentences to strings and back: the first machine takes as
bearers of the label the strings that are in more toxic sentences than chance explains and in hardly
any clean one, and all strings of clean sentences as clean; the second takes in the worst string of
each toxic document that the first one finds. Labels belong to documents, copies left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longweave.llm.bpe import Generations
from longweave.llm.common import held_out, small_batches, tidy, words_of
from longweave.llm.simhash import hashed, shingles
from longweave.session import drop_saved, saved

#: Labelled documents that are learned from, about so many of either label, by a hash of their id.
TOXIC_DOCS, CLEAN_DOCS = 4000, 12_000
#: Strings that training takes: bearers of the label, and clean ones.
BEARERS, CLEAN = 4000, 120_000
#: Clean strings that a machine is fitted on at once: the commonest, and those it errs on most.
FITTED = 12_000
LANDMARKS, RIDGE, POWER = 320, 1e-4, 0.5
#: Strings of either kind that landmarks are chosen among, and bearers that are taken where chance explains all.
POOL, FALLBACK = 800, 20
#: A subsequence's span in characters, and its loss of weight for each character of a gap.
SPAN, DECAY = 6, 0.6
#: Strings longer than this are met in windows, half overlapping.
LONGEST = 24
THRESHOLD = 0.3
#: Bytes that the strings whose score a worker keeps take in each of two generations, objects included.
CACHE = 40 << 20
#: Words whose margins are worked out at once.
MET = 4000

_SYMBOLS, _FEATURES = 64, 1 << 16
#: Digits and signs that stand for letters: fixed values.
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_EDGE = re.compile(r"^[^\w@$]+|[\W_]+$")
_SIGNS = re.compile(r"[\W_]+")
_SINGLES = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_SENTENCE = re.compile(r"[.!?]+(?=\s|$)|\n+")


def _symbol(c: str) -> int:
    """a-z, and signs that stand for one: 2 to 27; other letters share 28 to 62; the rest is 63."""
    c = _STANDS_FOR.get(c, c)
    if "a" <= c <= "z":
        return 2 + ord(c) - 97
    return 28 + ord(c) % 35 if c.isalpha() else 63


class _Symbols(dict):
    def __missing__(self, c: str) -> int:
        self[c] = n = _symbol(c)
        return n


_symbols = _Symbols()


def windows(unit: str) -> list[str]:
    """A string, or its half overlapping windows if it is long."""
    if len(unit) <= LONGEST:
        return [unit]
    return [unit[i : i + LONGEST] for i in range(0, len(unit) - LONGEST // 2, LONGEST // 2)]


#: Letters of the longest words that are met together with those beside them.
FRAGMENT = 3


def fragments(words: list[str]) -> set[str]:
    """Two or three short words beside one another as one string; a tab, which no word has, is the gap."""
    n = list(map(len, words))
    out, last = set(), len(words) - 2
    for i in [i for i, (x, y) in enumerate(zip(n, n[1:], strict=False)) if x <= FRAGMENT and y <= FRAGMENT]:
        two = n[i] + n[i + 1]
        if two > FRAGMENT:
            out.add(f"{words[i]}\t{words[i + 1]}")
        if i < last and n[i + 2] <= FRAGMENT and two + n[i + 2] > FRAGMENT:
            out.add(f"{words[i]}\t{words[i + 1]}\t{words[i + 2]}")
    return out


def strings(sentence: str) -> list[str]:
    """The strings of a sentence: its words without edging signs, runs of single letters joined, and short words together."""
    words = sentence.lower().split()
    out = [_EDGE.sub("", w) for w in (*words, *fragments(words))]
    out += ["".join(m[0].split()) for m in _SINGLES.finditer(sentence.lower())]
    return [u for u in out if len(u) > 2]


_TRIPLES: dict[int, tuple] = {}


def _triples(n: int) -> tuple:
    if n not in _TRIPLES:
        t = [(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN)) for k in range(j + 1, min(n, i + SPAN))]
        i, j, k = (np.array(x) for x in zip(*t, strict=True))
        _TRIPLES[n] = (i, j, k, (DECAY ** (k - i - 2)).astype(np.float32))
    return _TRIPLES[n]


def features(units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions in units, features, weights) for units of one length at a time; weights have norm 1.

    A string stands between marks for its start and end, symbols 0 and 1.
    """
    by: dict[int, list[int]] = {}
    for at, u in enumerate(units):
        by.setdefault(len(u), []).append(at)
    get = _symbols.__getitem__
    for n, ats in by.items():
        for lo in range(0, len(ats), 4096):
            at = ats[lo : lo + 4096]
            x = np.zeros((len(at), n + 2), dtype=np.int64)
            x[:, 1:-1] = np.array([list(map(get, units[a])) for a in at], dtype=np.int64)
            x[:, -1] = 1
            i, j, k, w = _triples(n + 2)
            f = (((x[:, i] * _SYMBOLS + x[:, j]) * _SYMBOLS + x[:, k]) * 40503 >> 4) & (_FEATURES - 1)
            order = np.argsort(f, axis=1)
            g, v = np.take_along_axis(f, order, 1), w[order]
            new = np.ones(g.shape, dtype=bool)
            new[:, 1:] = g[:, 1:] != g[:, :-1]
            starts = np.nonzero(new.ravel())[0]
            square = np.add.reduceat(v.ravel(), starts) ** 2
            row = starts // g.shape[1]
            norm = np.sqrt(np.bincount(row, weights=square, minlength=len(at)))
            yield np.array(at), f, (w[None, :] / norm[:, None]).astype(np.float32)


def kernel(units: list[str], landmarks: list[str]) -> np.ndarray:
    """The normalised kernel of each unit with each landmark."""
    if len(landmarks) > 160:  # the dense landmarks take 256 KB each
        return np.hstack([kernel(units, landmarks[:160]), kernel(units, landmarks[160:])])
    dense = np.zeros((_FEATURES, len(landmarks)), dtype=np.float32)
    for at, f, w in features(landmarks):
        np.add.at(dense, (f, at[:, None]), w)
    out = np.zeros((len(units), len(landmarks)), dtype=np.float32)
    for at, f, w in features(units):
        for lo in range(0, len(at), 256):
            out[at[lo : lo + 256]] = np.einsum("nt,ntl->nl", w[lo : lo + 256], dense[f[lo : lo + 256]])
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights (the last one is the bias) of a squared-hinge machine, by Newton steps in the primal."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, total = np.zeros(x.shape[1]), weight.sum()
    reg = np.full(x.shape[1], ridge * total)
    reg[-1] *= 1e-3
    live = np.ones(len(x), dtype=bool)
    for _ in range(30):
        xs = x[live] * weight[live, None]
        new = np.linalg.solve(x[live].T @ xs + np.diag(reg), xs.T @ y[live])
        w = new if not w.any() else w + 0.7 * (new - w)
        after = y * (x @ w) < 1
        if (after == live).all():
            break
        live = after
    return w


class Model:
    """A weight for each subsequence, a bias, and the slope and offset that turn margins into scores."""

    def __init__(self, table: np.ndarray, bias: float, slope: float = 4.0, offset: float = 0.0) -> None:
        self.table, self.bias, self.slope, self.offset = table, bias, slope, offset

    def margins(self, units: list[str]) -> np.ndarray:
        out = np.full(len(units), self.bias, dtype=np.float64)
        for at, f, w in features(units):
            out[at] += (self.table[f] * w).sum(axis=1)
        return out

    def score(self, margin: float) -> float:
        z = self.slope * max(margin, -3.0) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


class Scorer:
    """Worst margin of whole documents, with the margins of raw words kept in a bounded cache."""

    def __init__(self, model: Model) -> None:
        self.model, self.kept = model, Generations(CACHE)

    def _learn(self, words: list[str]) -> list[float]:
        """The margins of distinct words; the cache may keep only some of them."""
        units, owner = [], []
        for k, w in enumerate(words):
            if w.replace("\t", "").isalnum():  # no signs to leave out
                own = (w,)
            else:
                u = _EDGE.sub("", w)
                own = {u} if "\t" in u else {u, _SIGNS.sub("", u)}  # with and without signs put in between
            for v in own:
                for x in windows(v) if len(v) > 2 else ():
                    units.append(x)
                    owner.append(k)
        worst = np.full(len(words), -3.0)
        if units:
            np.maximum.at(worst, owner, self.model.margins(units))
        got = worst.tolist()
        for w, m in zip(words, got, strict=True):
            self.kept.put(w, m)
        return got

    def sentences(self, text: str) -> list[tuple[str, float]]:
        """The sentences of a text with their margins, for reports."""
        return [(s, self.worst([s])[0]) for s in _SENTENCE.split(text) if s and s.strip()]

    def worst(self, texts: list[str | None]) -> list[float]:
        """The worst margin of each text; words that aren't kept are met together for many texts."""
        out, wait, new = [], [], {}
        get = self.kept.get
        for text in texts:
            low = (text or "").lower()
            own = low.split()
            words = set(own) | fragments(own)
            words.update("".join(m[0].split()) for m in _SINGLES.finditer(low))
            young, best, missing = self.kept.young, -3.0, []
            for w in words:
                m = young.get(w)
                if m is None:
                    m = get(w)
                    young = self.kept.young
                if m is None:
                    missing.append(w)
                elif m > best:
                    best = m
            out.append(best)
            if missing:
                wait.append((len(out) - 1, missing))
                new.update(dict.fromkeys(missing))
                if len(new) >= MET:
                    self._settle(out, wait, new)
        self._settle(out, wait, new)
        return out

    def _settle(self, out: list[float], wait: list[tuple[int, list[str]]], new: dict[str, float | None]) -> None:
        """Learn the ``new`` words and raise the margins of the texts that wait for them."""
        words = list(new)
        for i in range(0, len(words), MET):
            own = words[i : i + MET]
            new.update(zip(own, self._learn(own), strict=True))
        for at, missing in wait:
            out[at] = max(out[at], *map(new.__getitem__, missing))
        wait.clear()
        new.clear()


def _sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of labelled documents that aren't held out, about the documented numbers."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out())
    lab = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in lab.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, TOXIC_DOCS / max(1, n.get(1, 0))))).otherwise(F.lit(min(1.0, CLEAN_DOCS / max(1, n.get(0, 0)))))
    lab = lab.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    return texts.join(F.broadcast(lab), "doc_id")


def copy_keys(text: str) -> list[int]:
    """Three least hashes of a text's three-word shingles: near copies share most of them."""
    w = words_of(text)
    h = hashed(shingles(w, 3)) if w else np.zeros(1, np.uint64)
    return [int((h * np.uint64(m)).min() >> np.uint64(1)) for m in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def without_copies(sample: DataFrame) -> DataFrame:
    """One document (the least id) of those that share a key, so that copies don't count as evidence."""

    def run(batches):
        for batch in batches:
            keys = np.array([copy_keys(t) for t in batch.column("text").to_pylist()], dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("text"), *map(pa.array, keys.T)], ["doc_id", "toxic", "text", "k0", "k1", "k2"])

    ids = sample.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, text string, k0 long, k1 long, k2 long").drop("text")
    for k in ("k0", "k1", "k2"):
        ids = ids.groupBy(k).agg(F.min(F.struct("doc_id", "toxic", *[x for x in ("k0", "k1", "k2") if x != k])).alias("r")).select(k, "r.*")
    return sample.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi")


def _unit_counts(sample: DataFrame) -> DataFrame:
    """(unit, toxic, clean): in how many distinct sentences of either label a string occurs.

    A sentence is clean if a clean document has it.
    """

    def cut(batches):
        for batch in batches:
            parts, label = [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {z for x in _SENTENCE.split(text.lower()) if (z := x.strip())}
                parts += own
                label += [toxic] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(label, pa.int32())], ["sentence", "toxic"])

    def run(batches):
        for batch in batches:
            units, label = [], []
            for sentence, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {x for u in strings(sentence) for x in windows(u)}
                units += own
                label += [toxic] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(label, pa.int32())], ["unit", "toxic"])

    sentences = sample.select("text", "toxic").mapInArrow(cut, "sentence string, toxic int").groupBy("sentence").agg(F.min("toxic").alias("toxic"))
    got = sentences.mapInArrow(run, "unit string, toxic int")
    return got.groupBy("unit").agg(F.sum("toxic").cast("long").alias("toxic"), F.sum(1 - F.col("toxic")).cast("long").alias("clean"))


def _landmarks(bad: list[str], good: list[str]) -> list[str]:
    """Half of either kind; each next one is the string that those before represent worst.

    The first quarter are the clean strings that come first, so those that are hardest to tell.
    """
    out: list[str] = []
    for own, first in ((bad[:POOL], 1), (good[:POOL], LANDMARKS // 4)):
        if not own:
            continue
        near = kernel(own, own)
        chosen = list(range(min(first, len(own))))
        best = near[:, chosen].max(axis=1)
        while len(chosen) < min(LANDMARKS // 2, len(own)) and best.min() < 0.98:
            chosen.append(int(best.argmin()))
            best = np.maximum(best, near[:, chosen[-1]])
        out += [own[i] for i in chosen]
    return list(dict.fromkeys(out))


def fitted(bearers: dict[str, int], clean: dict[str, int]) -> Model:
    """A machine that has ``bearers`` on the toxic side and ``clean`` on the other.

    Both come with the number of sentences that bear them out, commonest first; the more, the more an
    example weighs. Each next machine is fitted on the clean strings that the last one finds most toxic
    besides the commonest.
    """
    bad, good = list(bearers), list(clean)
    hard = good[:FITTED]
    for _ in range(4):
        marks = _landmarks(bad, hard)
        gram = kernel(marks, marks).astype(np.float64)
        value, vector = np.linalg.eigh(gram)
        ok = value > 1e-4 * value[-1]
        whiten = vector[:, ok] / np.sqrt(value[ok])
        x = kernel(bad + hard, marks) @ whiten
        y = np.r_[np.ones(len(bad)), -np.ones(len(hard))]
        weight = np.array([*map(bearers.__getitem__, bad), *map(clean.__getitem__, hard)], dtype=float) ** POWER
        for side in (y > 0, y < 0):
            weight[side] *= 0.5 * len(y) / weight[side].sum()
        w = svm(x, y, weight)
        beta, table = whiten @ w[:-1], np.zeros(_FEATURES, dtype=np.float64)
        for at, f, v in features(marks):
            np.add.at(table, f, v * beta[at][:, None])
        model = Model(table.astype(np.float32), float(w[-1]))
        worst = np.argsort(-model.margins(good), kind="stable")[: FITTED // 2]
        hard = list(dict.fromkeys([good[i] for i in worst] + good[: FITTED // 2]))
    return model


def witnesses(toxic: DataFrame, model: Model) -> dict[str, int]:
    """The worst string of each toxic text that the machine finds toxic, and of how many texts it is; a row for a text at most."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                units = sorted({x for s in _SENTENCE.split(text) for u in strings(s) for x in windows(u)})
                if units:
                    m = model.margins(units)
                    if m.max() > 0:
                        out.append(units[int(m.argmax())])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["unit"])

    rows = toxic.mapInArrow(tidy(run), "unit string").groupBy("unit").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "unit").collect()
    return {r["unit"]: r["n"] for r in rows}


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model; without a toxic and a clean document to learn from, one that scores all texts alike."""
    sample = saved(_sampled(docs, labels), "labelled")
    counts = saved(_unit_counts(without_copies(sample)), "units")
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    both = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    few = counts.where((F.col("toxic") >= 3) & (F.col("clean") * 20 <= F.col("toxic"))).orderBy(F.desc("toxic"), "unit").limit(BEARERS).collect()
    most = counts.where("clean > 0 AND toxic <= 10 * clean").orderBy(F.desc("clean"), "unit").limit(CLEAN).collect()
    drop_saved(counts)
    if not n.get(0) or not n.get(1) or not few or not most:
        share = n.get(1, 0) / max(1, sum(n.values()))
        return Model(np.zeros(_FEATURES, dtype=np.float32), 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    clean = {r["unit"]: r["clean"] for r in most}
    # chance alone gives strings of one label too: keep those that it hardly explains
    rate, tried = np.log(both["t"] / (both["t"] + both["c"])), np.log(len(few) + len(clean))
    sure = {r["unit"]: r["toxic"] for r in few if r["toxic"] * rate + tried < (-1.5 if r["clean"] == 0 else -6.0)}
    bearers = sure or {r["unit"]: r["toxic"] for r in few[:FALLBACK]}
    model = fitted(bearers, clean)
    seen = {u: n for u, n in witnesses(sample.where("toxic = 1").select("text"), model).items() if u not in clean}
    model = fitted(dict(sorted((seen | bearers).items(), key=lambda x: (-x[1], x[0]))), clean)

    def worst(batches):
        scorer = Scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(scorer.worst(batch.column(0).to_pylist()), pa.float64())], ["toxic", "margin"])

    got = np.array([(r[0], r[1]) for r in sample.select("text", "toxic").mapInArrow(worst, "toxic int, margin double").collect()])
    drop_saved(sample)
    return _calibrated(model, got[:, 1], got[:, 0])


def _calibrated(model: Model, margin: np.ndarray, y: np.ndarray) -> Model:
    """Slope and offset by logistic regression of the label on the margin; the slope stays positive."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x = np.c_[np.maximum(margin, -3.0), np.ones(len(margin))]
    w = np.array([2.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p) - 1e-3 * (w - [2.0, 0.0]))
        w = w + np.clip(step, -2, 2)
    model.slope, model.offset = max(0.5, float(w[0])), float(w[1])
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= THRESHOLD).

    Learns from labelled documents that aren't held out, a bounded number of either label; labels,
    lang, source and doc_id don't enter a score. Null, empty and signs-only texts score lowest.
    Repeated rows and null doc_ids stay; several labels of a document count as toxic if one is; an
    empty table gives no rows; columns other than doc_id and text are not read.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            s = [scorer.model.score(m) for m in scorer.worst(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score is ``threshold`` or more; other rows stay as they are.

    Null and empty texts stay; very long ones are scored as a whole, repeated rows alike. Columns may
    have any names but ``text`` and ``doc_id``; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            margins = scorer.worst(batch.column(at).to_pylist())
            yield batch.filter(pa.array([scorer.model.score(m) < threshold for m in margins], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
