"""Clustering of reads by variant profiles, and what goes with it, in numpy for one group at a time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A gain within this of zero is none.
TINY = 1e-5


def logsumexp(x: np.ndarray, axis: int = -1) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def binomial_tail(n: int, p: float) -> np.ndarray:
    """Chance of k or more successes of n, for k from 0 to n, summed from the logs."""
    from math import lgamma, log

    logs = np.array([lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log(1 - p) for k in range(n + 1)])
    return np.minimum(1.0, np.cumsum(np.exp(logs)[::-1])[::-1])


def poisson_log(x, rate):
    from math import lgamma

    return x * np.log(rate) - rate - np.vectorize(lambda v: lgamma(v + 1))(x)


def size_score(sizes: np.ndarray, coverage: float, most: int) -> np.ndarray:
    """For each cluster size the best Poisson log-likelihood over one to ``most`` copies."""
    return np.max([poisson_log(sizes, coverage * c) for c in range(1, most + 1)], axis=0)


def column_similarities(profiles: DataFrame, columns: int) -> DataFrame:
    """(i, j, cosine, sokal_michener) of column pairs i < j over rows (xs) in which neither is near zero.

    Sums are formed by batch in numpy and added up; a row of partial sums a batch and pair is shuffled.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            x = np.array([r[:columns] for r in batch.column(0).to_pylist()], dtype=float).reshape(-1, columns)
            live = np.abs(x) > TINY
            y, m = x * live, live.astype(float)
            s = np.sign(y)
            parts = [y.T @ y, (y * y).T @ m, m.T @ (y * y), ((s.T @ s) + m.T @ m) / 2, m.T @ m]
            i, j = np.triu_indices(columns, 1)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *[pa.array(p[i, j]) for p in parts]], ["i", "j", "xy", "xx", "yy", "same", "n"])

    sums = profiles.select("xs").mapInArrow(run, "i long, j long, xy double, xx double, yy double, same double, n double")
    g = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("xy", "xx", "yy", "same", "n")])
    cosine = F.when(F.col("xx") == 0, F.lit(0.0)).otherwise(F.col("xy") / F.sqrt("xx") / F.sqrt("yy"))
    michener = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.greatest(F.col("same"), F.col("n") - F.col("same")) / F.col("n"))
    return g.select("i", "j", cosine.alias("cosine"), michener.alias("sokal_michener"))


def strand_bias(cells: DataFrame) -> DataFrame:
    """(col, chi2, kept): strand against sign of (col, forward, x); kept below 10, never without a signal."""
    live = cells.where(F.abs("x") > 1e-4).groupBy("col").agg(F.count("*").alias("n"), F.count(F.when(F.col("forward"), 1)).alias("s"), F.count(F.when(F.col("x") > 0, 1)).alias("p"), F.count(F.when(F.col("forward") & (F.col("x") > 0), 1)).alias("sp"))
    s, p, n = F.col("s"), F.col("p"), F.col("n")
    seen = [(F.col("sp"), s, p), (s - F.col("sp"), s, n - p), (p - F.col("sp"), n - s, p), (n - s - p + F.col("sp"), n - s, n - p)]
    chi2 = sum(F.when(a * b > 0, F.pow(o - a * b / n, 2) / (a * b / n)).otherwise(0.0) for o, a, b in seen)
    return live.select("col", chi2.alias("chi2"), (chi2 < 10).alias("kept"))


def used_columns(gains: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Columns that tell clusters apart.

    In some cluster the sum is positive and over 70 % of its signals are; and clusters of positive sum
    hold more than twice the positive signals of the others.
    """
    sums = np.array([gains[labels == c].sum(axis=0) for c in range(k)])
    pos = np.array([(gains[labels == c] > TINY).sum(axis=0) for c in range(k)])
    neg = np.array([(gains[labels == c] < -TINY).sum(axis=0) for c in range(k)])
    telling = ((sums > 0) & (pos > 0.7 * (pos + neg + 1e-7))).any(axis=0)
    inside, outside = np.where(sums > 0, pos, 0).sum(axis=0), np.where(sums <= 0, pos, 0).sum(axis=0)
    return telling & (2 * outside < inside)


def score(gains: np.ndarray, labels: np.ndarray, k: int, coverage: float) -> float:
    """Log-likelihood of a labelling: positive cluster sums of the columns used, and the sizes' own."""
    use = used_columns(gains, labels, k)
    sums = np.array([gains[labels == c].sum(axis=0) for c in range(k)])
    sizes = np.bincount(labels, minlength=k)
    return float(np.maximum(sums[:, use], 0).sum() + size_score(sizes, coverage, k).sum())


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 100) -> np.ndarray:
    """Labels by Lloyd's rounds from random labels or spread-out rows, by a coin; the first centre wins ties."""
    n = len(x)
    if rng.random() < 0.5:
        labels = rng.integers(0, k, n)
    else:
        centres = [x[rng.integers(n)]]
        for _ in range(1, k):
            d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
            centres.append(x[rng.choice(n, p=d / d.sum()) if d.sum() > 0 else rng.integers(n)])
        labels = ((x[:, None] - np.array(centres)) ** 2).sum(axis=2).argmin(axis=1)
    last = np.inf
    for _ in range(rounds):
        centres = np.array([x[labels == c].mean(axis=0) if (labels == c).any() else np.zeros(x.shape[1]) for c in range(k)])
        d = ((x[:, None] - centres) ** 2).sum(axis=2)
        labels = d.argmin(axis=1)
        if last - d.min(axis=1).sum() < 1e-8:
            break
        last = d.min(axis=1).sum()
    return labels


def metropolis(gains: np.ndarray, labels: np.ndarray, k: int, coverage: float, rng: np.random.Generator, flips: int = 2000) -> tuple[np.ndarray, float]:
    """(labels, score): the best that ``flips`` a read of single moves meet."""
    labels = labels.copy()
    now = best = score(gains, labels, k, coverage)
    kept = labels.copy()
    for _ in range(flips * len(gains)):
        at, old = rng.integers(len(gains)), None
        old = labels[at]
        labels[at] = (old + rng.integers(1, k)) % k if k > 1 else old
        new = score(gains, labels, k, coverage)
        if new >= now or rng.random() < np.exp(new - now):
            now = new
            if now > best:
                best, kept = now, labels.copy()
        else:
            labels[at] = old
    return kept, best


def clustered(gains: np.ndarray, k: int, coverage: float, seed: int, restarts: int = 20, flips: int = 20) -> tuple[np.ndarray, float]:
    """(labels, score) of the best of seeded restarts."""
    rng = np.random.default_rng(seed)
    return max((metropolis(gains, kmeans(gains, k, rng), k, coverage, rng, flips) for _ in range(restarts)), key=lambda x: x[1])


def exact(gains: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """(labels, score): the best choice of a subset of columns for each cluster, by trying all; few columns only."""
    from itertools import combinations_with_replacement

    d = gains.shape[1]
    masks = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1
    sums = gains @ masks.T
    best = max(combinations_with_replacement(range(1 << d), k), key=lambda c: sums[:, c].max(axis=1).sum())
    return sums[:, best].argmax(axis=1), float(sums[:, best].max(axis=1).sum())


def highest_gain(cells: DataFrame) -> DataFrame:
    """(vec_id, cluster): two clusters by the sign of the column with the largest positive gains."""
    best = cells.where("x > 0").groupBy("col").agg(F.sum("x").alias("g")).agg(F.max(F.struct("g", "col")).alias("b")).select(F.col("b.col").alias("col"))
    return cells.join(F.broadcast(best), "col").select("vec_id", (F.col("x") > 0).cast("int").alias("cluster"))  # best: one row


def allotted(weights: np.ndarray, copies: int) -> np.ndarray:
    """Copies given one by one to the cluster that has the largest squared residual, from one each."""
    out = np.ones(len(weights), dtype=int)
    unit = weights.sum() / copies
    for _ in range(copies - len(weights)):
        out[int(np.argmax(((weights - unit * out) ** 2) * np.where(weights > unit * out, 1, -1)))] += 1
    return out


def laplacian_vectors(similarity: np.ndarray, below: float = 0.2) -> np.ndarray:
    """Eigenvectors of the normalised Laplacian whose eigenvalue is below; one column at least."""
    inv = 1 / np.sqrt(similarity.sum(axis=1))
    lap = -similarity * inv[:, None] * inv[None, :]
    np.fill_diagonal(lap, 1.0)
    value, vector = np.linalg.eigh(lap)
    return vector[:, : max(1, int((value < below).sum()))]


def spectral(similarity: np.ndarray, posterior: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Labels by k-means on spectral columns and posteriors, all scaled to length one; best of twenty."""
    x = np.hstack([laplacian_vectors(similarity), np.exp(posterior - logsumexp(posterior)[:, None])])
    x = x / np.maximum(np.sqrt((x**2).sum(axis=0)), 1e-300)
    rng = np.random.default_rng(seed)

    def loss(labels):
        return sum(((x[labels == c] - x[labels == c].mean(axis=0)) ** 2).sum() for c in np.unique(labels))

    return min((kmeans(x, k, rng) for _ in range(20)), key=loss)


def additive_effects(errors: DataFrame, fallback: float = 0.0, rounds: int = 50) -> tuple[DataFrame, DataFrame, float]:
    """(cluster effects, read effects, spread) of errors (read_id, chunk, cluster, error).

    In turn the effect of a cluster is the sum of its residuals, at least 0, over its size and a tenth,
    and that of a read the mean of its residuals, until the objective moves by less than 1e-5. What
    crosses rounds is a row for each cluster and each read, written to the shared folder.
    """
    from longweave.functions.stats import picked
    from longweave.session import drop_saved, saved

    data = saved(errors.select("read_id", "chunk", "cluster", "error"), "errors")
    reads = data.select("read_id").distinct().withColumn("read_effect", F.lit(fallback))
    last = None
    for _ in range(rounds):
        own = data.join(reads, "read_id")
        clusters = saved(own.groupBy("chunk", "cluster").agg((F.greatest(F.sum(F.col("error") - F.col("read_effect")), F.lit(0.0)) / (F.count("*") + 0.1)).alias("effect")), "clusters")
        reads = saved(data.join(clusters, ["chunk", "cluster"]).groupBy("read_id").agg(F.avg(F.col("error") - F.col("effect")).alias("read_effect")), "reads")
        rest = data.join(clusters, ["chunk", "cluster"]).join(reads, "read_id").withColumn("r", F.col("error") - F.col("effect") - F.col("read_effect"))
        now = rest.agg(F.sum(F.col("r") * F.col("r"))).first()[0] + clusters.agg(F.sum(F.col("effect") * F.col("effect"))).first()[0]
        if last is not None and abs(last - now) < 1e-5:
            break
        last = now
    square = rest.select((F.col("r") * F.col("r")).alias("s"))
    spread = picked(square, "s", [], F.floor(F.col("n") / 2)).first()[0] ** 0.5
    drop_saved(data)
    return clusters, reads, spread
