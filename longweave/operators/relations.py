"""How chunks' clusterings agree with one another, and reads clustered anew by what stands around a chunk."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longweave.operators import cluster
from longweave.operators.joins import cluster_correlation
from longweave.session import saved

#: Pairs of chunks that the search of classes takes in: some 40 bytes each on the driver.
MOST_PAIRS = 5_000_000
#: Log-posterior of what a hard label leaves out; fixed value.
NEVER = -10_000.0


def agreeing(pairs: list[tuple[int, int, int, float]], least_ari: float = 0.4, match: float = 4.0, mismatch: float = -1.0, rounds: int = 10, flips: int = 1000, seed: int = 3) -> set[int]:
    """The chunks (of pairs a, b, n, ari) of the best set found: pairs inside it count ``match`` a read if they agree, ``mismatch`` if not."""
    names = sorted({x for p in pairs for x in p[:2]})
    at = {x: i for i, x in enumerate(names)}
    near: list[list[tuple[int, float]]] = [[] for _ in names]
    for a, b, n, ari in pairs:
        w = n * (mismatch if min(1.0, max(0.0, ari)) <= least_ari else match)
        near[at[a]].append((at[b], w))
        near[at[b]].append((at[a], w))
    inside = np.ones(len(names), dtype=bool)
    rng = np.random.default_rng(seed)

    def gain(i: int) -> float:
        total = sum(w for j, w in near[i] if inside[j])
        return -total if inside[i] else total

    best, kept = -np.inf, inside.copy()
    for _ in range(rounds):
        moved = True
        while moved:
            moved = False
            for i in range(len(names)):
                if gain(i) > 0:
                    inside[i], moved = ~inside[i], True
        score = sum(w for i, ws in enumerate(near) for j, w in ws if i < j and inside[i] and inside[j])
        if score > best:
            best, kept = score, inside.copy()
        for i in rng.integers(0, len(names), flips if len(names) else 0):
            if rng.random() < np.exp(min(0.0, gain(int(i)))):
                inside[i] = ~inside[i]
    return {x for x in names if kept[at[x]]}


def relation_classes(nodes: DataFrame, chunks: DataFrame, least: int = 7, least_ari: float = 0.4, match: float = 4.0, mismatch: float = -1.0) -> DataFrame:
    """(chunk, class): stiff, suspicious or isolated.

    Chunks of several clusters whose labels agree with one another's are stiff, and so are chunks of more
    than two copies. Of the others those that share reads with a stiff one are suspicious. A node whose
    posterior is even doesn't count. Pairs with ``least`` reads or fewer are left out. Over MOST_PAIRS
    pairs are an error.
    """
    from longweave.functions.sequence import is_biased

    own = nodes.join(chunks.where("cluster_num > 1").select("chunk"), "chunk", "left_semi")
    if "posterior" in nodes.columns:
        own = own.where(F.col("posterior").isNull() | is_biased(F.col("posterior")))
    pairs = saved(cluster_correlation(own, least).select("a", "b", "n", "ari"), "pairs")
    n = pairs.count()
    if n > MOST_PAIRS:
        raise ValueError(f"{n} pairs of chunks are more than the {MOST_PAIRS} that are classified at once")
    rows = [tuple(r) for r in pairs.orderBy("a", "b").collect()]
    stiff = agreeing(rows, least_ari, match, mismatch)
    beside = {x for a, b, _, _ in rows for x, y in ((a, b), (b, a)) if y in stiff}
    known = nodes.sparkSession.createDataFrame([(x, x in stiff, x in beside) for x in {x for r in rows for x in r[:2]}] or [(None, False, False)], "chunk long, stiff boolean, beside boolean")
    kind = F.when(F.coalesce("stiff", F.lit(False)) | (F.col("copy_num") > 2), "stiff").when(F.coalesce("beside", F.lit(False)), "suspicious").otherwise("isolated")
    return chunks.join(known, "chunk", "left").select("chunk", kind.alias("class"))


def hard_posteriors(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """``nodes`` with a posterior of 0 at their cluster and NEVER at the others."""
    k = chunks.select("chunk", F.col("cluster_num").alias("__k"))
    own = F.transform(F.sequence(F.lit(0), F.greatest(F.col("__k") - 1, F.col("cluster").cast("int"))), lambda i: F.when(i == F.col("cluster"), F.lit(0.0)).otherwise(F.lit(NEVER)))
    return nodes.drop("posterior").join(k, "chunk").withColumn("posterior", own).drop("__k")


def contexts(nodes: DataFrame, reach: int = 12) -> DataFrame:
    """(node_id, chunk, cluster, posterior, left, right): up to ``reach`` nodes on either side, nearest first, as the chunk runs.

    Each side is an array of (chunk, forward, posterior), whose strands are seen from the node.
    """
    item = F.struct("chunk", "is_forward", "posterior")
    own = Window.partitionBy("read_id").orderBy("idx")
    w = nodes.select("node_id", "chunk", "cluster", "posterior", "is_forward", F.reverse(F.collect_list(item).over(own.rowsBetween(-reach, -1))).alias("before"), F.collect_list(item).over(own.rowsBetween(1, reach)).alias("after"))
    seen = lambda side: F.transform(side, lambda x: F.struct(x["chunk"].alias("chunk"), (x["is_forward"] == F.col("is_forward")).alias("forward"), x["posterior"].alias("posterior")))
    left = F.when(F.col("is_forward"), seen(F.col("before"))).otherwise(seen(F.col("after")))
    right = F.when(F.col("is_forward"), seen(F.col("after"))).otherwise(seen(F.col("before")))
    return w.select("node_id", "chunk", "cluster", "posterior", left.alias("left"), right.alias("right"))


def same_cluster(x: np.ndarray, y: np.ndarray, copies: np.ndarray) -> float:
    """Logit of the chance that two log-posteriors are of one cluster; for one cluster what its copies leave."""
    if len(copies) == 1:
        return -float(np.log(max(copies.sum(), 1.5) - 1))
    p = min(0.0, float(cluster.logsumexp(x + y - np.log(copies))))
    if p < -80:
        return -80.0
    return 80.0 if p > -1.8e-35 else float(p - np.log1p(-np.exp(p)))


#: Most that one pair of nodes says for or against one cluster, as a logit.
EVIDENCE = 10.0


def matched(x: list[dict], y: list[dict]) -> list[tuple[int, int]]:
    """Pairs of places of two contexts that have the same chunk and strand, in order: a longest common subsequence."""
    same = [[a["chunk"] == b["chunk"] and a["forward"] == b["forward"] for b in y] for a in x]
    best = np.zeros((len(x) + 1, len(y) + 1), dtype=int)
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i, j] = max(best[i + 1, j], best[i, j + 1], best[i + 1, j + 1] + 1 if same[i][j] else 0)
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if same[i][j] and best[i, j] == best[i + 1, j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def recontexted(rows: list[dict], k: int, copies: dict[int, np.ndarray], seed: int = 0) -> np.ndarray:
    """Labels of a chunk's nodes (rows of :func:`contexts`) by spectral clustering of how alike they and their surroundings are.

    Surroundings are matched by their chunks; each pair matched says by its posteriors whether two reads
    are of one cluster, EVIDENCE at most.
    """
    one = np.ones(1)

    def told(chunk: int, x, y) -> float:
        a, b = np.array(x), np.array(y)
        c = copies.get(chunk, one)
        n = min(len(a), len(b), len(c))
        s = same_cluster(a[:n] - cluster.logsumexp(a[:n]), b[:n] - cluster.logsumexp(b[:n]), c[:n])
        return min(EVIDENCE, max(-EVIDENCE, s))

    n = len(rows)
    sim = np.ones((n, n))
    for i in range(n):
        for j in range(i + 1, n):
            a, b = rows[i], rows[j]
            s = told(a["chunk"], a["posterior"], b["posterior"])
            for side in ("left", "right"):
                s += sum(told(a[side][p]["chunk"], a[side][p]["posterior"], b[side][q]["posterior"]) for p, q in matched(a[side], b[side]))
            sim[i, j] = sim[j, i] = 1 / (1 + np.exp(-np.clip(s, -60, 60)))
    own = np.exp(np.array([np.array(r["posterior"])[:k] - cluster.logsumexp(np.array(r["posterior"])[:k]) for r in rows]))
    shared = sim @ own  # what the reads alike say together
    return cluster.spectral(sim, np.log(shared / shared.sum(axis=1, keepdims=True) + 1e-12), k, seed)


def corrected_clustering(nodes: DataFrame, chunks: DataFrame, coverage: float, protected: DataFrame | None = None, least_ari: float = 0.4, reach: int = 12, seed: int = 0) -> DataFrame:
    """``nodes`` (with posterior) whose clusters agree with what stands around them, with hard posteriors.

    All chunks start from one snapshot. A chunk whose new labels agree with the old ones by less than
    ``least_ari`` loses its clusters, unless ``protected`` (chunk) names it. A chunk's reads meet in one
    task: they are as many as its coverage, and their pairs are compared.
    """
    import pyarrow as pa

    from longweave.functions.stats import adjusted_rand

    n = chunks.select("chunk", "cluster_num", "copy_num")
    sizes = nodes.groupBy("chunk", "cluster").agg(F.count("*").alias("n"))
    multi = n.where("cluster_num > 1")
    per = sizes.join(multi, "chunk").groupBy("chunk", "copy_num").agg(F.sort_array(F.collect_list(F.struct("cluster", "n"))).alias("x")).collect()
    copies = {}
    for r in per:
        own = np.zeros(max(x["cluster"] for x in r["x"]) + 1)
        for x in r["x"]:
            own[x["cluster"]] = x["n"]
        copies[r["chunk"]] = cluster.allotted(own, max(int(r["copy_num"]), len(own))).astype(float)
    for r in n.where("cluster_num <= 1").collect():
        copies[r["chunk"]] = np.array([max(1.0, float(r["copy_num"]))])
    known = nodes.sparkSession.sparkContext.broadcast(copies)  # an array for each chunk, which are as many as the region holds
    own = contexts(nodes, reach).join(multi.select("chunk", "cluster_num"), "chunk")

    def run(key, t):
        rows = sorted(t.to_pylist(), key=lambda r: r["node_id"])
        labels = recontexted(rows, int(rows[0]["cluster_num"]), known.value, seed + key[0].as_py() % 10_007)
        return pa.table({"node_id": pa.array([r["node_id"] for r in rows], pa.int64()), "chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()), "old": pa.array([r["cluster"] for r in rows], pa.int64()), "new": pa.array(labels.tolist(), pa.int64())})

    got = saved(own.groupBy("chunk").applyInArrow(run, "node_id long, chunk long, old long, new long"), "labels")
    weak = adjusted_rand(got, "old", "new", ["chunk"]).where(F.coalesce("ari", F.lit(1.0)) < least_ari).select("chunk")
    if protected is not None:
        weak = weak.join(protected.select("chunk"), "chunk", "left_anti")
    new = got.join(weak, "chunk", "left_anti").select("node_id", F.col("new").alias("__new"))
    flat = weak.select("chunk", F.lit(True).alias("__weak"))
    out = nodes.join(new, "node_id", "left").join(flat, "chunk", "left")
    out = out.withColumn("cluster", F.when(F.col("__weak"), F.lit(0).cast("long")).otherwise(F.coalesce("__new", "cluster"))).select(*nodes.columns)
    return hard_posteriors(out, chunks).select(*nodes.columns)


def protected_clusterings(nodes: DataFrame, chunks: DataFrame, gain: float) -> DataFrame:
    """(chunk): chunks whose score exceeds what their reads would gain by chance clusters."""
    n = nodes.groupBy("chunk").agg(F.count("*").alias("n"))
    return n.join(chunks, "chunk").where("cluster_num > 0").where(F.col("n") * (F.col("cluster_num") - 1) / F.col("cluster_num") * gain < F.col("score")).select("chunk")
