"""Joins within and between reads, all on equal keys; ranges are tested on what the keys bring together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longweave.session import saved

#: Rows of one key that a task of a salted join takes, at least.
HEAVY = 5000


def salted_join(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner", heavy: int = HEAVY) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, of which ``right`` has each value once and ``left`` any number of times.

    Rows of a key with more than ``heavy`` of them in ``left`` are dealt over as many parts as that
    takes by a hash of column ``by``, and the row of ``right`` is repeated for each part. What is
    broadcast are the heavy keys: never more than the rows of ``left`` over ``heavy``, and ``heavy``
    grows so that this is 1,000,000 at most. Null keys join nothing.
    """
    n = left.count()
    if n <= heavy:
        return left.join(right, key, how)
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__lw_n"))
    heavy = max(heavy, n // 1_000_000)
    hot = counts.where(F.col("__lw_n") > heavy).select(key, F.ceil(F.col("__lw_n") / heavy).cast("int").alias("__lw_parts"))
    hot = F.broadcast(hot)
    a = left.join(hot, key, "left").withColumn("__lw_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("__lw_parts")).cast("int"), F.lit(0))).drop("__lw_parts")
    b = right.join(hot, key, "left").withColumn("__lw_salt", F.explode(F.sequence(F.lit(0), F.coalesce("__lw_parts", F.lit(1)) - 1))).drop("__lw_parts")
    return a.join(b, [key, "__lw_salt"], how).drop("__lw_salt")


def of_chunks(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Nodes with what is known of their chunk. Spark broadcasts the chunks while they are small."""
    return nodes.join(chunks, "chunk")


def never_encoded(reads: DataFrame, nodes: DataFrame) -> DataFrame:
    """Reads without a node."""
    return reads.join(nodes.select("read_id").distinct(), "read_id", "left_anti")


def chunk_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b, n): unordered pairs of nodes of one read, by their chunks.

    A pair's count is worked out from each read's chunk counts, so a read with many nodes of one chunk
    gives one row for a pair of chunks, not one for a pair of nodes.
    """
    per = nodes.groupBy("read_id", "chunk").agg(F.count("*").alias("c"))
    x, y = per.select("read_id", F.col("chunk").alias("a"), F.col("c").alias("ca")), per.select("read_id", F.col("chunk").alias("b"), F.col("c").alias("cb"))
    pairs = x.join(y, "read_id").where("a <= b")
    n = F.when(F.col("a") == F.col("b"), F.col("ca") * (F.col("ca") - 1) / 2).otherwise(F.col("ca") * F.col("cb"))
    return pairs.groupBy("a", "b").agg(F.sum(n).cast("long").alias("n")).where("n > 0")


def overlaps_in_read(nodes: DataFrame, least: Column, width: int = 512) -> DataFrame:
    """(read_id, a, b, overlap): pairs of nodes (a before b by idx) that overlap by more than ``least`` bases.

    Nodes meet in bins of ``width`` bases, so a long read costs its overlaps and not the square of its
    nodes; of the bins that a pair shares the one where the later starts reports it.
    """
    end = F.col("pos") + F.col("len")
    own = nodes.select("read_id", "idx", "node_id", "pos", end.alias("end"), F.explode(F.sequence(F.floor(F.col("pos") / width), F.floor((F.greatest(end, F.col("pos") + 1) - 1) / width))).alias("bin"))
    a = own.select("read_id", "bin", F.col("idx").alias("ia"), F.col("node_id").alias("a"), F.col("pos").alias("sa"), F.col("end").alias("ea"))
    b = own.select("read_id", "bin", F.col("idx").alias("ib"), F.col("node_id").alias("b"), F.col("pos").alias("sb"), F.col("end").alias("eb"))
    met = a.join(b, ["read_id", "bin"]).where("ia < ib").where(F.col("bin") == F.floor(F.greatest("sa", "sb") / width))
    overlap = F.least("ea", "eb") - F.greatest("sa", "sb")
    return met.select("read_id", "a", "b", overlap.alias("overlap")).where(F.col("overlap") > least)


#: Pairs of reads for each row of the inverted index up to which :func:`candidate_reads` shuffles pairs.
INDEX_PAIRS = 4
#: Reads of a stripe, at least and at most; stripes of a table of middling size; rows of the index that a stripe has, about.
STRIPE_READS, STRIPES, STRIPE_ROWS = (256, 8192), 12, 1_000_000
#: Keys up to which their numbers are broadcast, some 40 bytes each.
BROADCAST_KEYS = 1_000_000
#: Rows and columns of what is multiplied at once, and times that a pair by index costs a cell of a product.
BLOCK_ROWS, BLOCK_COLUMNS, PAIR_COST = 512, 1024, 600


def candidate_reads(nodes: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, same): pairs of reads, a < b, with ``least`` or more nodes of equal chunk, cluster and strand.

    An inverted index brings together reads of one key; keys carried by one read drop out first. Where
    keys are common, so that the index would give many more pairs than it has rows, stripes of reads meet
    in cells instead and a cell adds up its own pairs: no pair is shuffled or spilled, whatever their number.
    Null keys and reads pair with nothing.
    """
    keys = ["chunk", "cluster", "is_forward"]
    index = saved(nodes.dropna(subset=[*keys, "read_id"]).groupBy(*keys, "read_id").agg(F.count("*").alias("c")), "index")
    sizes = saved(index.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").withColumn("key", F.monotonically_increasing_id()), "keys")
    n_keys, rows, pairs = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2), F.lit(0.0))).first()
    number = sizes.select(F.struct(*keys).alias("of"), "key")
    own = index.select(F.struct(*keys).alias("of"), "read_id", "c")
    own = (own.join(F.broadcast(number), "of") if n_keys <= BROADCAST_KEYS else salted_join(own, number, "of", "read_id")).select("key", "read_id", "c")
    if pairs > INDEX_PAIRS * rows:
        return _pairs_by_cells(saved(own, "numbered"), rows, least)
    x, y = own.withColumnsRenamed({"read_id": "a", "c": "ca"}), own.withColumnsRenamed({"read_id": "b", "c": "cb"})
    both = x.join(y, "key").where("a < b")
    return both.groupBy("a", "b").agg(F.sum(F.least("ca", "cb")).alias("same")).where(F.col("same") >= least)


def _pairs_by_cells(index: DataFrame, rows: int, least: int) -> DataFrame:
    """:func:`candidate_reads` of (key, read_id, c), a row for each key of a read, by pairs of stripes: ranges of reads."""
    kind = index.schema["read_id"].dataType.simpleString()
    reads = index.agg(F.count_distinct("read_id")).first()[0]
    n = max(1, -(-reads // int(np.clip(reads // STRIPES, *STRIPE_READS))), -(-rows // STRIPE_ROWS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([("read_id", "ascending"), ("key", "ascending")]).combine_chunks()
        runs = pc.run_end_encode(t.column("read_id").combine_chunks())
        ids = pa.ListArray.from_arrays(pa.array([0, len(runs.values)], pa.int32()), runs.values)
        packed = [runs.run_ends.to_numpy().astype(np.int64), t.column("key").to_numpy(), t.column("c").to_numpy()]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), ids, *(pa.array([x.tobytes()], pa.binary()) for x in packed)], ["part", "ids", "ends", "keys", "counts"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = {}
        for batch in batches:
            for i, side in enumerate(batch.column("side").to_pylist()):
                sides[side] = (batch.column("ids")[i].values, *(np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("ends", "keys", "counts")))
        x, y = (sides[2], sides[2]) if 2 in sides else (sides[0], sides[1])
        for a, b, same in _met(x[1:], y[1:], least, 2 in sides):
            for lo in range(0, len(a), 1 << 16):
                at = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([x[0].take(pa.array(a[at])), y[0].take(pa.array(b[at])), pa.array(same[at])], ["a", "b", "same"])

    stripes = saved(index.repartitionByRange(n, "read_id").mapInArrow(cut, f"part int, ids array<{kind}>, ends binary, keys binary, counts binary"), "stripes")
    parts = stripes.select(F.col("part").alias("other"))
    total = parts.count()
    side = F.when(F.col("part") < F.col("other"), 0).when(F.col("part") > F.col("other"), 1).otherwise(2)
    cells = stripes.crossJoin(F.broadcast(parts)).select("ids", "ends", "keys", "counts", side.alias("side"), F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    tasks = max(2 * index.sparkSession.sparkContext.defaultParallelism, min(total * (total + 1) // 2, 4096))
    return cells.repartition(tasks, "low", "high").groupBy("low", "high").applyInArrow(compare, f"a {kind}, b {kind}, same long")


def _met(x: tuple, y: tuple, least: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of x, rows of y, sums) of the pairs whose lesser counts of each key add up to ``least``; of the ``same`` stripe each pair once.

    x, y: (ends of each read's run, keys, counts). A lesser count is the sum, over the counts that a key
    has, of the step to it where both sides reach it. For common keys that is a product of matrices, a
    column for each count of a key; the pairs of rare keys are added up one by one.
    """
    nx, ny = len(x[0]), len(y[0])
    (rx, kx, cx), (ry, ky, cy) = ((np.repeat(np.arange(len(e)), np.diff(e, prepend=0)), k, c) for e, k, c in (x, y))
    keys = np.intersect1d(kx, ky)
    if not len(keys):
        return

    def known(r, k, c):
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        ok = keys[at] == k
        return r[ok], at[ok], c[ok]

    (rx, kx, cx), (ry, ky, cy) = known(rx, kx, cx), known(ry, ky, cy)
    top = np.zeros((2, len(keys)), np.int64)
    np.maximum.at(top[0], kx, cx)
    np.maximum.at(top[1], ky, cy)
    top = top.min(axis=0)
    cx, cy = np.minimum(cx, top[kx]), np.minimum(cy, top[ky])
    # columns: the counts that each key has, in order
    base = int(top.max()) + 1
    columns = np.unique(np.concatenate([kx * base + cx, ky * base + cy]))
    of, step = columns // base, columns % base
    first = np.searchsorted(of, np.arange(len(keys)))
    later = np.nonzero(of[1:] == of[:-1])[0] + 1
    step[later] -= columns[later - 1] % base
    n, m = np.bincount(kx, minlength=len(keys)), np.bincount(ky, minlength=len(keys))
    dense = np.bincount(of).astype(float) * nx * ny < float(PAIR_COST) * n * m
    new = np.cumsum(dense[of]) - 1
    width = int(new[-1]) + 1
    step = step[dense[of]]

    def spread(r, k, c):
        ok = dense[k]
        r, k, c = r[ok], k[ok], c[ok]
        rank = np.searchsorted(columns, k * base + c) - first[k] + 1
        start = np.cumsum(rank) - rank
        return np.repeat(r, rank), np.repeat(new[first[k]] - start, rank) + np.arange(rank.sum())

    (dx, ux), (dy, uy) = spread(rx, kx, cx), spread(ry, ky, cy)
    by = np.argsort(uy, kind="stable")
    dy, uy = dy[by], uy[by]
    own, other = ~dense[kx], ~dense[ky]
    sx, skx, scx = rx[own], kx[own], cx[own]
    by = np.argsort(ky[other], kind="stable")
    sy, sky, scy = ry[other][by], ky[other][by], cy[other][by]
    start = np.searchsorted(sky, np.arange(len(keys)))
    exact = np.float32 if int(np.bincount(rx, weights=cx).max()) < 1 << 24 else np.float64
    for lo in range(0, nx, BLOCK_ROWS):
        high = min(nx, lo + BLOCK_ROWS)
        sums = np.zeros((high - lo, ny), exact)
        i, j = np.searchsorted(dx, [lo, high])
        dr, du = dx[i:j] - lo, ux[i:j]
        for c in range(0, width, BLOCK_COLUMNS):
            w = min(width - c, BLOCK_COLUMNS)
            left, right = np.zeros((high - lo, w), exact), np.zeros((w, ny), exact)
            ok = (du >= c) & (du < c + w)
            left[dr[ok], du[ok] - c] = step[du[ok]]
            p, q = np.searchsorted(uy, [c, c + w])
            right[uy[p:q] - c, dy[p:q]] = 1
            sums += left @ right
        i, j = np.searchsorted(sx, [lo, high])
        ends = np.cumsum(m[skx[i:j]])
        while i < j:  # as many rows at once as have some two million pairs
            till = i + max(1, int(np.searchsorted(ends, 2_000_000, side="right")))
            till = min(till, j)
            many = m[skx[i:till]]
            at = np.repeat(np.arange(i, till), many)
            to = np.repeat(start[skx[i:till]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            np.add.at(sums, (sx[at] - lo, sy[to]), np.minimum(scx[at], scy[to]).astype(exact))
            ends = ends[till - i :] - ends[till - i - 1]
            i = till
        hit = sums >= max(least, 1)
        if same:
            hit &= np.arange(ny)[None] > np.arange(lo, high)[:, None]
        a, b = np.nonzero(hit)
        if len(a):
            yield a + lo, b, sums[a, b].astype(np.int64)


def tile_matches(nodes: DataFrame, tiles: DataFrame) -> DataFrame:
    """Nodes with the contig tiles of their chunk and cluster, and whether the strands agree."""
    t = tiles.select("chunk", "cluster", "contig", F.col("at").alias("contig_at"), F.col("forward").alias("tile_forward"))
    return nodes.join(t, ["chunk", "cluster"]).withColumn("same_strand", F.col("is_forward") == F.col("tile_forward"))


def filled(edges: DataFrame, fills: DataFrame) -> DataFrame:
    """Canonical edges with the label that fills them."""
    return edges.join(fills, ["u", "u_forward", "v", "v_forward"])


def spanning_counts(nodes: DataFrame, heads: DataFrame, tails: DataFrame) -> DataFrame:
    """(head, tail, n): reads that hold a node of a head and one of a tail (key: chunk and cluster)."""
    h = nodes.join(heads.select("chunk", "cluster", "head"), ["chunk", "cluster"]).select("read_id", "head").distinct()
    t = nodes.join(tails.select("chunk", "cluster", "tail"), ["chunk", "cluster"]).select("read_id", "tail").distinct()
    return h.join(t, "read_id").groupBy("head", "tail").agg(F.count("*").alias("n"))


def contig_links(ends: DataFrame) -> DataFrame:
    """(a, b, n): pairs of contig ends, a < b, that one read touches. ends: (read_id, contig)."""
    e = ends.select("read_id", "contig").distinct()
    x, y = e.withColumnRenamed("contig", "a"), e.withColumnRenamed("contig", "b")
    return x.join(y, "read_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def layered_counts(nodes: DataFrame, chunk: int, cluster: int) -> DataFrame:
    """(dist, chunk, cluster, n): nodes at each distance after the first hit of a node in each read."""
    focus = nodes.where((F.col("chunk") == chunk) & (F.col("cluster") == cluster)).groupBy("read_id").agg(F.min("idx").alias("__at"))
    after = nodes.join(focus, "read_id").where("idx > __at")
    return after.groupBy((F.col("idx") - F.col("__at")).alias("dist"), "chunk", "cluster").agg(F.count("*").alias("n"))


def without_suppressed(alignments: DataFrame, most: float = 0.1, seed: int = 42) -> DataFrame:
    """Alignments (query, qstart, qend, score, id) of which none overlaps a picked one of its query by ``most``.

    Per query: pick one with a chance by the exponential of its score, drop what overlaps it too much,
    go on with the rest. The seed of a query follows from its name.
    """

    def run(key, t):
        import zlib

        import numpy as np
        import pyarrow as pa

        rng = np.random.default_rng([seed, zlib.crc32(str(key[0].as_py()).encode())])
        rows = sorted(t.to_pylist(), key=lambda r: r["id"])
        kept = []
        while rows:
            s = np.array([r["score"] for r in rows], dtype=float)
            p = np.exp(s - s.max())
            x = rows.pop(int(rng.choice(len(rows), p=p / p.sum())))
            kept.append(x["id"])

            def share(r, x=x):
                both = min(x["qend"], r["qend"]) - max(x["qstart"], r["qstart"])
                return max(0, both) / max(1, min(x["qend"] - x["qstart"], r["qend"] - r["qstart"]))

            rows = [r for r in rows if share(r) < most]
        return pa.table({"id": pa.array(kept, pa.int64())})

    kept = alignments.select("query", "qstart", "qend", "score", "id").groupBy("query").applyInArrow(run, "id long")
    return alignments.join(kept, "id", "left_semi")


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """Nodes of two encodings of the same reads, place by place: (read_id, idx, chunk, a, b)."""
    return left.select("read_id", "idx", "chunk", F.col("cluster").alias("a")).join(right.select("read_id", "idx", F.col("chunk").alias("__c"), F.col("cluster").alias("b")), ["read_id", "idx"]).where("chunk = __c").drop("__c")


def cluster_correlation(nodes: DataFrame, least: int = 7) -> DataFrame:
    """(a, b, n, ari): agreement of the clusters of two chunks over the reads that have both, a < b.

    A read counts with its least cluster of a chunk. Pairs of ``least`` reads or fewer are left out. Both
    labels constant: 0 for chunks of one cluster each, else 1; undefined: 0.
    """
    from longweave.functions.stats import contingency

    own = nodes.groupBy("read_id", "chunk").agg(F.min("cluster").alias("k"))
    pairs = own.withColumnsRenamed({"chunk": "a", "k": "ka"}).join(own.withColumnsRenamed({"chunk": "b", "k": "kb"}), "read_id").where("a < b")
    c = contingency(pairs, "ka", "kb", ["a", "b"]).where(F.col("n") > least)
    product = F.col("of_a") * F.col("of_b")
    half = F.floor(F.col("all") * (F.col("of_a") + F.col("of_b")) / 2)
    ari = F.when((F.col("of_a") == F.col("all")) & (F.col("of_b") == F.col("all")), F.lit(1.0)).when(half == product, F.lit(0.0)).otherwise((F.col("all") * F.col("both") - product) / (half - product))
    return c.select("a", "b", "n", ari.alias("ari"))
