"""Embedding near-dedup with binary codes of a randomised rotation and stored correction factors.

A unit vector o is rotated and kept as the signs of its components: a corner c of the cube, scaled to
length 1, and the factor f = <c, o>. The rotated vector itself is kept in 6 bits a component, rounded
up or down by chance so that <c, q> is met without bias. <c, q> / f then estimates <o, q> without bias,
by ands and bit counts of the sign code with the bit planes of q. The part of o beside c points
anywhere at right angles to o, so the estimate errs by sqrt((1 - f²) / f²) sqrt(1 - <o, q>²) times one
component of a random direction, which exceeds CONFIDENCE / sqrt(dim - 1) with chance under 1e-10 at 64
dimensions; rounding exceeds its bound with chance 1e-12. Before that, pairs whose sign codes differ in
more bits than linked vectors' do but with chance MISS are passed over by exclusive-or. So a link is
missed with chance 2e-10 or so; what is found is recomputed in double precision, so none is wrong.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, comb, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longweave.llm.common import dealt_to_cells, forest, merged, tidy
from longweave.operators.components import connected_components
from longweave.session import saved

THRESHOLD = 0.95
#: Standard deviations of the bound around an estimate, and the chance that a link's codes differ too much.
CONFIDENCE, MISS = 6.0, 1e-10
#: Bits of a component of a rotated vector.
PLANES = 6
#: Vectors in a stripe, at least and at most, and stripes for a table of middling size.
STRIPE, STRIPES = (1024, 32_768), 8
#: Vectors that the ordering direction is fitted on; any direction gives the same links.
AXIS_ROWS = 2000
_BLOCK = 512


def rotation(dim: int, seed: int = 42) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits in 64-bit words."""
    n, dim = bits.shape
    out = np.zeros((n, 8 * -(-dim // 64)), dtype=np.uint8)
    own = np.packbits(bits, axis=1)
    out[:, : own.shape[1]] = own
    return out.view(np.uint64)


class Codes:
    """Codes of unit vectors: sign words, factors, bit planes (rows, planes, words), offsets and steps."""

    def __init__(self, dim: int, sign, factor, planes, low, step) -> None:
        self.dim, self.sign, self.factor, self.planes, self.low, self.step = dim, sign, factor, planes, low, step
        self.ones = np.bitwise_count(sign).sum(axis=1, dtype=np.int64)
        self.total = (np.bitwise_count(planes).sum(axis=2, dtype=np.int64) << np.arange(PLANES)).sum(axis=1)

    @classmethod
    def of(cls, unit: np.ndarray, turn: np.ndarray, seed: int = 1) -> Codes:
        y = unit @ turn.T
        low = y.min(axis=1)
        step = np.maximum((y.max(axis=1) - low) / ((1 << PLANES) - 1), 1e-12)
        u = np.floor((y - low[:, None]) / step[:, None] + np.random.default_rng(seed).random(y.shape))
        u = np.clip(u, 0, (1 << PLANES) - 1).astype(np.uint8)
        planes = np.stack([_packed(u >> p & 1) for p in range(PLANES)], axis=1)
        return cls(unit.shape[1], _packed(y >= 0), np.abs(y).sum(axis=1) / sqrt(unit.shape[1]), planes, low, step)

    def __getitem__(self, at) -> Codes:
        return Codes(self.dim, self.sign[at], self.factor[at], self.planes[at], self.low[at], self.step[at])


def most_bits(dim: int, threshold: float, miss: float = MISS) -> int:
    """Bits in which codes of vectors at the threshold differ at most, but with chance ``miss``."""
    p, left = acos(max(-1.0, min(1.0, threshold))) / pi, 1.0
    for h in range(dim):
        left -= comb(dim, h) * p**h * (1 - p) ** (dim - h)
        if left <= miss:
            return h
    return dim


def estimates(a: Codes, b: Codes, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """<c, q> of pairs: the code of row i of ``a`` with the rotated row j of ``b``."""
    dot = np.zeros(len(i), dtype=np.int64)
    for w in range(a.sign.shape[1]):
        own = a.sign[i, w]
        for p in range(PLANES):
            dot += np.bitwise_count(own & b.planes[j, p, w]).astype(np.int64) << p
    return ((2 * dot - b.total[j]) * b.step[j] + b.low[j] * (2 * a.ones[i] - a.dim)) / sqrt(a.dim)


def survivors(a: Codes, b: Codes, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) that the codes can't tell to be below the threshold."""
    far, most = np.zeros((len(a.sign), len(b.sign)), dtype=np.uint16), most_bits(a.dim, threshold)
    for w in range(a.sign.shape[1]):
        far += np.bitwise_count(a.sign[:, w, None] ^ b.sign[None, :, w])
    i, j = np.nonzero(far <= most)
    keep = []
    beside = sqrt(max(0.0, 1 - threshold**2)) * min(1.0, CONFIDENCE / sqrt(max(1, a.dim - 1)))
    rounding = sqrt(log(1e12) / 2)
    for lo in range(0, len(i), 1 << 18):
        x, y = i[lo : lo + (1 << 18)], j[lo : lo + (1 << 18)]
        least = a.factor[x] * threshold - np.sqrt(np.maximum(0, 1 - a.factor[x] ** 2)) * beside - rounding * b.step[y] - 1e-6
        keep.append(estimates(a, b, x, y) >= least)
    ok = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[ok], j[ok]


def _sides(side: np.ndarray) -> tuple[bool, np.ndarray, np.ndarray]:
    one = side[0] == 2
    left = np.arange(len(side)) if one else np.nonzero(side == 0)[0]
    return one, left, left if one else np.nonzero(side == 1)[0]


def _met(codes: Codes, side: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Surviving pairs of a cell, block by block."""
    one, left, right = _sides(side)
    for lo in range(0, len(left), _BLOCK):
        a, b = left[lo : lo + _BLOCK], right[lo:] if one else right
        if not len(b):
            continue
        i, j = survivors(codes[a], codes[b], threshold)
        if one:
            i, j = i[j > i], j[j > i]  # b starts at the block's own first row
        yield a[i], b[j]


def _exact(unit: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Double-precision cosines of pairs of rows."""
    return np.concatenate([np.einsum("ij,ij->i", unit[i[k : k + 100_000]], unit[j[k : k + 100_000]]) for k in range(0, len(i), 100_000)]) if len(i) else np.zeros(0)


def _cell(node, mult, unit, codes: Codes, side, threshold):
    """(links of each node, forest edges) between the sides of a cell."""
    links = np.zeros(len(node), dtype=np.int64)
    A, B = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in _met(codes, side, threshold):
        ok = _exact(unit, i, j) >= threshold
        i, j = i[ok], j[ok]
        links += np.bincount(i, weights=mult[j], minlength=len(node)).astype(np.int64)
        links += np.bincount(j, weights=mult[i], minlength=len(node)).astype(np.int64)
        f = forest(len(node), i, j, np.zeros(len(i), np.uint8))
        A.append(i[f])
        B.append(j[f])
    a, b = np.concatenate(A), np.concatenate(B)
    f = forest(len(node), a, b, np.zeros(len(a), np.uint8))
    return links, node[a[f]], node[b[f]]


def _classes(vectors: DataFrame) -> DataFrame:
    """(node, mult, embedding): distinct usable vectors, with their least id and how often each occurs."""
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return vectors.where(ok & F.col("vec_id").isNotNull()).groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("mult"))


_CODE = "node long, sign binary, factor float, planes binary, low float, step float"


def _columns(codes: Codes) -> list[pa.Array]:
    n = len(codes.sign)
    blob = lambda x: pa.array([r.tobytes() for r in x.reshape(n, -1)], pa.binary())
    return [blob(codes.sign), pa.array(codes.factor.astype(np.float32)), blob(codes.planes), pa.array(codes.low.astype(np.float32)), pa.array(codes.step.astype(np.float32))]


def _codes_of(t: pa.Table, dim: int) -> Codes:
    words = -(-dim // 64)
    blob = lambda c: np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint64)
    number = lambda c: t.column(c).to_numpy().astype(np.float64)
    return Codes(dim, blob("sign").reshape(-1, words), number("factor"), blob("planes").reshape(-1, PLANES, words), number("low"), number("step"))


def _linked(nodes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(a, b, n): forest edges (n null), and links of a that one cell found (b null).

    Codes alone go to the cells at first. Vectors follow only to the cells in which their code has a
    surviving pair.
    """
    spark = nodes.sparkSession
    sized = nodes.where(F.size("embedding") == dim)
    total = sized.count()
    rows = int(np.clip(total // STRIPES, *STRIPE))
    some = np.array([r[0] for r in sized.select(F.transform("embedding", lambda x: x.cast("double"))).limit(AXIS_ROWS).collect()], dtype=np.float64)
    some /= np.abs(some).max(axis=1, keepdims=True)
    some /= np.linalg.norm(some, axis=1, keepdims=True)
    axis = np.linalg.svd(some - some.mean(axis=0), full_matrices=False)[2][0]
    turn = rotation(dim)
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6  # how far apart linked unit vectors can be

    def units(batch_column) -> np.ndarray:
        x = batch_column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = units(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(Codes.of(x, turn)), pa.array(x @ axis)], ["node", "sign", "factor", "planes", "low", "step", "along"])

    codes = sized.select("node", "embedding").mapInArrow(tidy(coded), _CODE + ", along double")
    spread = saved(codes.repartitionByRange(max(1, -(-total // rows)), "along", "node").withColumn("part", F.spark_partition_id()), "codes")
    box = spread.groupBy("part").agg(F.count("*").alias("n"), F.min("along").alias("lo"), F.max("along").alias("hi")).orderBy("part").collect()
    own = merged([r["n"] for r in box], rows)
    low, high = np.array([min(box[p]["lo"] for p in s) for s in own]), np.array([max(box[p]["hi"] for p in s) for s in own])
    reached = lambda lo, hi, los, his: (los <= hi + reach) & (lo <= his + reach)
    cells, count = dealt_to_cells(spread.drop("along"), [[box[p]["part"] for p in s] for s in own], low, high, reached)
    n = max(2 * spark.sparkContext.defaultParallelism, min(count, 4096))

    def screened(key, t):
        side = t.column("side").to_numpy()
        live = np.zeros(len(side), dtype=bool)
        for i, j in _met(_codes_of(t, dim), side, threshold):
            live[i] = live[j] = True
        return t.filter(pa.array(live))

    found = saved(cells.repartition(n, "cell").groupBy("cell").applyInArrow(screened, _CODE + ", cell long, side int"), "survivors")

    def compare(key, t):
        node, side = t.column("node").to_numpy(), t.column("side").to_numpy()
        links, a, b = _cell(node, t.column("mult").to_numpy(), units(t.column("embedding").combine_chunks()), _codes_of(t, dim), side, threshold)
        at = np.nonzero(links)[0]
        return pa.table({"a": pa.array(np.r_[a, node[at]], pa.int64()), "b": pa.array([*b.tolist(), *[None] * len(at)], pa.int64()), "n": pa.array([*[None] * len(a), *links[at].tolist()], pa.int64())})

    return found.join(sized, "node").repartition(n, "cell").groupBy("cell").applyInArrow(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Links are pairs with cosine >= threshold in double precision. Null, empty and zero vectors, and
    those with null or non-finite components, link with nothing, as do vectors of different lengths
    with one another. Equal vectors are compared as one and count as links of each other, so a group of
    thousands of copies costs no pairs. Rows with a null vec_id have no links, a null component and
    aren't kept; repeated ids count as vectors of their own. An empty table gives no rows; other
    columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"))
    nodes = saved(_classes(rows), "vectors")
    found = None
    for dim in sorted(r[0] for r in nodes.select(F.size("embedding")).distinct().collect()):
        more = _linked(nodes, dim, threshold)
        found = more if found is None else found.unionByName(more)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = saved(found, "links")
    comp = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    by = nodes.join(links, "node", "left").join(comp, "node", "left").select("embedding", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.join(by, (rows["embedding"] == by["embedding"]) & rows["vec_id"].isNotNull(), "left")
    comp_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(False)).alias("kept"))


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
n AS (SELECT x, count(*) AS n FROM link GROUP BY x),
c AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.x = vec_id
"""
