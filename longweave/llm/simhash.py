"""SimHash fingerprints, and near-duplicates by tiled exact comparison of all fingerprints.

Fingerprints are compared tile against tile in numpy with exclusive-or and bit counts. A tile pair is
skipped when the bit counts of the two tiles, taken over each eighth of the fingerprint, differ in
sum by more than the radius: that sum never exceeds the Hamming distance, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longweave.llm.common import as_bytes, beside, dealt_to_cells, forest, fresh, merged, small_batches, tidy, words_of
from longweave.operators.components import connected_components
from longweave.operators.joins import salted_join
from longweave.session import saved

#: Rows of a tile: two tiles' distances fit a core's cache.
TILE = 512
#: A stripe is what one task holds of each side; between these many fingerprints.
STRIPE = (4096, 262_144)
#: Stripes that a table of middling size is cut into.
STRIPES = 24
#: Bytes of shingle sets in a stripe that carries them, and in a part that stripes are merged from.
STRIPE_BYTES, PART_BYTES = 24 << 20, 1 << 20
#: Keys of linked texts up to which they are broadcast, some 60 bytes each.
BROADCAST_KEYS = 1_000_000
#: Links of one document whose sets a task meets.
SET_LINKS = 500
#: Words of a proposing fingerprint, and those that the radius holds for.
PROPOSING, NEAR_WORDS = 4, 2
#: Rows of a tile that are compared with another tile at once, so that what is worked out on the way stays in a core's cache.
ROWS = 64


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """k-word shingles, repeats included, joined by a space; the whole sequence if it is shorter."""
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)))


def hashed(texts: list[bytes], seed: int = 42) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(t, seed) for t in texts), np.uint64, len(texts))


def remixed(h: np.ndarray) -> np.ndarray:
    """Other 64 bits from each hash, as if hashed with another seed (the finalizer of splitmix64)."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def majorities(h: np.ndarray, words: int) -> bytes:
    """A fingerprint of so many words, each of the hashes remixed once more; the highest byte of a word first."""
    n, ones = len(h), np.zeros(64 * words, dtype=np.int64)
    for i in range(0, n, 255):  # sums of up to 255 rows fit a byte
        own = [h[i : i + 255]]
        while len(own) < words:
            own.append(remixed(own[-1]))
        bits = np.unpackbits(np.stack(own, axis=1).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64).byteswap().tobytes()


def majority(h: np.ndarray) -> np.uint64:
    """The 64 bits that are set in over half of the hashes; zero without any."""
    n = len(h)
    if n == 0:
        return np.uint64(0)
    bits = np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 255):  # sums of up to 255 rows fit a byte
        ones += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]


def fingerprint(text: str | None, k: int = 3, seeds: tuple[int, ...] = (42,), distinct: bool = False) -> tuple[np.ndarray, int]:
    """One 64-bit word a seed, and the number of shingles."""
    s = shingles(words_of(text), k)
    if distinct:
        s = list(set(s))
    return np.array([majority(hashed(s, seed)) for seed in seeds], dtype=np.uint64), len(s)


def fingerprints(docs: DataFrame, k: int = 3, words: int = 1, distinct: bool = False) -> DataFrame:
    """(doc_id, fp, n_shingles, text_key) for every row.

    ``fp`` holds the fingerprint's 64-bit words as bytes, the highest byte of each first; ``text_key`` is a 128-bit hash of the
    sequence of words, equal for texts that differ in spacing or A-Z case only. Null and empty texts
    have a zero fingerprint and no shingles.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, n, key = [], [], []
            for text in as_bytes(batch.column(1)):
                w = words_of(text)
                s = shingles(w, k)
                s = list(set(s)) if distinct else s
                fp.append(majorities(hashed(s), words))
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(b" ".join(w)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp, pa.binary()), pa.array(n, pa.int64()), pa.array(key, pa.binary())], ["doc_id", "fp", "n_shingles", "text_key"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, fp binary, n_shingles long, text_key binary")


def _counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of each eighth of the fingerprints; fp: rows by 64-bit words."""
    n, words = fp.shape
    by_byte = np.bitwise_count(np.ascontiguousarray(fp).view(np.uint8).reshape(n, 8 * words))
    return by_byte.reshape(n, 8, words).sum(axis=2, dtype=np.int16)


def _striped(nodes: DataFrame, words: int, by_size: bool) -> tuple[DataFrame, int]:
    """Nodes in ranges of size or of bit counts, and the rows a stripe should have. One row holds up to TILE nodes.

    Nodes with ``comp`` and ``grams`` keep them: the components and, end to end, the shingle sets.
    """
    sets = "grams" in nodes.columns
    if sets:
        total, size = nodes.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("grams")), F.lit(0))).first()
        rows = STRIPE[0]
        n = max(1, -(-total // rows), -(-size // PART_BYTES))
    else:
        total = nodes.count()
        rows = int(np.clip(total // STRIPES, *STRIPE))
        n = max(1, -(-total // rows))
    parts = [F.expr("conv(substr(hex(fp), %d, 2), 16, 10)" % (2 * i + 1)) for i in range(8 * words)]
    first = [F.col("n_shingles")] if by_size else [sum(F.bit_count(p.cast("long")) for p in parts[: 4 * words]), sum(F.bit_count(p.cast("long")) for p in parts[4 * words :])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        node, size = t.column("node").to_numpy(), t.column("n_shingles").to_numpy()
        fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), dtype=np.uint64).reshape(len(node), -1)
        c = _counts(fp[:, :words])
        keys = [node, *c.T[::-1]] + ([size] if by_size else [c[:, 4:].sum(axis=1), c[:, :4].sum(axis=1)])
        order = np.lexsort(keys)
        part, out = TaskContext.get().partitionId(), []
        comp = t.column("comp").to_numpy() if sets else None
        for i in range(0, len(order), TILE):
            at = order[i : i + TILE]
            out.append((part, node[at].tobytes(), fp[at].tobytes(), size[at].astype(np.int64).tobytes(), c[at].min(axis=0).tolist(), c[at].max(axis=0).tolist(), int(size[at].min()), int(size[at].max())))
            if sets:
                grams = [t.column("grams")[int(x)].as_py() for x in at]
                out[-1] += (comp[at].tobytes(), b"".join(grams), np.cumsum([len(g) // 8 for g in grams]).astype(np.int64).tobytes())
        names = ["part", "node", "fp", "size", "low", "high", "least", "most"] + ["comp", "grams", "ends"] * sets
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64()] + [pa.binary()] * 3 * sets
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    spread = nodes.repartitionByRange(n, *first, F.col("node"))
    more = ", comp binary, grams binary, ends binary" if sets else ""
    return spread.mapInArrow(cut, "part int, node binary, fp binary, size binary, low array<int>, high array<int>, least long, most long" + more), rows


def _hits(x: np.ndarray, y: np.ndarray, radius: int, words: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, rows, distances) of the fingerprints whose first words differ in ``radius`` bits at most; of ``same`` ones each pair once."""
    A, B, D = [], [], []
    ys = [np.ascontiguousarray(y[:, w]) for w in range(words)]
    both, bits, d = (np.empty((ROWS, len(y)), t) for t in (np.uint64, np.uint8, np.uint8))
    for lo in range(0, len(x), ROWS):
        own = x[lo : lo + ROWS]
        n = len(own)
        for w in range(words):
            np.bitwise_xor(own[:, w, None], ys[w][None], out=both[:n])
            np.bitwise_count(both[:n], out=bits[:n] if w else d[:n])
            if w:
                np.add(d[:n], bits[:n], out=d[:n])
        a, b = np.nonzero(d[:n] <= radius)
        dist = d[a, b]
        a += lo
        if same:
            above = b > a
            a, b, dist = a[above], b[above], dist[above]
        if len(a):
            A.append(a)
            B.append(b)
            D.append(dist)
    return tuple(np.concatenate(z) if z else np.zeros(0, np.int64) for z in (A, B, D))


def _met(tiles: list[tuple], radius: int, words: int, ratio: float, whole: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(tile, tile, rows, rows, distances) of one cell's pairs within ``radius``; tiles: (side, node, fp, size, low, high, least, most, ...).

    The radius holds for the first ``words``. With ``whole``, all words of a pair differ in that many bits
    at most, and the distance is that of all of them.
    """
    low, high = np.array([x[4] for x in tiles]), np.array([x[5] for x in tiles])
    least, most = np.array([x[6] for x in tiles]), np.array([x[7] for x in tiles])
    side = np.array([x[0] for x in tiles])
    for i, x in enumerate(tiles):
        js = np.arange(len(tiles))
        js = js[(js >= i) if x[0] == 2 else (side == 1) & (x[0] == 0)]
        if not len(js):
            continue
        gap = np.maximum(0, np.maximum(low[js] - high[i], low[i] - high[js])).sum(axis=1)
        js = js[gap <= radius]
        if ratio:
            js = js[(most[js] >= ratio * least[i] - 1e-9) & (most[i] >= ratio * least[js] - 1e-9)]
        for j in js:
            y = tiles[j]
            a, b, d = _hits(x[2], y[2], radius, words, i == j)
            if ratio and len(a):
                s, t = x[3][a], y[3][b]
                ok = np.minimum(s, t) >= ratio * np.maximum(s, t) - 1e-9
                ok &= (d == 0) | (np.maximum(s, t) * (1 - ratio) >= 1 - 1e-9)  # of so few shingles none may differ
                a, b, d = a[ok], b[ok], d[ok]
            if whole is not None and len(a):
                d = np.bitwise_count(x[2][a] ^ y[2][b]).sum(axis=1, dtype=np.int64)
                ok = d <= whole
                a, b, d = a[ok], b[ok], d[ok]
            if len(a):
                yield i, j, a, b, d


def _starts(tiles: list[tuple]) -> np.ndarray:
    return np.cumsum([0] + [len(x[1]) for x in tiles])


def _cell(tiles: list[tuple], radius: int, words: int, ratio: float, whole: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forest edges (node, node, distance) of one cell."""
    where, A, B, D = _starts(tiles), [], [], []
    node = np.concatenate([x[1] for x in tiles])
    for i, j, a, b, dist in _met(tiles, radius, words, ratio, whole):
        n = len(tiles[i][1])
        keep = forest(n + len(tiles[j][1]), a, b + (0 if i == j else n), dist)
        A.append(a[keep] + where[i])
        B.append(b[keep] + where[j])
        D.append(dist[keep])
    if not A:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, d = np.concatenate(A), np.concatenate(B), np.concatenate(D)
    keep = forest(len(node), a, b, d)
    return node[a[keep]], node[b[keep]], d[keep].astype(np.int64)


def alike(s: np.ndarray, t: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets have Jaccard similarity of ``threshold`` or more."""
    both = len(np.intersect1d(s, t, assume_unique=True))
    return both >= threshold * (len(s) + len(t) - both) - 1e-9


def _true_cell(tiles: list[tuple], radius: int, words: int, ratio: float, whole: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (node, node, distance) of sets alike by ``ratio`` that join all that any such link of the cell within ``radius`` joins.

    Tiles end with (components, sets). Nearest pairs are tested first, and each pair whose ends are not
    joined by then, by their component or by a link found before, so none of another group is passed over.
    """
    where, sets = _starts(tiles), [g for x in tiles for g in x[9]]
    node = np.concatenate([x[1] for x in tiles])
    root = np.unique(np.concatenate([x[8] for x in tiles]), return_inverse=True)[1]
    out = []
    for i, j, a, b, dist in _met(tiles, radius, words, ratio, whole):
        order = np.argsort(dist, kind="stable")
        a, b, dist = a[order] + where[i], b[order] + where[j], dist[order]
        while len(a):
            live = root[a] != root[b]
            a, b, dist = a[live], b[live], dist[live]
            for k in range(len(a)):
                if alike(sets[a[k]], sets[b[k]], ratio):
                    out.append((node[a[k]], node[b[k]], dist[k]))
                    root[root == root[b[k]]] = root[a[k]]
                    break
            else:
                break
            a, b, dist = a[k + 1 :], b[k + 1 :], dist[k + 1 :]
    return tuple(np.array(x, dtype=np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def tiled_links(nodes: DataFrame, radius: int, words: int = 1, ratio: float = 0.0, whole: int | None = None) -> DataFrame:
    """(a, b, d): links within ``radius`` that join all that any links within it join.

    nodes: (node long, fp binary, n_shingles long), one row a fingerprint. Every pair of nodes is
    compared but for tile pairs that can't hold a link. Of what links in a cell only a minimum
    spanning forest comes out, so large groups give no more rows than they have members in a cell.
    With ``ratio``, only pairs whose sizes have at least that ratio link, and stripes are ranges of
    size so that most pairs of stripes are never met.

    The radius is that of the first ``words`` of a fingerprint. With ``whole``, all its words may differ
    in that many bits at most; they are looked at where the first ones are within the radius.

    Nodes that also have ``comp`` (long) and ``grams`` (sorted hashes as bytes) link only if their sets
    have Jaccard similarity ``ratio``, and where ``comp`` doesn't join them already.
    """
    sets = "grams" in nodes.columns
    stripes, rows = _striped(nodes, words, bool(ratio))
    stripes = saved(stripes, "stripes")
    box = stripes.groupBy("part").agg(F.sum(F.octet_length("node") / 8).alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), *[F.min(F.col("low")[i]).alias(f"l{i}") for i in range(8)], *[F.max(F.col("high")[i]).alias(f"h{i}") for i in range(8)]).orderBy("part").collect()
    if sets:
        held = {r["part"]: r["n"] for r in stripes.groupBy("part").agg(F.sum(F.octet_length("grams")).alias("n")).collect()}
        own = merged([max(held[r["part"]], int(r["n"]) * STRIPE_BYTES // rows) for r in box], STRIPE_BYTES)
    else:
        own = merged([int(r["n"]) for r in box], rows)
    low = np.array([np.min([[box[p]["least"]] + [box[p][f"l{i}"] for i in range(8)] for p in s], axis=0) for s in own]).reshape(len(own), 9)
    high = np.array([np.max([[box[p]["most"]] + [box[p][f"h{i}"] for i in range(8)] for p in s], axis=0) for s in own]).reshape(len(own), 9)

    def near(lo, hi, los, his):
        ok = np.maximum(0, np.maximum(los[:, 1:] - hi[1:], lo[1:] - his[:, 1:])).sum(axis=1) <= radius
        return ok & (his[:, 0] >= ratio * lo[0] - 1e-9) & (hi[0] >= ratio * los[:, 0] - 1e-9) if ratio else ok

    def compare(key, batch):
        c = {n: batch.column(n).to_pylist() for n in batch.column_names}
        tiles = [(s, np.frombuffer(n, np.int64), np.frombuffer(f, np.uint64).reshape(len(n) // 8, -1), np.frombuffer(z, np.int64), lo, hi, x, y) for s, n, f, z, lo, hi, x, y in zip(c["side"], c["node"], c["fp"], c["size"], c["low"], c["high"], c["least"], c["most"], strict=True)]
        if sets:
            own = [np.split(np.frombuffer(g, np.uint64), np.frombuffer(e, np.int64)[:-1]) for g, e in zip(c["grams"], c["ends"], strict=True)]
            tiles = [(*x, np.frombuffer(p, np.int64), g) for x, p, g in zip(tiles, c["comp"], own, strict=True)]
        a, b, d = (_true_cell if sets else _cell)(tiles, radius, words, ratio, whole)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "d": pa.array(d, pa.int64())})

    cells, total = dealt_to_cells(stripes, [[box[p]["part"] for p in s] for s in own], low, high, near)
    n = max(2 * stripes.sparkSession.sparkContext.defaultParallelism, min(total, 4096))
    return cells.repartition(n, "cell").groupBy("cell").applyInArrow(compare, "a long, b long, d long")


def near_duplicates(docs: DataFrame, radius: int = 3, k: int = 3) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id, n_shingles.

    Fingerprints link at ``radius`` or fewer differing bits; rows with one fingerprint are linked, so
    only distinct fingerprints are compared. The component is the smallest doc_id reachable, itself
    included. Texts without words (null, empty, spaces) have fingerprint zero and link like others.
    Repeated rows are kept; rows whose doc_id is null link nothing and have the component of their
    fingerprint; an empty table gives no rows; other columns of ``docs`` are not read.
    """
    prints = saved(fingerprints(docs, k).drop("text_key"), "prints")
    nodes = saved(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n_shingles")), "nodes")
    comp = connected_components(tiled_links(nodes, radius))
    by_print = nodes.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = prints.join(by_print, "fp", "left")
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id", "n_shingles")


def similar_documents(docs: DataFrame, threshold: float = 0.8, k: int = 5, radius: int = 38) -> DataFrame:
    """(doc_id, component_id): groups of texts whose sets of k-word shingles have Jaccard similarity of ``threshold`` or more.

    256-bit SimHash over distinct shingles proposes: at similarity 0.8 the expected distance of the first
    128 bits is 19 and 38 lies over four standard deviations above it; that of all bits is 39 and 78 lies
    over six above. Two texts that share nothing pass the first with chance 2.5e-6, which in millions of
    texts links all of them into one group, and both with chance 9e-11. Tile pairs whose numbers of shingles can't reach
    the threshold are skipped. Links are verified exactly: first the nearest that hold each cell's groups
    together, so a group of thousands of copies costs no pairs of all its members; then, where some of
    those fail, all others between parts that are still separate, with the shingle sets in the cells.

    Texts of equal word sequences are one node. Rows without words form no group with others. Null
    doc_ids have a null component; an empty table gives no rows.
    """
    return grouped(docs, threshold, k, radius).select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def grouped(docs: DataFrame, threshold: float, k: int, radius: int) -> DataFrame:
    """(doc_id, text_key, component, component_id): :func:`similar_documents` by text; no component without words or id.

    A node is a text and not a doc_id, so rows that share an id but not a text are apart.
    """
    prints = saved(fingerprints(docs, k, PROPOSING, distinct=True), "prints")
    some = prints.where("doc_id IS NOT NULL AND n_shingles > 0")
    nodes = some.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.max("n_shingles").alias("n_shingles"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    links = saved(tiled_links(nodes.select("node", "fp", "n_shingles"), radius, NEAR_WORDS, threshold, 2 * radius + 2).groupBy("a", "b").agg(F.min("d").alias("d")), "links")
    sets = linked_sets(docs, nodes, links, k)
    true = saved(verified(links, sets, threshold), "true")
    comp = connected_components(true)
    open_ = saved(still_open(links, comp).join(nodes.select("node", "fp", "n_shingles"), "node").join(sets, "node"), "open")
    if open_.limit(1).count():
        comp = connected_components(true.unionByName(tiled_links(open_, radius, NEAR_WORDS, threshold, 2 * radius + 2).select("a", "b")))
    of = saved(nodes.join(comp, "node", "left").select("text_key", "least", F.coalesce("component", "node").alias("component")), "components")
    first = of.groupBy("component").agg(F.min("least").alias("component_id"))
    by_text = of.join(first, "component").select("text_key", "component", "component_id")
    return prints.join(by_text, "text_key", "left").select("doc_id", "text_key", "component", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, threshold: float = 0.8, k: int = 5, radius: int = 38) -> DataFrame:
    """``docs`` with the row of smallest doc_id of each group of :func:`similar_documents`.

    Rows without words or without a doc_id stay, however often they are repeated. Rows that repeat a
    doc_id are told apart by their words: of equal ones one row stays, the others belong to groups of
    their own. If two rows of a group have its smallest doc_id, the one whose text hashes less stays.
    Very long texts are hashed as a whole. Columns may have any names; an empty table gives no rows.
    """
    at, key, best = fresh(docs, "__lw_id", "__lw_key", "__lw_best")
    groups = saved(grouped(docs, threshold, k, radius).where("component_id IS NOT NULL"), "groups")
    gone = saved(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(at)).distinct(), "gone")
    twice = saved(groups.groupBy(F.col("doc_id").alias(at)).agg(F.count("*").alias("n")).where("n > 1").select(at), "twice")
    own = F.col("doc_id").cast("long") == F.col(at)
    if not twice.limit(1).count():
        return docs.join(beside(gone), own, "left_anti")
    once = docs.join(beside(gone.unionByName(twice).distinct()), own, "left_anti")
    first = groups.where("doc_id = component_id").groupBy("component", "component_id").agg(F.min("text_key").alias(best)).select(F.col("component_id").alias(at), best)
    again = with_text_key(docs.join(beside(twice), own, "left_semi"), key)
    worded = again.where(F.col(key).isNotNull())
    kept = worded.join(first, own & (F.col(key) == F.col(best)), "left_semi").dropDuplicates(["doc_id", key])
    return once.unionByName(kept.drop(key)).unionByName(again.where(F.col(key).isNull()).drop(key))


def with_text_key(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` and column ``name``, the hash of a text's words; null without any."""
    from pyspark.sql import types as T

    small_batches(docs.sparkSession)
    at, schema = docs.columns.index("text"), T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in as_bytes(batch.column(at))]
            keys = [xxhash.xxh3_128_digest(b" ".join(w)) if w else None for w in words]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, name])

    return docs.mapInArrow(tidy(run), schema)


def linked_sets(docs: DataFrame, nodes: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """(node, grams): the sorted distinct hashes, as bytes, of the k-word shingles of the ends of ``links``."""
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    of = saved(nodes.join(ends, "node", "left_semi").select("node", "text_key", "least"), "ends")
    texts = docs.select(F.col("doc_id").cast("long").alias("least"), F.col("text").cast("string").alias("text"))
    wanted = texts.join(beside(of.select("least").distinct()), "least", "left_semi")

    def run(batches):
        for batch in batches:
            words = [words_of(t) for t in as_bytes(batch.column(1))]
            sets = [np.unique(hashed(shingles(w, k))).tobytes() for w in words]
            keys = [xxhash.xxh3_128_digest(b" ".join(w)) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["text_key", "grams"])

    found = wanted.mapInArrow(tidy(run), "text_key binary, grams binary")
    keys = of.select("text_key", "node")
    keys = F.broadcast(keys) if of.count() <= BROADCAST_KEYS else keys
    return saved(found.join(keys, "text_key").select("node", "grams").dropDuplicates(["node"]), "sets")


def verified(links: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The links whose sets have Jaccard similarity of ``threshold`` or more; a node with very many links is met in parts."""
    one = salted_join(links.select("a", "b"), sets.withColumnsRenamed({"node": "a", "grams": "ga"}), "a", "b", heavy=SET_LINKS)
    both = salted_join(one, sets.withColumnsRenamed({"node": "b", "grams": "gb"}), "b", "a", heavy=SET_LINKS).select("a", "b", "ga", "gb")

    def test(batches):
        for batch in batches:
            ok = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), threshold) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(tidy(test), "a long, b long")


def still_open(links: DataFrame, true: DataFrame) -> DataFrame:
    """(node, comp): nodes whose group by ``links`` falls apart by the components ``true``, with those.

    Any other link within the radius joins two nodes of one group by ``links``; a group of two has none.
    """
    met = connected_components(links).withColumnRenamed("component", "met")
    both = saved(met.join(true, "node", "left").select("node", "met", F.coalesce("component", "node").alias("comp")), "met")
    apart = both.groupBy("met").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("n")).where("x <> y AND n > 2")
    return both.join(apart.select("met"), "met", "left_semi").select("node", "comp")
