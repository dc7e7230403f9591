"""Alignment kernels in numpy for one pair or group at a time, and the joins that propose pairs."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from math import ceil, log

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longweave.session import saved

#: Ends that an alignment may leave out for free: of the reference before and after.
MODES = {"global": (False, False), "infix": (True, True), "leading": (False, True), "trailing": (True, False)}


def _bytes(s) -> np.ndarray:
    return np.frombuffer(s.encode() if isinstance(s, str) else bytes(s), np.uint8)


def edit_align(query: str, reference: str, mode: str = "global") -> tuple[str, int, int, int]:
    """(ops, distance, start, end): ops of M, X, I, D, one letter a column, and the reference range.

    I is in the query only, D in the reference only. On ties a match or mismatch goes first, then I.
    """
    free_before, free_after = MODES[mode]
    q, r = _bytes(query), _bytes(reference)
    n, m = len(q), len(r)
    cost = np.zeros(m + 1, dtype=np.int32) if free_before else np.arange(m + 1, dtype=np.int32)
    along = np.arange(m + 1)
    across = np.zeros((n, m // 8 + 1), dtype=np.uint8)  # a bit a cell: whether these moves end there
    down = np.zeros((n, m // 8 + 1), dtype=np.uint8)
    for i in range(1, n + 1):
        base, both = np.empty(m + 1, dtype=np.int32), cost[:-1] + (r != q[i - 1])
        base[0] = i
        base[1:] = np.minimum(both, cost[1:] + 1)
        new = np.minimum.accumulate(base - along) + along  # gaps along the reference
        across[i - 1] = np.packbits(np.append(False, new[1:] == both), bitorder="little")
        down[i - 1] = np.packbits(new == cost + 1, bitorder="little")
        cost = new
    end = int(cost.argmin()) if free_after else m
    i, j, ops = n, end, []
    while i > 0 or (j > 0 and not (free_before and i == 0)):
        if i and j and across[i - 1, j >> 3] >> (j & 7) & 1:
            ops.append("M" if q[i - 1] == r[j - 1] else "X")
            i, j = i - 1, j - 1
        elif i and down[i - 1, j >> 3] >> (j & 7) & 1:
            ops.append("I")
            i -= 1
        else:
            ops.append("D")
            j -= 1
    return "".join(reversed(ops)), int(cost[end]), j, end


def compress(ops: str) -> str:
    """Column letters to a CIGAR of M, I, D; mismatches count as M."""
    out, ops = [], ops.replace("X", "M")
    at = 0
    while at < len(ops):
        end = at
        while end < len(ops) and ops[end] == ops[at]:
            end += 1
        out.append(f"{end - at}{ops[at]}")
        at = end
    return "".join(out)


def trimmed(ops: str, start: int, end: int) -> tuple[int, str, int, int, int]:
    """(head clip, ops, tail clip, start, end) without gaps at the ends: insertions become clips."""
    body = ops.lstrip("ID")
    lead = ops[: len(ops) - len(body)]
    core = body.rstrip("ID")
    tail = body[len(core) :]
    return lead.count("I"), core, tail.count("I"), start + lead.count("D"), end - tail.count("D")


def recovered(ops: str, query: str, reference: str) -> tuple[str, str, str]:
    """The three lines of an alignment: query, marks (bar, X or blank), reference."""
    top, mid, low, i, j = [], [], [], 0, 0
    for op in ops:
        a = query[i] if op != "D" else "-"
        b = reference[j] if op != "I" else "-"
        i, j = i + (op != "D"), j + (op != "I")
        top.append(a)
        low.append(b)
        mid.append(" " if "-" in (a, b) else "|" if a == b else "X")
    return "".join(top), "".join(mid), "".join(low)


def identity(ops: str) -> float:
    return ops.count("M") / len(ops) if ops else 0.0


def fine_mapping(read: str, chunk: str, sim_thr: float, edge: int = 100, edge_identity: float = 0.5) -> tuple[int, int, str] | None:
    """(start, end, CIGAR) of a chunk in a read, if it is there as a whole and at both its ends."""
    if len(read) < len(chunk) * (1 - sim_thr):  # can't reach the identity
        return None
    ops, _, start, end = edit_align(chunk, read, "infix")
    swap = ops.translate(str.maketrans("ID", "DI"))  # the read is the query from here on
    if identity(swap) <= 1 - sim_thr or identity(swap[:edge]) <= edge_identity or identity(swap[-edge:]) <= edge_identity:
        return None
    return start, end, compress(swap)


def chunk_overlap(a: list[tuple], b: list[tuple], gap_open: float = -1.0) -> tuple[float, str]:
    """(score, ops) of two reads as lists of (chunk, cluster, forward), ends free.

    +1 for equal nodes, -1 for equal chunks of other clusters, else never; a gap costs its opening and
    an insertion doesn't stand beside a deletion. Fewer than two matches or a score below 1: no alignment.
    """
    never = -1e7
    n, m = len(a), len(b)
    s = np.full((3, n + 1, m + 1), never)  # match, gap in b (I), gap in a (D)
    back = np.zeros((3, n + 1, m + 1), dtype=np.int8)
    s[0, 0, :] = s[0, :, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            x, y = a[i - 1], b[j - 1]
            w = (1 if x[1] == y[1] else -1) if x[0] == y[0] and x[2] == y[2] else never
            k = int(s[:, i - 1, j - 1].argmax())
            s[0, i, j], back[0, i, j] = s[k, i - 1, j - 1] + w, k
            up = (s[0, i - 1, j] + gap_open, s[1, i - 1, j])
            s[1, i, j], back[1, i, j] = max(up), int(up[1] > up[0])
            left = (s[0, i, j - 1] + gap_open, s[2, i, j - 1])
            s[2, i, j], back[2, i, j] = max(left), 2 * int(left[1] > left[0])
    ends = [(s[0, n, j], n, j) for j in range(m + 1)] + [(s[0, i, m], i, m) for i in range(n + 1)]
    best, i, j = max(ends, key=lambda e: e[0])
    k, ops = 0, ["D"] * (m - j) + ["I"] * (n - i)
    while i and j:
        p = int(back[k, i, j])
        ops.append("MID"[k])
        i, j, k = i - (k != 2), j - (k != 1), p
    ops += ["I"] * i + ["D"] * j
    text = "".join(reversed(ops))
    return (float(best), text) if best >= 1 and text.count("M") >= 2 else (0.0, "")


def posterior_overlap(x: list[np.ndarray], y: list[np.ndarray], sim, open_gap: float = -0.5, extend: float = -100.0) -> float:
    """Best score of aligning two contexts end to free end; sim scores a pair of posteriors."""
    n, m = len(x), len(y)
    s = np.full((3, n + 1, m + 1), -1e9)
    s[0, 0, :] = s[0, :, 0] = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            s[0, i, j] = s[:, i - 1, j - 1].max() + sim(x[i - 1], y[j - 1])
            s[1, i, j] = max(s[0, i - 1, j] + open_gap, s[1, i - 1, j] + extend)
            s[2, i, j] = max(s[0, i, j - 1] + open_gap, s[2, i, j - 1] + extend)
    return float(max(s[:, n, :].max(), s[:, :, m].max()))


def chains(anchors: list[tuple[int, int]], reward: float = 4000.0) -> list[list[int]]:
    """Chains of anchors (read, contig) rising in both, each of least cost, until all anchors are in one.

    An anchor earns ``reward``; a gap costs the log of its length, rounded up.
    """
    left, out = sorted(range(len(anchors)), key=lambda i: (anchors[i], i)), []
    while left:
        cost, prev = [], []
        for k, i in enumerate(left):
            best, at = 0.0, -1
            for p in range(k):
                dx, dy = anchors[i][0] - anchors[left[p]][0], anchors[i][1] - anchors[left[p]][1]
                if dx > 0 and dy > 0:
                    c = cost[p] + ceil(log(1 + abs(dx - dy)))
                    if c < best:
                        best, at = c, p
            cost.append(best - reward)
            prev.append(at)
        at = int(np.argmin(cost))
        chain = []
        while at >= 0:
            chain.append(left[at])
            at = prev[at]
        out.append(chain[::-1])
        used = set(chain)
        left = [i for i in left if i not in used]
    return out


def chunk_align(a: list[tuple], b: list[tuple], match: int = 10, other: int = -2, mismatch: int = -100, gap: int = -4) -> tuple[int, str]:
    """(score, ops) of a global alignment of (chunk, cluster) lists."""
    n, m = len(a), len(b)
    s = np.zeros((n + 1, m + 1), dtype=np.int64)
    s[:, 0], s[0, :] = gap * np.arange(n + 1), gap * np.arange(m + 1)
    w = lambda i, j: match if a[i - 1] == b[j - 1] else other if a[i - 1][0] == b[j - 1][0] else mismatch
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            s[i, j] = max(s[i - 1, j - 1] + w(i, j), s[i - 1, j] + gap, s[i, j - 1] + gap)
    i, j, ops = n, m, []
    while i or j:
        if i and j and s[i, j] == s[i - 1, j - 1] + w(i, j):
            ops.append("M")
            i, j = i - 1, j - 1
        elif i and s[i, j] == s[i - 1, j] + gap:
            ops.append("I")
            i -= 1
        else:
            ops.append("D")
            j -= 1
    return int(s[n, m]), "".join(reversed(ops))


def ballots(draft: str, seqs: dict[str, int]) -> list[Counter]:
    """What sequences, each so often, have at each place of a draft and, at odd positions, in between."""
    out = [Counter() for _ in range(2 * len(draft) + 1)]
    for s, n in seqs.items():
        ops, _, _, _ = edit_align(s, draft)
        i = j = 0
        extra = ""
        for op in ops:
            if op == "I":
                extra += s[i]
                i += 1
                continue
            out[2 * j][extra] += n
            extra = ""
            out[2 * j + 1][s[i] if op != "D" else ""] += n
            i, j = i + (op != "D"), j + 1
        out[2 * j][extra] += n
    return out


def elected(votes: list[Counter]) -> str:
    return "".join(max(c, key=lambda k: (c[k], k)) for c in votes)


def consensus(sequences: list[str], rounds: int = 2, least: int = 1) -> str | None:
    """Majority of the sequences along a draft of upper-median length; None below ``least`` sequences."""
    seqs = [s for s in sequences if s]
    if len(seqs) < least or not seqs:
        return None
    middle = sorted(map(len, seqs))[len(seqs) // 2]
    draft = next(s for s in seqs if len(s) == middle)
    for _ in range(rounds):
        new = elected(ballots(draft, Counter(seqs)))
        if new == draft:
            break
        draft = new
    return draft


#: Parts that a group's sequences are aligned in, so that a hot group is many tasks' work.
PARTS = 64


def grouped_consensus(df: DataFrame, keys: list[str], least: int = 1, most: int | None = None, rounds: int = 2) -> DataFrame:
    """(keys, n, seq): :func:`consensus` of each group of ``seq``; the draft is the least string of upper-median length.

    All sequences vote, or ``most`` of the smallest md5. Equal ones are counted first and aligned once;
    a group is aligned in parts that send their votes, so no task holds all of a hot group.
    """
    import json

    import pyarrow as pa

    if most is not None:
        first = Window.partitionBy(*keys).orderBy(F.md5("seq"), "seq")
        voters = df.where("length(seq) > 0").withColumn("__lw_at", F.row_number().over(first)).where(F.col("__lw_at") <= most)
    else:
        voters = df.where("length(seq) > 0")
    counted = saved(voters.groupBy(*keys, "seq").agg(F.count("*").alias("c")).withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(PARTS)).cast("int")), "counted")
    lengths = counted.groupBy(*keys, F.length("seq").alias("len")).agg(F.sum("c").alias("c"), F.min("seq").alias("seq"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("len").rowsBetween(Window.unboundedPreceding, 0)
    own = lengths.withColumns({"total": F.sum("c").over(whole), "upto": F.sum("c").over(upto)})
    draft = own.where(F.col("total") >= least).where("upto > total div 2 AND upto - c <= total div 2").select(*keys, "seq")
    parts = saved(counted.select(*keys, "part").distinct(), "parts")
    of_keys = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)

    def same(x, y):
        return reduce(lambda a, b: a & b, [x[k].eqNullSafe(y[k]) for k in keys])

    def head(t, rows=1):
        return [t.column(k).slice(0, rows) for k in keys]

    def vote(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({k: left.column(k).slice(0, 0) for k in keys} | {"votes": pa.array([], pa.string())})
        seqs = dict(zip(left.column("seq").to_pylist(), left.column("c").to_pylist(), strict=True))
        return pa.Table.from_arrays([*head(left), pa.array([json.dumps(ballots(right.column("seq")[0].as_py(), seqs))])], [*keys, "votes"])

    def elect(t):
        sums: list[Counter] = []
        for x in t.column("votes"):
            got = json.loads(x.as_py())
            sums = sums or [Counter() for _ in got]
            for c, d in zip(sums, got, strict=True):
                c.update(d)
        return pa.Table.from_arrays([*head(t), pa.array([elected(sums)])], [*keys, "seq"])

    for _ in range(rounds):
        draft = saved(draft, "draft")
        dealt = parts.join(draft, same(parts, draft)).select(*[parts[k] for k in keys], "part", draft["seq"])
        votes = counted.groupBy(*keys, "part").cogroup(dealt.groupBy(*keys, "part")).applyInArrow(vote, of_keys + ", votes string")
        draft = votes.groupBy(*keys).applyInArrow(elect, of_keys + ", seq string")
    draft = saved(draft, "draft")
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.join(draft, same(n, draft)).select(*[n[k] for k in keys], n["n"], draft["seq"])


#: Places of a k-mer in the targets up to which it is a seed at once, and that one part of a common one holds.
RARE, PLACES = 100, 1000


def seed_candidates(queries: DataFrame, targets: DataFrame, k: int = 15, least: int = 3, band: int = 64) -> DataFrame:
    """(query, target, forward, shift, seeds): places where ``least`` k-mers are shared around one diagonal.

    Both sides are (id, seq). Diagonals fall in bands that half overlap; of those beside one another the
    one with most seeds counts, so a target that stands in a query several times has a row for each.
    k-mers in RARE places of the targets or fewer seed all of them. Targets with fewer such places than
    others, e.g. of repeats only, are seeded by all their k-mers. Common k-mers are met in parts of
    PLACES, so no task holds all places of one.
    """
    from longweave.functions.sequence import reverse_complement
    from longweave.operators.masking import kmer_rows

    own = lambda df, name, s: kmer_rows(df.select("id", s.alias("seq")), k, "id").withColumnsRenamed({"id": name, "at": f"{name}_at"})
    t = saved(own(targets, "target", F.col("seq")), "kmers")
    n = saved(t.groupBy("kmer").agg(F.count("*").alias("n")), "places")
    many = n.where(F.col("n") > RARE)
    common = t.join(many.select("kmer"), "kmer", "left_semi").groupBy("target").agg(F.count("*").alias("common"))
    poor = t.groupBy("target").agg(F.count("*").alias("all")).join(common, "target").where("2 * common > all").select("target")
    rare = t.join(many.select("kmer"), "kmer", "left_anti")
    seeds = rare.unionByName(t.join(many.select("kmer"), "kmer", "left_semi").join(poor, "target", "left_semi"))
    hot = F.broadcast(n.where(F.col("n") > PLACES).select("kmer", F.ceil(F.col("n") / PLACES).cast("int").alias("parts")))  # a thousandth of the places at most
    seeds = seeds.join(hot, "kmer", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("target", "target_at"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    ahead = own(queries, "query", F.col("seq")).withColumn("forward", F.lit(True))
    back = own(queries, "query", reverse_complement(F.col("seq"))).withColumn("forward", F.lit(False))
    q = ahead.unionByName(back).join(hot, "kmer", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    hit = q.join(seeds, ["kmer", "part"]).where("query <> target").withColumn("d", F.col("query_at") - F.col("target_at"))
    bands = hit.withColumn("b", F.explode(F.array(F.floor(F.col("d") / band).cast("double"), F.floor(F.col("d") / band + 0.5) + F.lit(0.5))))
    n = bands.groupBy("query", "target", "forward", "b").agg(F.count("*").alias("seeds"), F.expr("sum(d) div count(*)").alias("shift")).where(F.col("seeds") >= least)
    along = Window.partitionBy("query", "target", "forward").orderBy("b")
    beside = lambda f, gap: F.coalesce(F.when(F.abs(f("b").over(along) - F.col("b")) <= 0.5, f("seeds").over(along)), F.lit(gap))
    best = n.withColumn("x", beside(F.lag, 0)).withColumn("y", beside(F.lead, 0)).where("seeds > x AND seeds >= y")
    return best.select("query", "target", "forward", "shift", "seeds")


def mapped(reads: DataFrame, chunks: DataFrame, sim_thr: float, k: int = 15, least: int = 3, slack: int = 100) -> DataFrame:
    """(read_id, chunk, pos, end, is_forward, cigar): chunks found in reads, ends and all."""
    import pyarrow as pa

    from longweave.functions.sequence import reverse_complement

    c = seed_candidates(reads.select(F.col("read_id").alias("id"), "seq"), chunks.select((-F.col("chunk") - 1).alias("id"), "seq"), k, least)
    c = c.select(F.col("query").alias("read_id"), (-F.col("target") - 1).alias("chunk"), "forward", "shift")
    c = c.join(chunks.select("chunk", F.col("seq").alias("chunk_seq")), "chunk").join(reads.select("read_id", "seq"), "read_id")
    oriented = F.when(F.col("forward"), F.col("seq")).otherwise(reverse_complement(F.col("seq")))
    start = F.greatest(F.col("shift") - slack, F.lit(0))
    c = c.select("read_id", "chunk", "forward", start.alias("start"), F.length("seq").alias("total"), "chunk_seq", F.substring(oriented, start + 1, F.length("chunk_seq") + 2 * slack).alias("part"))

    def run(batches):
        names = ["read_id", "chunk", "pos", "end", "is_forward", "cigar"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        for b in batches:
            rows = []
            for r in b.to_pylist():
                found = fine_mapping(r["part"], r["chunk_seq"], sim_thr)
                if found:
                    s, e = found[0] + r["start"], found[1] + r["start"]
                    s, e = (s, e) if r["forward"] else (r["total"] - e, r["total"] - s)
                    rows.append((r["read_id"], r["chunk"], s, e, r["forward"], found[2]))
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, kinds, strict=True)], names)

    return c.mapInArrow(run, "read_id long, chunk long, pos long, end long, is_forward boolean, cigar string").dropDuplicates(["read_id", "chunk", "pos", "end", "is_forward"])


def differences(df: DataFrame) -> DataFrame:
    """(key, at, op, len, query, reference): insertions and deletions of CIGARs (key, cigar) with where they are."""
    from longweave.functions.sequence import cigar_ops

    start = F.struct(F.lit(0).alias("q"), F.lit(0).alias("r"), F.array().cast("array<struct<op:string,len:int,query:int,reference:int>>").alias("out"))

    def step(acc, x):
        q = acc["q"] + F.when(x["op"].isin("M", "I"), x["len"]).otherwise(0)
        r = acc["r"] + F.when(x["op"].isin("M", "D"), x["len"]).otherwise(0)
        one = F.array(F.struct(x["op"].alias("op"), x["len"].alias("len"), acc["q"].alias("query"), acc["r"].alias("reference")))
        return F.struct(q.alias("q"), r.alias("r"), F.when(x["op"] == "M", acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    rows = F.aggregate(cigar_ops(F.col("cigar")), start, step, lambda acc: acc["out"])
    return df.select("key", F.posexplode(rows).alias("at", "x")).select("key", "at", "x.*")
