"""Filling in what an encoding lacks: chunks that other reads have beside a node, and new chunks for gaps and tips.

Nodes are (read_id, idx, node_id, pos, len, chunk, cluster, is_forward, cigar, score). A side of a chunk
is its tail (true) or head in its own direction, so reads of either strand count for one place.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longweave.functions.sequence import reverse_complement
from longweave.operators import rewrite
from longweave.operators.align import fine_mapping, grouped_consensus
from longweave.operators.joins import salted_join
from longweave.operators.ordered import adjacency
from longweave.session import drop_saved, saved

#: Reads that must have a chunk beside a node for it to be tried in others, unless the coverage is low.
LEAST_READS = 2
#: How far around the expected place a chunk is looked for, in its own length.
SLACK = 0.1

_NODE = ["read_id", "idx", "node_id", "pos", "len", "chunk", "cluster", "is_forward", "cigar", "score"]


def neighbours(nodes: DataFrame) -> DataFrame:
    """(chunk, tail, x_chunk, x_cluster, same, n, offset): what stands beside each side of a chunk.

    ``same`` says whether both have one direction; ``offset`` is the mean distance, negative for overlaps.
    Counts are summed on the map side, so a chunk in very many reads is no hot spot.
    """
    adj = adjacency(nodes)
    same = (F.col("from_forward") == F.col("to_forward")).alias("same")
    after = adj.select(F.col("from_chunk").alias("chunk"), F.col("from_forward").alias("tail"), F.col("to_chunk").alias("x_chunk"), F.col("to_cluster").alias("x_cluster"), same, "offset")
    before = adj.select(F.col("to_chunk").alias("chunk"), (~F.col("to_forward")).alias("tail"), F.col("from_chunk").alias("x_chunk"), F.col("from_cluster").alias("x_cluster"), same, "offset")
    return after.unionByName(before).groupBy("chunk", "tail", "x_chunk", "x_cluster", "same").agg(F.count("*").alias("n"), F.floor(F.avg("offset")).cast("long").alias("offset"))


def insertion_candidates(nodes: DataFrame, sequences: DataFrame, least: int = LEAST_READS) -> DataFrame:
    """(read_id, node_id, after, chunk, cluster, is_forward, start, length): where a read may lack a chunk.

    sequences: (chunk, cluster, seq). A candidate stands beside the node in ``least`` other places,
    isn't the node's neighbour in this read, and would begin before that neighbour ends it. ``after``
    tells which side of the node it is on, as the read runs.
    """
    own = Window.partitionBy("read_id").orderBy("idx")
    at = nodes.select(
        "read_id", "node_id", "pos", "len", "chunk", "is_forward",
        F.lag("chunk").over(own).alias("prev"), F.lag(F.col("pos") + F.col("len")).over(own).alias("prev_end"),
        F.lead("chunk").over(own).alias("next"), F.lead("pos").over(own).alias("next_pos"),
    )
    after = F.struct(F.lit(True).alias("after"), F.col("is_forward").alias("tail"), F.col("next").alias("beside"), F.col("next_pos").alias("limit"))
    before = F.struct(F.lit(False).alias("after"), (~F.col("is_forward")).alias("tail"), F.col("prev").alias("beside"), F.col("prev_end").alias("limit"))
    sides = at.select("read_id", "node_id", "pos", "len", "chunk", "is_forward", F.explode(F.array(after, before)).alias("s")).select("*", "s.*").drop("s")
    known = neighbours(nodes).where(F.col("n") >= least).withColumnsRenamed({"chunk": "a_chunk", "tail": "a_tail"})
    length = sequences.select(F.col("chunk").alias("x_chunk"), F.col("cluster").alias("x_cluster"), F.length("seq").cast("long").alias("length"))
    known = known.join(length, ["x_chunk", "x_cluster"])
    # a chunk has few neighbours: they go along as one row for each side, so the join is on a unique key
    packed = known.groupBy("a_chunk", "a_tail").agg(F.collect_list(F.struct("x_chunk", "x_cluster", "same", "offset", "length")).alias("xs"))
    key = F.concat_ws(":", F.col("chunk"), F.col("tail").cast("string"))
    met = salted_join(sides.withColumn("k", key), packed.select(F.concat_ws(":", "a_chunk", F.col("a_tail").cast("string")).alias("k"), "xs"), "k", "node_id")
    x = met.withColumn("x", F.explode("xs")).where("beside IS NULL OR x.x_chunk <> beside")
    start = F.when(F.col("after"), F.col("pos") + F.col("len") + F.col("x.offset")).otherwise(F.col("pos") - F.col("x.offset") - F.col("x.length"))
    x = x.select("read_id", "node_id", "after", F.col("x.x_chunk").alias("chunk"), F.col("x.x_cluster").alias("cluster"), (F.col("is_forward") == F.col("x.same")).alias("is_forward"), start.alias("start"), F.col("x.length").alias("length"), "limit")
    fits = F.when(F.col("limit").isNull(), True).when(F.col("after"), F.col("start") < F.col("limit")).otherwise(F.col("start") + F.col("length") > F.col("limit"))
    return x.where(fits).where(F.col("start") + F.col("length") > 0).drop("limit")


def placed(candidates: DataFrame, sequences: DataFrame, reads: DataFrame, sim_thr: float) -> DataFrame:
    """Candidates that are where they are expected, with ``pos``, ``len``, ``cigar`` and ``score`` (matches less others)."""
    import pyarrow as pa

    slack = F.ceil(F.col("length") * SLACK).cast("long")
    c = candidates.join(sequences, ["chunk", "cluster"]).withColumnRenamed("seq", "own").join(reads.select("read_id", F.col("seq").alias("__read")), "read_id")
    first = F.greatest(F.col("start") - slack, F.lit(0))
    last = F.least(F.col("start") + F.col("length") + slack, F.length("__read"))
    c = c.withColumn("__from", first).withColumn("__part", F.substring("__read", (first + 1).cast("int"), (last - first).cast("int"))).where(last > first).drop("__read")

    def run(batches):
        for b in batches:
            pos, size, cigar, score, keep = [], [], [], [], []
            part, own, ahead, begin = (b.column(b.schema.get_field_index(n)).to_pylist() for n in ("__part", "own", "is_forward", "__from"))
            for k in range(b.num_rows):
                text = part[k] if ahead[k] else part[k][::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))
                got = fine_mapping(text.upper(), own[k].upper(), sim_thr, edge=min(100, max(1, len(own[k]) // 4)))
                if not got:
                    continue
                s, e, ops = got
                at = begin[k] + (s if ahead[k] else len(text) - e)
                keep.append(k)
                pos.append(at)
                size.append(e - s)
                cigar.append(ops)
                score.append(min(e - s, len(own[k])) - 2 * abs(e - s - len(own[k])) - len(ops))
            names = ["read_id", "node_id", "after", "chunk", "cluster", "is_forward"]
            rows = b.select(names).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(pos, pa.int64()), pa.array(size, pa.int64()), pa.array(cigar, pa.string()), pa.array(score, pa.int64())], [*names, "pos", "len", "cigar", "score"])

    kinds = dict(c.dtypes)
    head = ", ".join(f"{n} {kinds[n]}" for n in ("read_id", "node_id", "after", "chunk", "cluster", "is_forward"))
    return c.mapInArrow(run, head + ", pos long, len long, cigar string, score long")


def consensus_by_cluster(nodes: DataFrame, chunks: DataFrame, reads: DataFrame) -> DataFrame:
    """(chunk, cluster, seq): a chunk's own sequence for cluster 0, the consensus of their nodes for the others."""
    from longweave.plans.stages import node_sequences

    own = nodes.select("chunk", "cluster").distinct().where("cluster = 0").join(chunks.select("chunk", "seq"), "chunk").select("chunk", "cluster", "seq")
    others = nodes.where("cluster <> 0")
    if not others.limit(1).count():
        return own
    voted = grouped_consensus(node_sequences(others, reads).select("chunk", "cluster", "seq"), ["chunk", "cluster"]).select("chunk", "cluster", "seq")
    return own.unionByName(voted)


def corrected_deletions(nodes: DataFrame, chunks: DataFrame, reads: DataFrame, sim_thr: float, outer: int = 3, inner: int = 12) -> tuple[DataFrame, DataFrame]:
    """(nodes, changed): nodes with the chunks that reads lack beside others, and the ids of chunks that were put in.

    Each inner round tries what stands beside a node in other reads but not in this one, at the place
    that the mean distance gives; what maps there joins the read, the best one for each side of a node.
    What failed isn't tried again until the outer round ends. Evidence are neighbours of single nodes
    and not alignments of whole reads, so a round costs joins on chunks instead of pairs of reads.
    Reads without nodes give nothing; null sequences map nowhere; an empty table stays empty.
    """
    spark = nodes.sparkSession
    now = saved(nodes.select(*_NODE), "nodes")
    sequences = saved(consensus_by_cluster(now, chunks, reads), "sequences")
    mean = now.groupBy("chunk").count().agg(F.avg("count")).first()[0] or 0.0
    least = max(1, min(LEAST_READS, int(mean / 5) or 1))
    changed = spark.createDataFrame([], "chunk long")
    tries = ["read_id", "node_id", "after", "chunk", "cluster"]
    for _ in range(outer):
        failed, grew = None, False
        for _ in range(inner):
            c = insertion_candidates(now, sequences, least)
            c = saved(c if failed is None else c.join(failed, tries, "left_anti"), "candidates")
            found = saved(placed(c, sequences, reads, sim_thr), "placed")
            if not found.limit(1).count():
                break
            best = found.withColumn("r", F.row_number().over(Window.partitionBy("read_id", "node_id", "after").orderBy(F.desc("score"), "chunk", "cluster"))).where("r = 1")
            new = best.select("read_id", F.lit(0).cast("int").alias("idx"), F.xxhash64("read_id", "chunk", "pos", "is_forward").alias("node_id"), "pos", "len", "chunk", "cluster", "is_forward", "cigar", "score").dropDuplicates(["node_id"])
            new = saved(new.join(now.select("node_id"), "node_id", "left_anti"), "new")
            if not new.limit(1).count():
                break
            score = dict(now.dtypes)["score"]
            both = now.unionByName(new.select(*[F.col(n).cast(score).alias(n) if n == "score" else F.col(n) for n in _NODE]))
            both = both.withColumn("idx", F.row_number().over(Window.partitionBy("read_id").orderBy("pos", "node_id")).cast("int"))
            both = rewrite.reindexed(rewrite.without_contained(rewrite.without_slippy(both)))
            after = saved(both.select(*_NODE), "nodes")
            if not after.join(now.select("node_id"), "node_id", "left_anti").limit(1).count():
                break  # what was put in lost to what is there
            changed = saved(changed.unionByName(new.select("chunk")).distinct(), "changed")
            lost = c.select(*tries)
            failed = saved(lost if failed is None else failed.unionByName(lost).distinct(), "failed")
            drop_saved(now)
            now, grew = after, True
        if not grew:
            break
    return now, changed


def gap_sequences(nodes: DataFrame, reads: DataFrame, least_gap: int, edges: DataFrame | None = None) -> DataFrame:
    """(u, u_forward, v, v_forward, read_id, idx, flipped, start, seq): what reads have between neighbours further apart than ``least_gap``.

    Sequences run from u to v, the lesser reading of the edge; ``edges`` (u, u_forward, v, v_forward) keeps those alone.
    """
    adj = adjacency(nodes).where(F.col("offset") >= least_gap)
    ends = nodes.select("read_id", "idx", (F.col("pos") + F.col("len")).alias("start"))
    here = F.struct(F.col("from_chunk").alias("u"), F.col("from_forward").alias("u_forward"), F.col("to_chunk").alias("v"), F.col("to_forward").alias("v_forward"))
    there = F.struct(F.col("to_chunk").alias("u"), (~F.col("to_forward")).alias("u_forward"), F.col("from_chunk").alias("v"), (~F.col("from_forward")).alias("v_forward"))
    e = adj.select("read_id", "idx", F.least(here, there).alias("e"), (here > there).alias("flipped"), "offset").select("read_id", "idx", "e.*", "flipped", "offset").join(ends, ["read_id", "idx"])
    if edges is not None:
        e = e.join(F.broadcast(edges) if edges.count() <= 1_000_000 else edges, ["u", "u_forward", "v", "v_forward"], "left_semi")
    part = F.substring("__read", (F.col("start") + 1).cast("int"), F.col("offset").cast("int"))
    e = e.join(reads.select("read_id", F.col("seq").alias("__read")), "read_id")
    return e.withColumn("seq", F.upper(F.when(F.col("flipped"), reverse_complement(part)).otherwise(part))).select("u", "u_forward", "v", "v_forward", "read_id", "idx", "flipped", "start", "seq")


def tip_sequences(nodes: DataFrame, reads: DataFrame, least_gap: int, take: int) -> DataFrame:
    """(u, u_tail, read_id, start, flipped, seq): up to ``take`` bases that reads have past their first and last node, away from it."""
    own = Window.partitionBy("read_id")
    e = nodes.select("read_id", "idx", "chunk", "is_forward", "pos", (F.col("pos") + F.col("len")).alias("end"), F.min("idx").over(own).alias("first"), F.max("idx").over(own).alias("last"))
    n = reads.select("read_id", F.upper("seq").alias("__read"), F.length("seq").cast("long").alias("total"))
    j = e.where("idx = first OR idx = last").join(n, "read_id")
    tail = j.where("idx = last").where(F.col("total") - F.col("end") >= least_gap).select("read_id", F.col("chunk").alias("u"), F.col("is_forward").alias("u_tail"), F.col("end").alias("start"), F.lit(False).alias("flipped"), F.expr(f"substring(__read, int(end) + 1, int(least(total - end, {take})))").alias("seq"))
    head = j.where("idx = first").where(F.col("pos") >= least_gap).select("read_id", F.col("chunk").alias("u"), (~F.col("is_forward")).alias("u_tail"), F.greatest(F.col("pos") - take, F.lit(0)).alias("start"), F.lit(True).alias("flipped"), reverse_complement(F.expr(f"substring(__read, int(greatest(pos - {take}, 0)) + 1, int(least(pos, {take})))")).alias("seq"))
    return tail.unionByName(head)


def new_chunks(parts: DataFrame, keys: list[str], first: int, least: int, length: int | None = None) -> DataFrame:
    """(chunk, seq, keys, piece): the consensus of each group of ``least`` sequences or more, cut into pieces of ``length`` at most; ids go on from ``first``."""
    voted = grouped_consensus(parts.select(*keys, "seq"), keys, least).where(F.col("n") >= least)
    if length:
        pieces = F.expr(f"transform(sequence(0, int(ceil(length(seq) / {length})) - 1), i -> substring(seq, i * {length} + 1, {length}))")
    else:
        pieces = F.array("seq")
    rows = voted.where("length(seq) > 0").select(*keys, F.posexplode(pieces).alias("piece", "seq"))
    # one row for each new chunk is numbered, never nodes or reads
    return saved(rows.withColumn("chunk", (F.row_number().over(Window.orderBy(*keys, "piece")) + F.lit(first - 1)).cast("long")), "chunks")


def encoded_parts(parts: DataFrame, chunks: DataFrame, keys: list[str], sim_thr: float) -> DataFrame:
    """Nodes of new chunks in the sequences (start, flipped) that they were voted from.

    A sequence is aligned to each chunk of its group end to end free; what reaches the identity is a node.
    """
    import pyarrow as pa

    j = parts.join(chunks.select("chunk", F.col("seq").alias("own"), *keys), keys)

    def run(batches):
        for b in batches:
            out = []
            cols = {n: b.column(b.schema.get_field_index(n)).to_pylist() for n in ("read_id", "start", "flipped", "seq", "chunk", "own")}
            for read, start, flipped, seq, chunk, own in zip(*cols.values(), strict=True):
                got = fine_mapping(seq.upper(), own.upper(), sim_thr, edge=min(100, max(1, ceil(len(own) / 4))))
                if got:
                    s, e, ops = got
                    at = start + (len(seq) - e if flipped else s)
                    out.append((read, at, e - s, chunk, not flipped, ops, min(e - s, len(own)) - 2 * abs(e - s - len(own)) - len(ops)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64()]
            data = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(data, kinds, strict=True)], ["read_id", "pos", "len", "chunk", "is_forward", "cigar", "score"])

    found = j.mapInArrow(run, "read_id long, pos long, len long, chunk long, is_forward boolean, cigar string, score long")
    return found.select("read_id", F.lit(0).cast("int").alias("idx"), F.xxhash64("read_id", "chunk", "pos", "is_forward").alias("node_id"), "pos", "len", "chunk", F.lit(0).cast("long").alias("cluster"), "is_forward", "cigar", "score")


def _with(nodes: DataFrame, chunks: DataFrame, more: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    score = dict(nodes.dtypes)["score"]
    both = nodes.select(*_NODE).unionByName(found.select(*[F.col(n).cast(score).alias(n) if n == "score" else F.col(n) for n in _NODE]))
    both = both.withColumn("idx", F.row_number().over(Window.partitionBy("read_id").orderBy("pos", "node_id")).cast("int"))
    both = rewrite.reindexed(rewrite.without_contained(rewrite.without_slippy(both)))
    fresh = {"cluster_num": F.lit(1), "copy_num": F.lit(2), "score": F.lit(0.0)}
    extra = more.select(*[(F.col(c) if c in ("chunk", "seq") else fresh[c].cast(t)).alias(c) for c, t in chunks.select(*[c for c in chunks.columns if c in {"chunk", "seq", *fresh}]).dtypes])
    return saved(both.select(*_NODE), "nodes"), chunks.select(*extra.columns).unionByName(extra)


def filled_gaps(nodes: DataFrame, chunks: DataFrame, reads: DataFrame, sim_thr: float, least_gap: int, least: int = 3, length: int | None = None, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, chunks) with new chunks where ``least`` reads agree on what lies between two neighbours.

    The consensus of an edge's sequences becomes a chunk, or several of ``length`` at most, and is
    encoded in the reads that have the edge.
    """
    keys = ["u", "u_forward", "v", "v_forward"]
    parts = saved(gap_sequences(nodes, reads, least_gap, edges), "gaps")
    more = new_chunks(parts, keys, (chunks.agg(F.max("chunk")).first()[0] or 0) + 1, least, length)
    return _with(nodes, chunks, more, encoded_parts(parts, more, keys, sim_thr))


def filled_tips(nodes: DataFrame, chunks: DataFrame, reads: DataFrame, sim_thr: float, length: int, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(nodes, chunks) with new chunks of ``length`` where ``least`` reads go on past the same side of a chunk."""
    parts = saved(tip_sequences(nodes, reads, length, length), "tips")
    more = new_chunks(parts, ["u", "u_tail"], (chunks.agg(F.max("chunk")).first()[0] or 0) + 1, least)
    return _with(nodes, chunks, more, encoded_parts(parts, more, ["u", "u_tail"], sim_thr))
