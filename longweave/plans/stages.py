"""Reports and stage verbs on the tables of a data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_stats(reads: DataFrame) -> DataFrame:
    """One row: n, bases, mean (whole), least, most, masked (bases in lower case)."""
    n = F.length("seq").cast("long")
    return reads.agg(F.count("*").alias("n"), F.sum(n).alias("bases"), F.expr("CAST(sum(length(seq)) AS BIGINT) div count(*)").alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"), F.sum(F.length(F.regexp_replace("seq", "[^a-z]", ""))).alias("masked"))


def extracted(reads: DataFrame, units: DataFrame) -> DataFrame:
    """(kind, id, length, copies): READ and UNIT rows of a data set."""
    r = reads.select(F.lit("READ").alias("kind"), F.col("read_id").alias("id"), F.length("seq").cast("long").alias("length"), F.lit(None).cast("long").alias("copies"))
    return r.unionByName(units.select(F.lit("UNIT").alias("kind"), F.col("chunk").alias("id"), "length", "copies"))


def select_chunks(reads: DataFrame, chunk_len: int, take: int, margin: int = 0, k: int = 12, exclude: float = 0.8, seed: int = 42) -> DataFrame:
    """(chunk, seq): windows of reads, drawn by how little they repeat; those over ``exclude`` repetitive stay out."""
    from longweave.operators import masking, ordered, sampling
    from longweave.session import saved

    windows = ordered.fixed_windows(reads.select("read_id", "seq"), F.length("seq"), chunk_len, margin)
    own = saved(windows.select(F.xxhash64("read_id", "start").alias("read_id"), F.upper(F.substring("seq", F.col("start").cast("int") + 1, F.lit(chunk_len))).alias("seq")), "windows")
    rep = masking.repetitiveness(own, masking.mask(reads, k), k).where(F.col("repetitiveness") <= exclude)
    drawn = sampling.weighted_sample(rep.withColumn("weight", 1 - F.col("repetitiveness")), "read_id", "weight", take, seed)
    named = own.join(drawn.select("read_id"), "read_id", "left_semi").groupBy("read_id").agg(F.first("seq").alias("seq"))
    from pyspark.sql import Window

    return named.select((F.row_number().over(Window.orderBy("read_id")) - 1).cast("long").alias("chunk"), "seq")  # ``take`` rows


def without_overlapping(chunks: DataFrame, sim_thr: float, k: int = 15) -> DataFrame:
    """Chunks of which none maps onto another: a greedy cover of the pairs goes."""
    from longweave.operators.align import seed_candidates
    from longweave.operators.graph import vertex_cover

    own = chunks.select(F.col("chunk").alias("id"), "seq")
    half = F.length("seq") / 2
    pairs = seed_candidates(own, own, k, least=5).where("query < target").join(own.select(F.col("id").alias("query"), half.alias("half")), "query")
    close = pairs.where((F.abs("shift") < F.col("half")) & (F.col("seeds") > F.col("half") * (1 - sim_thr) * 0.2))
    gone = vertex_cover([(r["query"], r["target"]) for r in close.collect()])
    return chunks.where(~F.col("chunk").isin(gone)) if gone else chunks


def encode(reads: DataFrame, chunks: DataFrame, sim_thr: float, k: int = 15) -> DataFrame:
    """Nodes: chunks found in reads, one of overlapping ones of a chunk, dense idx in each read."""
    from longweave.operators import align, rewrite

    n = align.mapped(reads.select("read_id", F.upper("seq").alias("seq")), chunks, sim_thr, k)
    n = n.withColumn("len", F.col("end") - F.col("pos")).withColumn("score", -F.length("cigar"))
    n = n.withColumn("node_id", F.xxhash64("read_id", "chunk", "pos", "is_forward")).withColumn("idx", F.col("pos").cast("int")).withColumn("cluster", F.lit(0).cast("long"))
    return rewrite.reindexed(rewrite.without_slippy(n))


def node_sequences(nodes: DataFrame, reads: DataFrame) -> DataFrame:
    """Nodes with what they span of their read, in the chunk's direction."""
    from longweave.functions.sequence import reverse_complement

    part = F.substring("__read", F.col("pos").cast("int") + 1, F.col("len").cast("int"))
    j = nodes.join(reads.select("read_id", F.col("seq").alias("__read")), "read_id")
    return j.withColumn("seq", F.upper(F.when(F.col("is_forward"), part).otherwise(reverse_complement(part)))).drop("__read")


def cluster_locally(nodes: DataFrame, chunks: DataFrame, coverage: float, most: int = 2, selection: DataFrame | None = None) -> DataFrame:
    """Nodes (with seq) with the cluster that their chunk's pileup falls into; seeded by chunk.

    Up to ``most`` clusters a chunk, or up to its copy_num if ``chunks`` has it, in steps where that is
    high. With ``selection`` (chunk) the other chunks keep their labels. A chunk's reads meet in one task:
    they are as many as its coverage.
    """
    import pyarrow as pa

    from longweave.operators import likelihood
    from longweave.operators.align import edit_align

    copies = F.col("copy_num").cast("int") if "copy_num" in chunks.columns else F.lit(most)
    own = chunks.select("chunk", F.col("seq").alias("template"), copies.alias("copies"))
    if selection is not None:
        own = own.join(selection.select("chunk"), "chunk", "left_semi")
    piles = nodes.select("chunk", "node_id", "seq").join(own, "chunk")

    def run(key, t):
        rows = sorted(t.to_pylist(), key=lambda r: (edit_align(r["seq"], r["template"])[1], r["node_id"]))
        labels, _ = likelihood.phased_in_steps([r["seq"] for r in rows], rows[0]["template"], coverage, max(1, rows[0]["copies"]), seed=key[0].as_py())
        return pa.table({"node_id": pa.array([r["node_id"] for r in rows], pa.int64()), "new": pa.array(labels.tolist(), pa.int64())})

    new = piles.groupBy("chunk").applyInArrow(run, "node_id long, new long")
    return nodes.join(new, "node_id", "left").withColumn("cluster", F.coalesce("new", "cluster")).drop("new")


def with_cluster_numbers(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """``chunks`` whose cluster_num is one more than the greatest label in use, and copy_num no less."""
    k = nodes.groupBy("chunk").agg((F.max("cluster") + 1).cast("int").alias("__k"))
    c = chunks.join(k, "chunk", "left").withColumn("cluster_num", F.coalesce("__k", F.lit(1)).cast("int"))
    return c.withColumn("copy_num", F.greatest("copy_num", "cluster_num").cast("int")).select(*chunks.columns)


#: Paths and links of a contracted graph, and nodes and edges of one that is assembled, that the driver takes.
MOST_ELEMENTS = 2_000_000


def bounded_rows(df: DataFrame, what: str, most: int = MOST_ELEMENTS) -> list:
    """The rows of ``df``; more than ``most`` are an error, not a cut."""
    n = df.count()
    if n > most:
        raise ValueError(f"{n} {what} are more than the {most} that one graph may have on the driver")
    return df.collect()


def copy_numbers(nodes: DataFrame, coverage: float, least_edge: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(copies: node, copies; paths: path, n, occ, copies; links: a, a_head, b, b_head, occ, copies) by flow on the contracted graph.

    The graph is built, thinned and contracted in Spark; what comes to the driver is a row for each
    simple path.
    """
    from longweave.operators import copies, graph
    from longweave.session import saved

    spark = nodes.sparkSession
    g_nodes, g_edges = graph.build(nodes)
    g_nodes, g_edges = saved(g_nodes, "g_nodes"), saved(graph.without_light_edges(g_edges, least_edge), "g_edges")
    members, paths, links = graph.contracted_ports(g_nodes, g_edges)
    own = sorted(bounded_rows(paths, "paths"), key=lambda r: r["path"])
    met = sorted(bounded_rows(links, "links"), key=lambda r: (r["a"], r["a_head"], r["b"], r["b_head"]))
    at = {r["path"]: i for i, r in enumerate(own)}
    c, f = copies.estimated([(float(r["occ"]), int(r["n"])) for r in own], [(at[r["a"]], r["a_head"], at[r["b"]], r["b_head"], float(r["occ"])) for r in met], coverage) if own else ([], [])
    of_path = spark.createDataFrame([(r["path"], r["n"], r["occ"], int(x)) for r, x in zip(own, c, strict=True)], "path long, n long, occ long, copies long")
    of_link = spark.createDataFrame([(r["a"], r["a_head"], r["b"], r["b_head"], r["occ"], int(x)) for r, x in zip(met, f, strict=True)], "a long, a_head boolean, b long, b_head boolean, occ long, copies long")
    return members.join(of_path, "path").select("node", "copies"), of_path, of_link


def estimate_multiplicity(nodes: DataFrame, chunks: DataFrame, coverage: float | None = None) -> tuple[DataFrame, float]:
    """(chunks with copy_num, coverage): copies of each chunk, 1 at least, whatever its clusters; coverage is half the median if not given."""
    from longweave.operators import graph, rewrite

    coverage = coverage or float(rewrite.haploid_coverage(nodes).first()[0] or 1.0)
    plain = nodes.withColumn("cluster", F.lit(0).cast("long"))
    found, _, _ = copy_numbers(plain, coverage)
    per = found.select(F.floor(F.col("node") / graph.WIDE).cast("long").alias("chunk"), "copies")
    out = chunks.join(per, "chunk", "left").withColumn("copy_num", F.greatest(F.coalesce("copies", F.lit(1)), F.lit(1)).cast("int"))
    return out.select(*dict.fromkeys([*chunks.columns, "copy_num"])), coverage


def draft_lines(paths: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, at, value): a GFA draft of the contracted graph, with occurrences, copies and numbers of chunks as tags and no sequences."""
    name = lambda c: F.concat(F.lit("path_"), F.col(c).cast("string"))
    side = lambda c, out: F.when(F.col(c), "-" if out else "+").otherwise("+" if out else "-")
    head = paths.sparkSession.range(1).select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), F.lit("H\tVN:Z:1.0").alias("value"))
    seg = paths.select(F.lit(1).alias("kind"), F.col("path").alias("at"), F.concat_ws("\t", F.lit("S"), name("path"), F.lit("*"), F.concat(F.lit("cv:i:"), "occ"), F.concat(F.lit("cp:i:"), "copies"), F.concat(F.lit("nc:i:"), "n")).alias("value"))
    link = links.select(F.lit(2).alias("kind"), F.xxhash64("a", "a_head", "b", "b_head").alias("at"), F.concat_ws("\t", F.lit("L"), name("a"), side("a_head", True), name("b"), side("b_head", False), F.lit("0M"), F.concat(F.lit("cv:i:"), "occ"), F.concat(F.lit("cp:i:"), "copies")).alias("value"))
    return head.unionByName(seg).unionByName(link)


def correct_deletion(nodes: DataFrame, chunks: DataFrame, reads: DataFrame, sim_thr: float, coverage: float, recluster: bool = False, gap: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(nodes, chunks): missing chunks put in, nodes with large indels taken out, and what changed clustered anew if asked.

    Chunks whose copies changed or that were put in are clustered again; others keep their labels.
    """
    from longweave.operators import filling, rewrite
    from longweave.session import saved

    now, changed = filling.corrected_deletions(nodes, chunks, reads, sim_thr)
    for compress in (False, True):
        gone = rewrite.purge_large_indels(with_indels(now), chunks, coverage, gap, 0.5, compress)
        gone = saved(gone.select("node_id", "chunk"), "gone")
        changed = changed.unionByName(gone.select("chunk"))
        now = saved(rewrite.reindexed(now.join(gone.select("node_id"), "node_id", "left_anti")), "nodes")
    if not recluster:
        return now, chunks
    again, _ = estimate_multiplicity(now, chunks, coverage)
    again = saved(again, "chunks")
    moved = again.select("chunk", "copy_num").join(chunks.select("chunk", F.col("copy_num").alias("was")), "chunk").where("copy_num <> was").select("chunk")
    selection = saved(changed.unionByName(moved).distinct(), "selection")
    fresh = cluster_locally(node_sequences(now, reads), again, coverage, selection=selection)
    fresh = saved(fresh.select(*now.columns), "nodes")
    kept = rewrite.purge_multiplicity(fresh, again, 10_000_000)
    return kept, with_cluster_numbers(kept, again)


def with_indels(nodes: DataFrame) -> DataFrame:
    """Nodes with ``indel``, the strongest stretch of insertions and deletions of their CIGAR."""
    from longweave.functions.sequence import cigar_ops, max_indel

    return nodes.withColumn("indel", max_indel(cigar_ops(F.col("cigar"))))


def recluster_diverged(nodes: DataFrame, chunks: DataFrame, reads: DataFrame, errors: DataFrame, coverage: float, threshold: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(nodes, chunks) without diverged clusters, their chunks clustered anew. errors: (read_id, chunk, cluster, error)."""
    from longweave.operators import cluster, rewrite
    from longweave.session import saved

    effects, _, _ = cluster.additive_effects(errors)
    bad = saved(effects.where(F.col("effect") > threshold).select("chunk").distinct(), "bad")
    kept = saved(rewrite.reindexed(rewrite.purge_diverged(nodes, effects.select("chunk", "cluster", "effect"), threshold)), "nodes")
    fresh = cluster_locally(node_sequences(kept.drop("seq"), reads), chunks, coverage, selection=bad)
    fresh = saved(fresh.select(*kept.columns), "nodes")
    return fresh, with_cluster_numbers(fresh, chunks)


def node_errors(nodes: DataFrame) -> DataFrame:
    """(read_id, chunk, cluster, error): the share of a node's alignment columns that are indels."""
    from longweave.functions.sequence import cigar_ops

    ops = cigar_ops(F.col("cigar"))
    total = F.aggregate(ops, F.lit(0), lambda a, x: a + x["len"])
    gaps = F.aggregate(ops, F.lit(0), lambda a, x: a + F.when(x["op"] == "M", 0).otherwise(x["len"]))
    return nodes.select("read_id", "chunk", "cluster", (gaps / F.greatest(total, F.lit(1))).alias("error"))


def squish(nodes: DataFrame, chunks: DataFrame, least: int = 7, least_ari: float = 0.4, match: float = 4.0, mismatch: float = -1.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, chunks) in which chunks whose clusters disagree with those around them have one cluster."""
    from longweave.operators import relations, rewrite

    bad = relations.relation_classes(nodes, chunks, least, least_ari, match, mismatch).where("class = 'suspicious'").select("chunk")
    return rewrite.squished(nodes, chunks, bad)


def correct_clustering(nodes: DataFrame, chunks: DataFrame, coverage: float, gain: float = 1.0, least_ari: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """(nodes, chunks) with clusters that agree with what stands around them; chunks of a high score are protected."""
    from longweave.operators import relations
    from longweave.session import saved

    own = nodes if "posterior" in nodes.columns else relations.hard_posteriors(nodes, chunks)
    safe = relations.protected_clusterings(nodes, chunks, gain) if "score" in chunks.columns else None
    out = saved(relations.corrected_clustering(own, chunks, coverage, safe, least_ari), "nodes")
    return out, with_cluster_numbers(out, chunks)


def pick_components(nodes: DataFrame, chunks: DataFrame, n: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, chunks) of the reads whose every node is in one of the ``n`` largest components."""
    from longweave.operators import graph, rewrite

    kept = rewrite.reindexed(graph.reads_in_components(nodes, n))
    return kept, chunks.join(kept.select("chunk").distinct(), "chunk", "left_semi")


def pairs_in_reads(nodes: DataFrame, keys: DataFrame, most: int) -> DataFrame:
    """(a, dist, b, n): nodes b that stand ``dist`` nodes from a node a of ``keys`` (node) in reads, up to ``most`` on either side."""
    from pyspark.sql import Window

    from longweave.operators.graph import node_key

    own = Window.partitionBy("read_id").orderBy("idx")
    rows = nodes.select("read_id", "idx", node_key(F.col("chunk"), F.col("cluster")).alias("a"))
    near = rows.select("a", F.collect_list("a").over(own.rowsBetween(1, most)).alias("after"), F.reverse(F.collect_list("a").over(own.rowsBetween(-most, -1))).alias("before"))
    near = near.join(F.broadcast(keys.select(F.col("node").alias("a"))), "a", "left_semi")
    both = near.select("a", F.posexplode("after").alias("p", "b")).unionByName(near.select("a", F.posexplode("before").alias("p", "b")))
    return both.groupBy("a", (F.col("p") + 1).alias("dist"), "b").agg(F.count("*").alias("n"))


def graph_of(nodes: DataFrame, chunks: DataFrame, coverage: float | None = None, least_edge: int = 1, reach: int = 8, least_span: int = 2, llrs: tuple[float, ...] = (10.0, 5.0, 1.0)):
    """The cleaned graph of encoded reads: copy numbers by flow, repeats resolved by spanning reads, forks zipped."""
    from longweave.operators import graph, rewrite
    from longweave.operators.assembly import ChunkGraph
    from longweave.session import saved

    coverage = coverage or max(1.0, float(rewrite.haploid_coverage(nodes).first()[0] or 1.0))
    g_nodes, _ = graph.build(nodes)
    g_nodes = saved(g_nodes, "g_nodes")
    reps = saved(graph.representative(nodes).where(F.col("occ") > least_edge), "g_edges")
    found, _, _ = copy_numbers(nodes, coverage, least_edge)
    own = bounded_rows(g_nodes.join(found, "node", "left").select("node", "occ", F.coalesce("copies", F.lit(1)).alias("copies")), "nodes")
    seqs = {r["chunk"]: r["seq"] for r in bounded_rows(chunks.select("chunk", "seq"), "chunks")}
    links = bounded_rows(reps, "edges")
    g = ChunkGraph([(r["node"], r["occ"], int(r["copies"]), seqs[r["node"] // graph.WIDE]) for r in own], [(r["a"], r["a_head"], r["b"], r["b_head"], r["occ"], r["offset"]) for r in links])
    g.check()
    repeats = {n for n, c in g.copies.items() if c > 1}
    foci = {n for n, c in g.copies.items() if c == 1 and any(q[0] in repeats for h in (True, False) for q in g.edges[n, h])}
    spanning, layers = {}, {}
    if foci:
        keys = nodes.sparkSession.createDataFrame([(n,) for n in sorted(foci)], "node long")
        for r in bounded_rows(pairs_in_reads(nodes, keys, reach), "pairs"):
            layers.setdefault(r["a"], {}).setdefault(r["dist"], {})[r["b"]] = r["n"]
            if r["dist"] == 2:
                spanning[r["a"], r["b"]] = spanning.get((r["a"], r["b"]), 0) + r["n"]
    # a pair of foci is met from either of them
    spanning = {k: v / 2 if k[::-1] in spanning else v for k, v in spanning.items()}
    g.clean(spanning, layers, llrs, least_span)
    return g


def assemble(nodes: DataFrame, chunks: DataFrame, least_edge: int = 1, coverage: float | None = None):
    """(contigs, links, tiles) of the cleaned graph of encoded nodes, spelled from the chunks' sequences."""
    return graph_of(nodes, chunks, coverage, least_edge).spell()


def encode_densely(nodes: DataFrame, chunks: DataFrame, reads: DataFrame, sim_thr: float, coverage: float, length: int, least_gap: int = 100, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(nodes, chunks) with new chunks on the edges between nodes of several copies, cut to ``length`` and encoded.

    Copies come from the flow on the contracted graph of clustered nodes.
    """
    from longweave.operators import filling, graph
    from longweave.session import saved

    found, _, _ = copy_numbers(nodes, coverage)
    many = saved(found.where("copies > 1").select(F.floor(F.col("node") / graph.WIDE).cast("long").alias("chunk")).distinct(), "many")
    edges = filling.gap_sequences(nodes, reads, least_gap).select("u", "u_forward", "v", "v_forward").distinct()
    edges = edges.join(many.withColumnRenamed("chunk", "u"), "u", "left_semi").join(many.withColumnRenamed("chunk", "v"), "v", "left_semi")
    edges = saved(edges.select("u", "u_forward", "v", "v_forward"), "edges")
    return filling.filled_gaps(nodes, chunks, reads, sim_thr, least_gap, least, length, edges)


def polish_encoding(nodes: DataFrame, chunks: DataFrame, reads: DataFrame, coverage: float) -> DataFrame:
    """``nodes`` but for those of frequent chunks and with erroneous neighbours."""
    from longweave.operators import rewrite

    kept = rewrite.without_chunks(nodes, rewrite.frequent_chunks(nodes, coverage, 8))
    return rewrite.without_erroneous_nodes(rewrite.reindexed(kept), reads.select("read_id", F.length("seq").cast("long").alias("len")))


def window_parts(alignments: DataFrame, window: int) -> DataFrame:
    """(contig, window, seq): what each alignment (contig, total, pos from 0, cigar, seq) has in the windows that it spans.

    ``total`` is the contig's length. Soft clips are in ``seq`` and skipped, hard clips aren't. An
    alignment that ends inside a window doesn't vote on it. Insertions go with the base before.
    """
    import re

    import pyarrow as pa

    ops = re.compile(r"(\d+)([MIDNSHP=X])")

    def run(batches):
        for b in batches:
            out = []
            for contig, total, pos, cigar, seq in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                at, q, parts = pos, 0, {}
                for n, op in ops.findall(cigar or ""):
                    n = int(n)
                    if op in "M=X":
                        while n:
                            w = at // window
                            take = min(n, (w + 1) * window - at)
                            own = parts.setdefault(w, [[], 0])
                            own[0].append(seq[q : q + take])
                            own[1] += take
                            at, q, n = at + take, q + take, n - take
                    elif op in "DN":
                        while n:
                            w = at // window
                            take = min(n, (w + 1) * window - at)
                            parts.setdefault(w, [[], 0])[1] += take
                            at, n = at + take, n - take
                    elif op in "IS":
                        if op == "I" and parts:
                            parts.setdefault(max(0, at - 1) // window, [[], 0])[0].append(seq[q : q + n])
                        q += n
                out += [(contig, w, "".join(x)) for w, (x, n) in parts.items() if n == min(window, total - w * window)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], ["contig", "window", "seq"])

    return alignments.select("contig", F.col("total").cast("long"), F.col("pos").cast("long"), "cigar", "seq").where("pos IS NOT NULL AND seq IS NOT NULL").mapInArrow(run, "contig string, window long, seq string")


def polish(contigs: DataFrame, alignments: DataFrame, window: int = 2000, least: int = 2, most: int = 50, rounds: int = 2) -> DataFrame:
    """(name, seq): contigs whose windows are the consensus of what is aligned there; windows with fewer than ``least`` parts stay.

    contigs: (name, seq); alignments: (contig, pos, cigar, seq), e.g. :func:`sam_alignments`.
    """
    from longweave.operators.align import grouped_consensus

    own = contigs.select(F.col("name").alias("contig"), F.expr(f"posexplode(transform(sequence(0, int(greatest(ceil(length(seq) / {window}), 1)) - 1), i -> substring(seq, i * {window} + 1, {window})))").alias("window", "old"))
    sized = alignments.join(contigs.select(F.col("name").alias("contig"), F.length("seq").cast("long").alias("total")), "contig")
    voted = grouped_consensus(window_parts(sized, window), ["contig", "window"], least, most, rounds).select("contig", "window", F.col("seq").alias("new"))
    both = own.withColumn("window", F.col("window").cast("long")).join(voted, ["contig", "window"], "left")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("window", F.coalesce("new", "old").alias("s")))), lambda x: x["s"]), "")
    return both.groupBy(F.col("contig").alias("name")).agg(text.alias("seq"))


def sam_alignments(sam: DataFrame) -> DataFrame:
    """(contig, pos, cigar, seq) of mapped SAM records."""
    return sam.where("rname <> '*' AND seq <> '*' AND cigar <> '*' AND int(flag / 4) % 2 = 0").select(F.col("rname").alias("contig"), (F.col("pos") - 1).cast("long").alias("pos"), "cigar", "seq")


def paf_alignments(paf: DataFrame, reads: DataFrame) -> DataFrame:
    """(contig, pos, cigar, seq) of PAF records with a CIGAR, with what is aligned of reads (name, seq), turned to the contig's strand."""
    from longweave.functions.sequence import reverse_complement

    j = paf.where("cigar IS NOT NULL AND cigar <> ''").join(reads.select(F.col("name").alias("qname"), "seq"), "qname")
    part = F.substring("seq", (F.col("qstart") + 1).cast("int"), (F.col("qend") - F.col("qstart")).cast("int"))
    return j.select(F.col("tname").alias("contig"), F.col("tstart").alias("pos"), "cigar", F.when(F.col("strand") == "-", reverse_complement(part)).otherwise(part).alias("seq"))


def fill_sparse(nodes: DataFrame, chunks: DataFrame, reads: DataFrame, sim_thr: float, length: int, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(nodes, chunks) with new chunks in gaps longer than a chunk and past the ends of walks."""
    from longweave.operators import filling

    n, c = filling.filled_gaps(nodes, chunks, reads, sim_thr, length, least)
    return filling.filled_tips(n, c, reads, sim_thr, length, least)


def polished(parts: DataFrame, least: int = 2, most: int = 50) -> DataFrame:
    """(contig, window, seq, n): consensus of each window of contigs; parts: (contig, window, seq)."""
    from longweave.operators.align import grouped_consensus

    return grouped_consensus(parts.select("contig", "window", "seq"), ["contig", "window"], least, most)
