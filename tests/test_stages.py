"""Stages on simulated regions whose truth is known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from longweave.operators import align, cluster, copies, filling, graph, likelihood, masking, relations
from longweave.operators.assembly import ChunkGraph, reverse_complement
from longweave.plans import stages, verbs
from longweave.sources import sequences as Q
from longweave.sources import simulate

NODES = "read_id long, idx int, node_id long, pos long, len long, chunk long, cluster long, is_forward boolean, cigar string, score long"
CHUNKS = "chunk long, seq string, cluster_num int, copy_num int, score double"


def region(spark, order, size=300, gap=40, n_reads=24, span=5, seed=1, haps=1):
    """(reads, chunks, nodes): reads of either strand over a walk of chunks ``order``, encoded without mistakes."""
    rng = np.random.default_rng(seed)
    seqs = {c: simulate.sequence(size, rng) for c in sorted(set(order))}
    spacers = [simulate.sequence(gap, rng) for _ in order]
    starts, text = [], ""
    for c, s in zip(order, spacers, strict=True):
        starts.append(len(text))
        text += seqs[c] + s
    reads, nodes = [], []
    for r in range(n_reads):
        first = int(rng.integers(0, max(1, len(order) - span + 1)))
        last = min(len(order), first + span)
        a, b = starts[first], starts[last - 1] + size
        ahead = bool(rng.integers(2))
        seq = text[a:b] if ahead else reverse_complement(text[a:b])
        reads.append((r, f"r{r}", "", seq))
        own = [(starts[i] - a if ahead else b - starts[i] - size, order[i]) for i in range(first, last)]
        for i, (pos, c) in enumerate(sorted(own)):
            nodes.append((r, i, r * 1000 + i, pos, size, c, r % haps, ahead, f"{size}M", size))
    chunks = [(c, s, haps, 2, 0.0) for c, s in seqs.items()]
    return spark.createDataFrame(reads, "read_id long, name string, desc string, seq string"), spark.createDataFrame(chunks, CHUNKS), nodes


def ari(a, b):
    a, b = np.asarray(a), np.asarray(b)
    table = np.array([[((a == x) & (b == y)).sum() for y in np.unique(b)] for x in np.unique(a)], float)
    pairs = lambda x: (x * (x - 1) / 2).sum()
    both, x, y, n = pairs(table), pairs(table.sum(axis=1)), pairs(table.sum(axis=0)), pairs(np.array([len(a)], float))
    return (both - x * y / n) / ((x + y) / 2 - x * y / n)


def test_planted_deletions_are_filled(spark):
    reads, chunks, rows = region(spark, list(range(8)), n_reads=30)
    rng = np.random.default_rng(3)
    kept, gone = [], set()
    for r in rows:
        if rng.random() < 0.15 and sum(x[0] == r[0] for x in kept) >= 1:
            gone.add((r[0], r[5], r[3]))
        else:
            kept.append(r)
    nodes, changed = filling.corrected_deletions(spark.createDataFrame(kept, NODES), chunks, reads, 0.15)
    got = {(r["read_id"], r["chunk"], r["pos"]) for r in nodes.collect()}
    assert len(gone) > 10 and len(gone & got) >= 0.95 * len(gone)
    assert got <= {(r[0], r[5], r[3]) for r in rows}
    assert {r["chunk"] for r in changed.collect()} == {c for _, c, _ in gone & got}
    none = spark.createDataFrame([], NODES)
    assert filling.corrected_deletions(none, chunks, reads, 0.15)[0].count() == 0


def test_gaps_and_tips_become_chunks(spark):
    reads, chunks, rows = region(spark, list(range(6)), n_reads=24, span=6)
    truth = {r["chunk"]: r["seq"] for r in chunks.collect()}
    kept = [r for r in rows if r[5] not in (2, 5)]
    left = chunks.where("chunk NOT IN (2, 5)")
    nodes, more = filling.filled_gaps(spark.createDataFrame(kept, NODES), left, reads, 0.15, 300)
    new = [r for r in more.collect() if r["chunk"] not in truth or r["chunk"] == 5]
    assert len(new) == 1 and any(truth[2] in s for s in (new[0]["seq"], reverse_complement(new[0]["seq"])))
    assert nodes.where(F.col("chunk") == new[0]["chunk"]).count() == 24
    nodes, more = filling.filled_tips(nodes, more, reads, 0.15, 200)
    assert more.count() == 6 and nodes.groupBy("read_id").count().where("count = 6").count() == 24


def test_copies_of_a_repeat(spark):
    reads, chunks, rows = region(spark, [0, 1, 9, 2, 3, 9, 4, 5], n_reads=60, span=4, seed=5)
    got, coverage = stages.estimate_multiplicity(spark.createDataFrame(rows, NODES), chunks, None)
    n = {c: sum(r[5] == c for r in rows) for c in (1, 9)}
    at = {r["chunk"]: r["copy_num"] for r in got.collect()}
    got2, _ = stages.estimate_multiplicity(spark.createDataFrame(rows, NODES), chunks, n[9] / 2)
    at2 = {r["chunk"]: r["copy_num"] for r in got2.collect()}
    assert at2[9] == 2 and all(at2[c] == 1 for c in (1, 2, 3, 4)) and coverage > 0 and at[9] >= at[0]


def test_contraction_keeps_ports(spark):
    # 1 - 2 - 3 in a row, then a fork to 4 and 5; 6 alone
    edges = [(1, False, 2, True), (2, False, 3, True), (3, False, 4, True), (3, False, 5, True)]
    both = [(a, x, b, y, 5) for a, x, b, y in edges] + [(b, y, a, x, 5) for a, x, b, y in edges]
    members, paths, links = graph.contracted_ports(spark.createDataFrame([(i, 10) for i in range(1, 7)], "node long, occ long"), spark.createDataFrame(both, "a long, a_head boolean, b long, b_head boolean, occ long"))
    assert {r["node"]: r["path"] for r in members.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    assert {(r["path"], r["n"]) for r in paths.collect()} == {(1, 3), (4, 1), (5, 1), (6, 1)}
    got = {(r["a"], r["b"]) for r in links.collect()}
    assert got == {(1, 4), (1, 5)} and len({r["a_head"] for r in links.collect()}) == 1


def test_estimators_agree_on_a_small_graph(spark):
    nodes = [20.0, 41.0, 19.0, 39.0]
    edges = [(0, False, 1, True, 20.0), (2, False, 1, True, 21.0), (1, False, 3, True, 40.0)]
    field = copies.Field(nodes, edges, 20.0)
    c, f = copies.gibbs(field, 300, 100)
    assert c.tolist() == [1, 2, 1, 2] and f.tolist() == [1, 1, 2]
    energy, c, f = copies.annealed(spark, field, chains=6, sweeps=60)
    assert c.tolist() == [1, 2, 1, 2] and f.tolist() == [1, 1, 2] and abs(energy - field.energy(c, f)) < 1e-9
    # places: an edge for each node between its ports, then the edges
    ports = [(0, 1), (2, 3), (4, 5), (6, 7), (1, 2), (5, 2), (3, 6)]
    assert copies.spanning_tree_copies([*nodes, 20.0, 21.0, 40.0], ports, [True] * 4 + [False] * 3, 20.0).tolist() == [1, 2, 1, 2, 1, 1, 2]
    meets = np.zeros((3, 7))
    meets[0, [0, 4]], meets[1, [1, 6]], meets[2, [2, 5]] = (-1, 1), (-1, 1), (-1, 1)
    assert np.abs(copies.regressed([*nodes, 20.0, 21.0, 40.0], meets, 20.0) - [1, 2, 1, 2, 1, 1, 2]).max() < 0.1


def test_classes_by_agreement(spark):
    pairs = [(1, 2, 20, 0.9), (2, 3, 20, 0.95), (1, 3, 20, 0.9), (3, 4, 20, 0.05), (2, 4, 20, 0.1), (7, 8, 20, 0.0)]
    got = relations.agreeing(pairs)
    assert {1, 2, 3} <= got and 4 not in got and not {7, 8} <= got


def test_clusters_corrected_by_context(spark):
    _, chunks, rows = region(spark, list(range(5)), n_reads=30, span=5, seed=8, haps=2)
    rng = np.random.default_rng(2)
    truth = {r[2]: r[6] for r in rows}
    wrong = {r[2] for r in rows if rng.random() < 0.07}
    noisy = [(*r[:6], 1 - r[6] if r[2] in wrong else r[6], *r[7:]) for r in rows]
    out, _ = stages.correct_clustering(spark.createDataFrame(noisy, NODES), chunks, 15.0, gain=1e9)
    by = {}
    for r in out.collect():
        by.setdefault(r["chunk"], []).append((truth[r["node_id"]], r["cluster"]))
        assert len(r["posterior"]) == 2 and max(r["posterior"]) == 0.0
    found = [ari(*zip(*x, strict=True)) for x in by.values()]
    before = [ari([truth[r[2]] for r in noisy if r[5] == c], [r[6] for r in noisy if r[5] == c]) for c in by]
    assert len(wrong) > 5 and np.mean(found) >= 0.9 > np.mean(before)


@pytest.mark.parametrize("copies_", [2, 8])
def test_phased_piles(copies_):
    haps = simulate.haplotypes(60, 2, 0.06, 4)
    reads, labels = simulate.pileup(haps, 8, 0.02, 3)
    got, score = likelihood.phased_in_steps(reads, haps[0], 8.0, copies_, seed=1)
    assert score > 0 and ari(labels, got) >= 0.9


def test_minimum_gain_is_one_at_least():
    assert likelihood.minimum_gain(likelihood.Rates(), seeds=6, reads=5, length=30) >= 1.0


def test_exact_clusters_are_no_worse():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 4))
    _, best = cluster.exact(x, 2)
    for _ in range(50):
        labels = rng.integers(0, 2, 12)
        assert sum(np.maximum(x[labels == c].sum(axis=0), 0).sum() for c in (0, 1)) <= best + 1e-9


def test_polished_contigs(spark):
    rng = np.random.default_rng(9)
    truth = simulate.sequence(700, rng)
    wrong = truth[:100] + "A" + truth[101:350] + truth[352:]
    sam = []
    for i in range(12):
        a = int(rng.integers(0, 200))
        part = truth[a : a + 500]
        ops, _, start, _ = align.edit_align(part, wrong, "infix")
        sam.append((f"q{i}", 0, "c1", start + 1, 60, "4S" + align.compress(ops), "ACGT" + part))
    got = stages.polish(spark.createDataFrame([("c1", wrong), ("c2", "ACGT")], "name string, seq string"), stages.sam_alignments(spark.createDataFrame(sam, "qname string, flag int, rname string, pos long, mapq int, cigar string, seq string")), window=120)
    seqs = {r["name"]: r["seq"] for r in got.collect()}
    assert seqs["c2"] == "ACGT"
    ops, distance, _, _ = align.edit_align(seqs["c1"], truth)
    assert distance <= 1


def test_items_twice_in_a_read_and_of_common_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    item, common = simulate.sequence(120, rng), simulate.sequence(120, rng)
    read = simulate.sequence(200, rng) + item + simulate.sequence(300, rng) + item + common
    chunks = [(1, item)] + [(i, common) for i in range(2, 6)]
    monkeypatch.setattr(align, "RARE", 2)
    monkeypatch.setattr(align, "PLACES", 2)
    got = align.mapped(spark.createDataFrame([(1, read)], "read_id long, seq string"), spark.createDataFrame(chunks, "chunk long, seq string"), 0.15).collect()
    assert sorted((r["chunk"], r["pos"]) for r in got) == [(1, 200), (1, 620), *[(i, 740) for i in range(2, 6)]]


def test_masks_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    reads = spark.createDataFrame([(i, simulate.sequence(300, rng) + "ACGTTGCA" * 6) for i in range(20)] + [(99, None), (98, "AC")], "read_id long, seq string")
    masked = masking.mask(reads, 7, 0.05, 2)
    whole = {r["read_id"]: r["seq"] for r in masking.soft_masked(reads, masked, 7).collect()}
    monkeypatch.setattr(masking, "BROADCAST_KMERS", max(1, masked.count() // 3))
    assert {r["read_id"]: r["seq"] for r in masking.soft_masked(reads, masked, 7).collect()} == whole
    assert any(c.islower() for c in whole[3])


def test_numbered_in_order(spark):
    df = spark.range(1000, numPartitions=7).select(F.concat(F.lit("r"), "id").alias("name"), F.lit("ACGT").alias("seq"))
    got = Q.numbered(df).collect()
    assert {r["read_id"]: r["name"] for r in got} == {i: f"r{i}" for i in range(1000)}


def test_zero_copy_ways_go():
    g = ChunkGraph([(0, 20, 1, "A" * 9), (1, 20, 1, "C" * 9), (2, 3, 0, "G" * 9), (3, 20, 1, "T" * 9)], [(0, False, 1, True, 20, 0), (1, False, 3, True, 20, 0), (0, False, 2, True, 3, 0), (2, False, 3, True, 3, 0)])
    assert g.remove_zero_paths() == 1 and set(g.occ) == {0, 1, 3}
    g.check()


def test_pipeline_and_resume(spark, tmp_path):
    rng = np.random.default_rng(11)
    genome = simulate.sequence(3000, rng)
    rows = simulate.reads([genome], 10, 1200, 0.0, 5)
    (tmp_path / "in.fa").write_text("".join(f">{r[1]}\n{r[2]}\n" for r in rows))
    (tmp_path / "c.toml").write_text(f'input_file = "{tmp_path}/in.fa"\nread_type = "CCS"\nregion_size = "3K"\nout_dir = "{tmp_path}"\nchunk_len = 300\nmargin = 50\nexclude = 1.0\nto_polish = false\nresume = true\n')
    config = verbs.Config.read(str(tmp_path / "c.toml"))
    gfa = verbs.run_pipeline(spark, config)
    contigs = Q.read_contigs(spark, gfa).collect()
    assert contigs and max(len(r["seq"]) for r in contigs) > 1500
    long = max((r["seq"] for r in contigs), key=len)
    _, distance, _, _ = align.edit_align(long, genome, "infix")
    _, other, _, _ = align.edit_align(reverse_complement(long), genome, "infix")
    assert min(distance, other) <= long.count("N") + 0.01 * len(long)  # gaps between chunks are N without polishing
    before = (tmp_path / "temp.corrected" / "done").stat().st_mtime_ns
    verbs.run_pipeline(spark, config)
    assert (tmp_path / "temp.corrected" / "done").stat().st_mtime_ns == before
    (tmp_path / "bad.toml").write_text('input_file = "x"\nread_type = "CCS"\nregion_size = "5K"\nother = 1\n')
    with pytest.raises(ValueError):
        verbs.Config.read(str(tmp_path / "bad.toml"))
    with pytest.raises(ValueError):
        verbs.apply(verbs.Store(spark, str(tmp_path / "temp.corrected")), "squish", nothing=1)
    assert verbs.apply(verbs.Store(spark, str(tmp_path / "temp.corrected")), "stats")["reads_n"] == len(rows)
