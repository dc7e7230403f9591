"""Alignment, likelihood, clustering, copy numbers and graph surgery on small known cases."""

import numpy as np
import pytest

from longweave.operators import align, cluster, copies, likelihood
from longweave.operators.assembly import ChunkGraph, reverse_complement
from longweave.operators.graph import vertex_cover
from longweave.sources import simulate


def plain_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_alignments():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a, b = simulate.sequence(int(rng.integers(0, 30)), rng), simulate.sequence(int(rng.integers(0, 30)), rng)
        ops, d, start, end = align.edit_align(a, b)
        assert d == plain_distance(a, b) == sum(o != "M" for o in ops) and (start, end) == (0, len(b))
        assert len(ops) - ops.count("D") == len(a) and len(ops) - ops.count("I") == len(b)
        top, mid, low = align.recovered(ops, a, b)
        assert top.replace("-", "") == a and low.replace("-", "") == b and len(mid) == len(ops)
        best = min(plain_distance(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        got = align.edit_align(a, b, "infix")
        assert got[1] == best == plain_distance(a, b[got[2] : got[3]])
    assert align.edit_align("ACGT", "ACGTTTT", "leading")[1:] == (0, 0, 4)
    assert align.edit_align("ACGT", "TTTACGT", "trailing")[1:] == (0, 3, 7)
    assert align.compress("MMXIID") == "3M2I1D" and align.trimmed("IIDMMXMID", 5, 12) == (2, "MMXM", 1, 6, 11)


def test_fine_mapping_and_consensus():
    rng = np.random.default_rng(2)
    chunk, flank = simulate.sequence(200, rng), simulate.sequence(80, rng)
    read = flank + likelihood.with_errors(chunk, likelihood.Rates(0.01, 0.01, 0.01), rng) + flank
    s, e, _ = align.fine_mapping(read, chunk, 0.15)
    assert abs(s - 80) <= 3 and abs(e - (len(read) - 80)) <= 3
    assert align.fine_mapping(simulate.sequence(300, rng), chunk, 0.15) is None
    reads = [likelihood.with_errors(chunk, likelihood.Rates(0.03, 0.03, 0.03), rng) for _ in range(25)]
    assert plain_distance(align.consensus(reads), chunk) <= 2
    assert align.consensus(["A"], least=2) is None


def test_whole_groups_vote(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = []
    for head, size in (("a", 70), ("b", 9), (None, 15), ("d", 1)):
        first = simulate.sequence(60, rng)
        reads = [likelihood.with_errors(first, likelihood.Rates(0.1, 0.1, 0.1), rng) for _ in range(size)]
        rows += [(head, s) for s in reads + reads[: size // 3]]
    rows += [("a", None), ("a", ""), ("e", "")]
    want = {}
    for head in {h for h, _ in rows}:
        own = [s for h, s in rows if h == head]
        if (seq := align.consensus(sorted(s for s in own if s), least=2)) is not None:
            want[head] = (len(own), seq)
    got = align.grouped_consensus(spark.createDataFrame(rows, "head string, seq string"), ["head"], least=2).collect()
    assert {r["head"]: (r["n"], r["seq"]) for r in got} == want and len(want) == 3

    from longweave.plans import catalog, views

    reads = [(i, "ACGTAC" + s) for i, s in enumerate([simulate.sequence(450, rng)] * 3 + ["GGG", "GGG", "GGT"] * 5)]
    monkeypatch.setattr(views, "reads", lambda spark, sf: spark.createDataFrame(reads, "read_id long, seq string"))
    got = catalog.queries()["ml19_grouped_consensus"](spark, "").collect()
    assert [(r["n"], r["seq"]) for r in got] == [(18, align.consensus(sorted(s for _, s in reads)))]


def test_chunk_alignments():
    a = [(1, 0, True), (2, 0, True), (3, 1, True), (4, 0, True)]
    assert align.chunk_overlap(a, a) == (4.0, "MMMM")
    assert align.chunk_overlap(a, a[1:])[0] == 3.0
    assert align.chunk_overlap(a, [(9, 0, True)] * 3) == (0.0, "")
    assert align.chunk_align([(1, 0), (2, 0)], [(1, 0), (3, 0), (2, 1)]) == (10 - 4 - 2, "MDM")
    assert align.chains([(1, 1), (5, 5), (9, 10), (2, 90)]) == [[0, 1, 2], [3]]


def test_edit_gains_are_exact():
    rng = np.random.default_rng(3)
    t = simulate.sequence(14, rng)
    rates = likelihood.Rates(0.03, 0.04, 0.05)
    for _ in range(3):
        r = likelihood.with_errors(t, rates, rng)
        got, now = likelihood.edit_gains(r, t, rates), likelihood.log_likelihood(r, t, rates)
        for i in range(len(t)):
            for k, (kind, b) in enumerate(likelihood.EDITS):
                want = likelihood.log_likelihood(r, likelihood.edited(t, i, kind, b), rates) - now
                assert got[i, k] == pytest.approx(want, abs=1e-8)


def test_phasing_recovers_haplotypes():
    haps = simulate.haplotypes(120, 2, 0.03, seed=4)
    reads, truth = simulate.pileup(haps, 12, 0.05, seed=4)
    labels, score = likelihood.phased(reads, haps[0], 12.0, 2, seed=1)
    agree = np.mean(labels == truth)
    assert max(agree, 1 - agree) >= 0.9 and score > 0


def test_search_reaches_the_exact_score():
    rng = np.random.default_rng(5)
    truth = np.repeat([0, 1], 10)
    gains = np.where(truth[:, None] == [0, 1, 1], 1.0, -1.0) + 0.2 * rng.standard_normal((20, 3))
    labels, best = cluster.exact(gains, 2)
    agree = np.mean(labels == truth)
    assert max(agree, 1 - agree) == 1
    found, _ = cluster.clustered(gains, 2, 10.0, 1, restarts=3, flips=5)
    agree = np.mean(found == truth)
    assert max(agree, 1 - agree) == 1
    use = cluster.used_columns(gains, truth, 2)
    assert use.all()
    assert cluster.allotted(np.array([30.0, 10.0]), 4).tolist() == [3, 1]
    assert cluster.binomial_tail(3, 0.5).tolist() == pytest.approx([1, 7 / 8, 4 / 8, 1 / 8])
    sim = np.kron(np.eye(2), np.ones((5, 5))) + 1e-6
    assert len(set(cluster.spectral(sim, np.zeros((10, 2)), 2, 0)[:5])) == 1


def test_copy_numbers():
    nodes = [(20.0, 4), (41.0, 6), (19.0, 3), (39.0, 5)]
    edges = [(0, False, 1, True, 20.0), (2, False, 1, True, 21.0), (1, False, 3, True, 40.0)]
    assert copies.estimated(nodes, edges, 20.0) == ([1, 2, 1, 2], [1, 1, 2])
    assert copies.sampled(np.array([19.0, 41.0, 60.0]), 20.0).tolist() == [1, 2, 3]


def test_surgery_and_spelling():
    seq = {i: s for i, s in enumerate(["AACCGGTTAC", "GGGTTTCCCA", "TTAGGCATCG", "CATCATCATG", "GTGTGTCACA"])}
    line = [(0, False, 1, True, 9, 0), (1, False, 2, True, 9, -3)]
    g = ChunkGraph([(i, 10, 1, seq[i]) for i in range(3)], line)
    g.check()
    contigs, links, tiles = g.spell()
    assert contigs == [("tig_0000", seq[0] + seq[1] + seq[2][3:])] and links == [] and [t[2] for t in tiles] == [0, 1, 2]
    flip = ChunkGraph([(0, 5, 1, seq[0]), (1, 5, 1, seq[1])], [(0, False, 1, False, 5, 2)])
    assert flip.spell()[0] == [("tig_0000", seq[0] + "NN" + reverse_complement(seq[1]))]
    cross = ChunkGraph([(i, 10, 2 if i == 2 else 1, seq[i]) for i in range(5)], [(0, False, 2, True, 9, 0), (1, False, 2, True, 9, 0), (2, False, 3, True, 9, 0), (2, False, 4, True, 9, 0)])
    assert len(cross.spell()[0]) == 5
    assert cross.bypass({(0, 4): 5, (1, 3): 6}) == 1
    cross.check()
    assert sorted(len(s) for _, s in cross.spell()[0]) == [30, 30]
    fork = ChunkGraph([(0, 20, 1, "A" * 9), (1, 15, 1, "C" * 9), (2, 2, 0, "G" * 9), (3, 20, 1, "T" * 9)], [(0, False, 1, True, 15, 0), (0, False, 2, True, 2, 0), (1, False, 3, True, 15, 0), (2, False, 3, True, 2, 0)])
    assert fork.zip_forks() == 1 and 2 not in fork.occ and len(fork.spell()[0]) == 1
    assert vertex_cover([(1, 2), (2, 3), (2, 4), (5, 6)]) == [2, 6]
