"""Near-duplicates, embeddings and decontamination against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from longweave.llm import decontaminate, embeddings, simhash
from longweave.llm.common import forest, words_of

DOCS = "doc_id long, text string"


def plain_print(text):
    x = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(y.encode(), 42) for y in s]
    return sum(1 << b for b in range(64) if 2 * sum((v >> b) & 1 for v in h) > len(h))


def groups(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus(n=160, seed=3):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)] + ["É", "ß", "don't", "x."]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(30, 200))) for _ in range(n)]
    for _ in range(n):
        w = rng.choice(texts[:n]).split(" ")
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    return texts + ["", " \t\n", None, "one", "ONE", "one two", texts[0].upper(), texts[1].replace(" ", "\n")]


def test_fingerprints_and_components(spark):
    texts = corpus()
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    prints = {i: plain_print(t) for i, t in rows}
    ids = sorted(prints)
    want = groups(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3])
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_repeats_nulls_and_clashing_names(spark):
    rows = [(5, "a b c d", "x"), (5, "a b c d", "y"), (2, "A B C D", "z"), (None, "a b c d", "n"), (None, None, "m"), (9, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 2), (5, 2), (2, 2), (None, 2), (None, 9), (9, 9)], key=str)
    assert simhash.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("words,ratio", [(1, 0.0), (2, 0.8)])
def test_cells_find_all_links(words, ratio):
    rng = np.random.default_rng(1)
    n, radius = 900, 3 if words == 1 else 30
    base = rng.integers(0, 2**63, (300, words), dtype=np.uint64)
    fp = base[rng.integers(0, 300, n)]
    for i in range(n):
        for b in rng.integers(0, 64 * words, rng.integers(0, 6)):
            fp[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    size = rng.integers(50, 80, n)
    order = np.lexsort((size if ratio else simhash._counts(fp).sum(axis=1),))
    fp, size, node = fp[order], size[order], np.arange(n)
    tiles = []
    for i in range(0, n, 128):
        s = slice(i, i + 128)
        c = simhash._counts(fp[s])
        tiles.append((2, node[s], fp[s], size[s], c.min(axis=0), c.max(axis=0), size[s].min(), size[s].max()))
    a, b, _ = simhash._cell(tiles, radius, words, ratio)
    d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2)
    ok = d <= radius
    if ratio:
        ok &= np.minimum(size[:, None], size[None]) >= ratio * np.maximum(size[:, None], size[None]) - 1e-9
    i, j = np.nonzero(np.triu(ok, 1))
    assert groups(range(n), zip(a.tolist(), b.tolist(), strict=True)) == groups(range(n), zip(i.tolist(), j.tolist(), strict=True))
    assert len(a) < n and ok[a, b].all()


def test_unrelated_texts_propose_nothing(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.bytes(8 * simhash.PROPOSING), 100) for i in range(16_000)]  # 310 links within 38 bits of 128
    alike = bytes([rows[7][1][0] ^ 255, rows[7][1][1], rows[7][1][2] ^ 7, *rows[7][1][3:]])
    nodes = spark.createDataFrame([*rows, (20_000, alike, 100)], "node long, fp binary, n_shingles long")
    got = simhash.tiled_links(nodes, 38, simhash.NEAR_WORDS, 0.8, 78).collect()
    assert [(min(r["a"], r["b"]), max(r["a"], r["b"]), r["d"]) for r in got] == [(7, 20_000, 11)]


def test_words_of_a_fingerprint():
    h = simhash.hashed([b"%d" % i for i in range(700)])
    for own in (h, h[:1], h[:0]):
        fp = np.frombuffer(simhash.majorities(own, 4), ">u8")
        for w in fp:
            assert w == simhash.majority(own)
            own = simhash.remixed(own)


def test_few_shingles_link_only_if_equal(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e g"), (3, "a b c d e f a b c d e f"), (4, "A b c  d e f"), *((10 + i, f"p{i} q{i} r{i} s{i} t{i} u{i}") for i in range(300))]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    assert got == {i: 1 if i == 4 else i for i, _ in rows}
    prints = simhash.fingerprints(df, 5, simhash.PROPOSING, distinct=True).where("doc_id <> 4")
    assert simhash.tiled_links(prints.select(prints.doc_id.alias("node"), "fp", "n_shingles"), 38, simhash.NEAR_WORDS, 0.8, 78).count() == 0


def test_forest_is_minimal():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n, m = 30, 120
        a, b, d = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 9, m)
        root, weight, count = list(range(n)), 0, 0

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for k in np.argsort(d, kind="stable"):
            x, y = find(a[k]), find(b[k])
            if x != y:
                root[x] = y
                weight += d[k]
                count += 1
        f = forest(n, a, b, d)
        assert len(f) == count and d[f].sum() == weight


def test_similar_documents(spark):
    texts = corpus(120, 9)
    rows = list(enumerate(texts))
    sets = {i: set(simhash.shingles(words_of(t), 5)) for i, t in rows}
    live = [i for i in sets if sets[i]]
    want = groups(live, [(a, b) for k, a in enumerate(live) for b in live[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i: got[i] for i in live} == want
    kept = {r["doc_id"] for r in simhash.one_of_each(spark.createDataFrame(rows, DOCS)).collect()}
    assert kept == {i for i in live if want[i] == i} | (set(sets) - set(live))


@pytest.mark.parametrize("copies", [20, 300])
def test_copies_alike_only_by_their_original(spark, copies):
    rng = random.Random(copies)
    vocab = ["w%d" % i for i in range(2000)]
    rows = []
    for g in range(4):
        first = [rng.choice(vocab) for _ in range(200)]
        want = set(simhash.shingles(words_of(" ".join(first)), 5))
        rows.append((1000 * g + copies, " ".join(first)))
        while len(rows) < (g + 1) * (copies + 1):
            w = list(first)
            for _ in range(3):
                w[rng.randrange(200)] = rng.choice(vocab)
            own = set(simhash.shingles(words_of(" ".join(w)), 5))
            if len(own & want) >= 0.8 * len(own | want):
                rows.append((1000 * g + len(rows) % (copies + 1) - 1, " ".join(w)))
    got = simhash.similar_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len({i for i, _ in rows}) and all(r["component_id"] == r["doc_id"] // 1000 * 1000 for r in got)


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 24)).astype(np.float32)
    x = np.vstack([base, base[:40] + 0.15 * rng.standard_normal((40, 24)), base[:10] * 3, base[:5]]).astype(np.float32)
    rows = [(7 * i + 2, v.tolist()) for i, v in enumerate(x)] + [(1, None), (3, []), (4, [0.0] * 24), (5, [float("nan")] + [1.0] * 23), (6, [None] + [1.0] * 23), (8, [1.0, 2.0]), (None, base[0].tolist())]
    ok = {i: np.array(v, dtype=np.float64) for i, v in rows if i is not None and v and len(v) == 24 and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(ok)
    unit = np.array([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    cos = unit @ unit.T
    link = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(cos >= 0.95, 1)), strict=True)]
    want, n = groups(ids, link), Counter(z for p in link for z in p)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert len(got) == len(rows)
    for i in ids:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n[i], want[i], want[i] == i)
    for i in (1, 3, 4, 5, 6, 8):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, False)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bounds_lose_no_link_and_prune():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 64))
    x = np.vstack([x, x[:200] + 0.3 * rng.standard_normal((200, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = embeddings.Codes.of(x, embeddings.rotation(64))
    got = np.zeros((len(x), len(x)), dtype=bool)
    got[embeddings.survivors(codes, codes, 0.95)] = True
    true = x @ x.T >= 0.95
    assert got[true].all() and got.mean() < 0.01


@pytest.mark.parametrize("dim", [3, 64, 100])
def test_estimates_are_unbiased(dim):
    rng = np.random.default_rng(6)
    o, q = rng.standard_normal((2, dim))
    o, q = o / np.linalg.norm(o), q / np.linalg.norm(q)
    x, seen = np.array([o, 0.9 * o + 0.436 * (q - (q @ o) * o) / np.linalg.norm(q - (q @ o) * o)]), []
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for seed in range(800):
        c = embeddings.Codes.of(x, embeddings.rotation(dim, seed), seed)
        seen.append(embeddings.estimates(c, c, np.array([0]), np.array([1]))[0] / c.factor[0])
    assert abs(np.mean(seen) - x[0] @ x[1]) < 5 * np.std(seen) / np.sqrt(len(seen))


def plain_hits(w, items):
    out = {}
    for item, v in items:
        n = len(v)
        if not n or len(w) < n:
            continue
        want = Counter(simhash.shingles(v, 5))
        sims = [decontaminate.weighted_similarity(Counter(simhash.shingles(w[i : i + n], 5)), want) for i in range(len(w) - n + 1)]
        best = max(sims)
        if best >= 0.8:
            out[item] = (round(best, 9), sims.index(best), n)
    return out


def test_decontamination(spark):
    rng = random.Random(8)
    vocab = ["v%d" % i for i in range(80)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 12, 20, 20, 31])))) for i in range(25)] + [(90, ""), (91, None), (None, "a b c"), (92, "solo")]
    docs = []
    for i in range(80):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        if i % 2:
            v = rng.choice(items[:25])[1].upper().split()
            if i % 4 == 1:
                v[rng.randrange(len(v))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = v
        docs.append((i, " ".join(w)))
    docs += [(100, None), (101, ""), (102, "x SOLO y"), (None, items[0][1])]
    got = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    have = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["start"], r["n_words"]) for r in got}
    plain = [(i, words_of(t)) for i, t in items if i is not None]
    want = {(d, item): x for d, t in docs for item, x in plain_hits(words_of(t), plain).items()}
    assert have == want and len(want) > 20
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(spark.createDataFrame(docs, DOCS), none).count() == 0
