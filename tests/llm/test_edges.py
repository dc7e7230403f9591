"""Nulls, empty and very long texts, repeated rows, ties, empty tables and clashing names, for every operator and stage."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from longweave.llm import bpe, decontaminate, embeddings, language, line_dedup, pii, sharding, simhash, token_counts, toxicity
from longweave.llm.queries import tokenizer_path

CLASH = ["score", "predicted", "held_out", "lang_pred", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "over_limit", "fingerprint", "component_id", "n_links", "kept", "lines_dropped", "n_lines", "shard", "depth", "prefix", "n_email", "spans", "base", "row", "words", "similarity", "item_id", "cell", "side", "node", "__lw_host"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    out = [(i, prose(60) + "\nshared line of a site", "en" if i % 2 else "de", f"s{i % 3}") for i in range(60)]
    long = prose(40_000)
    out += [(100, None, "en", "s0"), (101, "", None, "s1"), (102, " \t\n", "de", None), (None, prose(50), "en", "s1"), (103, long, "en", "s2"), (104, long + " more", "de", "s2"), (105, "q" * 200_000, "en", "s0"), (106, "é 日本 \x00 \ue000", None, "s1")]
    out += [out[3], out[3], (7, "another text of the same id " + prose(40), "de", "s1"), (107, "mail a.b@c.org or 10.0.0.1", "en", "s0")]
    return [(i, t, g, s, len(t) if t is not None else None) for i, t, g, s in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(60)] + [(3, 0, 1), (None, 0, 1), (8, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    words = rows()[5][1].split()
    return spark.createDataFrame([(1, " ".join(words[5:25])), (2, ""), (3, None), (None, "a b"), (1, " ".join(words[5:25])), (4, " ".join(words[5:25]))], "item_id long, text string")


def crowded(df):
    """``df`` with a column of text for every name that an operator may use."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("own") for c in CLASH if c not in df.columns})


def operators(labels, items):
    path = tokenizer_path
    return {
        "op2": lambda d: toxicity.scored(d, labels), "op3": line_dedup.digest, "op4": language.identified, "op5": lambda d: sharding.assigned(d, 50_000), "op6": lambda d: bpe.encoded(d, path("word_bpe_49k.json")),
        "op7": lambda d: token_counts.token_counts(d, path("byte_bpe_50k.json")), "op8": simhash.near_duplicates, "op9": lambda d: decontaminate.contaminated(d, items), "op10": pii.digest,
    }


def told(df):
    return Counter(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.collect())


@pytest.mark.parametrize("op", ["op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_clashing_names_repeats_and_empty_tables(spark, docs, labels, items, op):
    run = operators(labels, items)[op]
    plain = told(run(docs))
    assert told(run(crowded(docs))) == plain
    if op != "op9":
        assert sum(plain.values()) == docs.count()
    assert run(docs.where("false")).count() == 0


def test_contaminated_rows_repeat(docs, items):
    got = [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()]
    assert Counter(got) == Counter([(5, 1), (5, 4)])
    twice = docs.unionByName(docs)
    assert Counter((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(twice, items).collect()) == Counter({(5, 1): 2, (5, 4): 2})


def test_buckets_hold_all_within_the_radius():
    rng = np.random.default_rng(3)
    own = rng.integers(0, 2**63, 300, dtype=np.uint64)
    fp = own[rng.integers(0, 300, 500)]
    for i in range(500):
        for b in rng.integers(0, 64, rng.integers(0, 30)):
            fp[i] ^= np.uint64(1) << np.uint64(b)
    q, i = decontaminate.Buckets(own, decontaminate.RADIUS).within(fp)
    want = np.bitwise_count(fp[:, None] ^ own[None]) <= decontaminate.RADIUS
    got = np.zeros_like(want)
    got[q, i] = True
    assert (got == want).all() and len(q) == want.sum()


@pytest.mark.parametrize("k", range(5))
def test_stages_keep_odd_rows(spark, docs, labels, items, tmp_path, k):
    name, stage = corpus_pipeline.STAGES[k]
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    full = crowded(docs)
    got = stage(spark, full, str(tmp_path))
    if k < 4:
        assert got.columns == full.columns and got.dtypes == full.dtypes
    else:
        assert got.count() == docs.count()
    ids = Counter(r["doc_id"] for r in got.select("doc_id").collect())
    if name in ("toxicity", "benchmark_decontamination"):
        assert {100, 101, 102, 105, 106} <= set(ids)
    if name == "simhash_near_dedup":
        # repeats of one row go, a second text of one id stays, as do rows without words or id
        assert ids[3] == 1 and ids[7] == 2 and ids[None] == 1 and ids[103] == 1 and 104 not in ids and {100, 101, 102} <= set(ids)
    if name == "benchmark_decontamination":
        assert 5 not in ids
    assert stage(spark, full.where("false"), str(tmp_path)).count() == 0


def test_share_at_the_ratio_stays(spark):
    pages = [(i, "h", f"line {i}\n" + ("half" if i < 5 else "") + ("\nmore" if i < 6 else "")) for i in range(10)]
    got = line_dedup.without_boilerplate(spark.createDataFrame(pages, "doc_id long, host string, text string"), host="host", ratio=0.5, least=1)
    text = {r["doc_id"]: r["text"] for r in got.collect()}
    assert "half" in text[0] and "more" not in text[0]


def test_hosts_of_urls(spark, monkeypatch):
    from pyspark.sql import functions as F

    urls = ["https://User@Example.com:8080/a?b", "http://example.com", "ftp://x.org#f", "no url", None, "//y/z"]
    df = spark.createDataFrame(list(enumerate(urls)), "i int, url string").select("i", line_dedup.host_of(F.col("url")).alias("h"))
    assert [r["h"] for r in df.orderBy("i").collect()] == ["example.com", "example.com", "x.org", None, None, None]
    pages = spark.createDataFrame([(i, f"https://{'a' if i % 2 else 'b'}.org/{i}", f"line {i}\nmenu of a" if i % 2 else f"line {i}") for i in range(20)], "page_id long, url string, text string")
    run = lambda: sorted(tuple(r) for r in line_dedup.without_boilerplate(pages, host=line_dedup.host_of(F.col("url")), ratio=0.3).collect())
    want = run()
    assert all("menu" not in r[2] for r in want)
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert run() == want


def test_shards_hold_all_rows(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "s"), 20_000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and told(back.select("doc_id", "text")) == told(docs.select("doc_id", "text"))
    want = sharding.assigned(docs, 20_000).select("shard").distinct().count()
    assert len(list((tmp_path / "s").glob("shard=*"))) == want


def test_embeddings_at_the_threshold_and_repeated(spark):
    a = [0.6, 0.8, 0.0, 0.0]
    at = [0.6, 0.8, 0.0, 0.0]
    far = [float(x) for x in np.cos(0.4) * np.array(a) + np.sin(0.4) * np.array([0, 0, 1.0, 0])]
    df = spark.createDataFrame([(1, a, "x"), (1, at, "y"), (2, far, "z"), (3, [1.2, 1.6, 0.0, 0.0], "w")], "vec_id long, embedding array<double>, component_id string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df, threshold=float(np.dot(a, a))).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 2, 1, False)]


def test_margins_are_the_plain_kernel():
    """The machine's weights over hashed subsequences give what summing over all subsequences one by one gives."""
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(size=toxicity._FEATURES).astype(np.float32), 0.25)
    units = ["moron", "m.o.r.o.n", "mo\tron", "abc", "é9x_", "x" * 24]
    for u, got in zip(units, model.margins(units), strict=True):
        x = [0, *map(toxicity._symbol, u), 1]
        total: dict[int, float] = {}
        for i in range(len(x)):
            for j in range(i + 1, min(len(x), i + toxicity.SPAN)):
                for k in range(j + 1, min(len(x), i + toxicity.SPAN)):
                    f = (((x[i] * 64 + x[j]) * 64 + x[k]) * 40503 >> 4) & (toxicity._FEATURES - 1)
                    total[f] = total.get(f, 0.0) + toxicity.DECAY ** (k - i - 2)
        norm = sum(v * v for v in total.values()) ** 0.5
        assert abs(got - (0.25 + sum(model.table[f] * v for f, v in total.items()) / norm)) < 1e-4


def test_documents_score_as_their_worst_string():
    rng = np.random.default_rng(5)
    model = toxicity.Model((rng.normal(size=toxicity._FEATURES) * 3).astype(np.float32), 0.0)
    texts = ["one two m o r o n", "a\nb  c d e, an id io t here.", "x", "", None, "long " * 3000 + "end"]
    for t, got in zip(texts, toxicity.Scorer(model).worst(texts), strict=True):
        words = (t or "").lower().split()
        units = set()
        for w in words:
            u = toxicity._EDGE.sub("", w)
            units |= {u, toxicity._SIGNS.sub("", u)}
        for n in (2, 3):
            for i in range(len(words) - n + 1):
                part = words[i : i + n]
                if all(len(w) <= 3 for w in part) and sum(map(len, part)) > 3:
                    units.add(toxicity._EDGE.sub("", "\t".join(part)))
        units |= {"".join(m[0].split()) for m in toxicity._SINGLES.finditer((t or "").lower())}
        scores = [float(model.margins([x])[0]) for u in units if len(u) > 2 for x in toxicity.windows(u)]
        assert abs(got - max([-3.0, *scores])) < 1e-5
