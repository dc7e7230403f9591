"""The pipeline's stages against plain versions of what they decide."""

import corpus_pipeline
from longweave.llm import decontaminate, simhash
from longweave.llm.common import words_of
from longweave.session import saved


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = saved(stage(spark, docs, sf), name)
        rows = {r["doc_id"]: r for r in docs.collect()}
        assert len(rows) == docs.count() and set(rows) <= set(before)
        if name != "bpe":
            assert docs.columns == columns
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            clean = [i for i in before if labels.get(i) == 0]
            assert sum(i in rows for i in clean) >= 0.97 * len(clean)
        if name == "line_dedup":
            assert set(rows) == set(before) and all(len(r["text"]) == r["n_chars"] for r in rows.values())
        if name == "simhash_near_dedup":
            sets = {i: set(simhash.shingles(words_of(r["text"]), 5)) for i, r in before.items()}
            like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            live = sorted(i for i in sets if sets[i])
            pairs = [(a, b) for k, a in enumerate(live) for b in live[k + 1 :] if like(a, b)]
            comp = {i: i for i in live}

            def find(x):
                while comp[x] != x:
                    x = comp[x]
                return x

            for a, b in pairs:
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
            assert set(rows) == {i for i in sets if not sets[i] or find(i) == i}
        if name == "benchmark_decontamination":
            items = [(r["item_id"], r["text"].encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            index = decontaminate.Index(items)
            assert set(rows) == {i for i, r in before.items() if not index.hits(r["text"].encode())}
    assert rows and docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == set(rows)
