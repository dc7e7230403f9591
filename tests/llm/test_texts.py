"""Encoding, counts, language, toxicity, lines, shards and personal data."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from longweave.llm import bpe, language, line_dedup, pii, sharding, token_counts, toxicity
from longweave.llm.queries import tokenizer_path

DOCS = "doc_id long, text string"
ODD = ["a", "B", "é", "é", " ", "  ", "\n", "\t", "'s", "'", "9", "12", "日本", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "😀", "ß", "İ", "Σ", " ", "\x85", "\x1c", "​", "%%", "한", "가", "A.", "b, ", ". "]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 300))) for _ in range(n)] + ["", " ", "x" * 3000]


@pytest.mark.parametrize("bits", [1, 3, bpe.CUT_BITS])
def test_codec_is_the_library(bits):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tok, codec = Tokenizer.from_file(path), bpe.ChunkedCodec(path, bits)
    texts = odd_texts(200)
    for t, own in zip(texts, codec.encode_batch([t.encode() for t in texts]), strict=True):
        n, ids, decoded = codec.spelled(own)
        want = tok.encode(t, add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want)))
        assert decoded == codec.decode(want) == tok.decode(want, skip_special_tokens=False)


def test_windows_grow_until_they_agree():
    """Chunks whose kept ids are wrong near a cut disagree with the window, which then takes in more of them."""
    codec = bpe.ChunkedCodec(tokenizer_path("word_bpe_49k.json"))
    a, b = b"one two three four five six sev", b"en eight nine ten eleven twelve"
    own = {x: codec.encode_batch([x])[0] for x in (a, b)}
    good = codec._repaired({(a, b)}, own)[a, b]
    assert codec.grown == 0 and len(good[1]) < len(own[a])
    wrong = own | {a: own[a][:-16] + bytes(16)}
    drop, middle, after = codec._repaired({(a, b)}, wrong)[a, b]
    assert codec.grown > 0 and wrong[a][: len(own[a]) - drop] + middle + own[b][after:] == codec.encode_batch([a + b])[0]


def test_unproven_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.ChunkedCodec(tokenizer_path("byte_bpe_50k.json"))


def test_long_text_without_spaces(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    text = "".join(random.Random(3).choice("abcdefgh") for _ in range(60_000))
    ids = bpe.ChunkedCodec(path).encode(("x " + text + " y").encode())
    assert ids == Tokenizer.from_file(path).encode("x " + text + " y", add_special_tokens=False).ids


def test_chunks_are_shared():
    rng = random.Random(4)
    passage = " ".join("word%d" % rng.randrange(10**6) for _ in range(2000)).encode()
    codec = bpe.ChunkedCodec(tokenizer_path("word_bpe_49k.json"))
    codec.encode(b"one " + passage)
    before = codec.encoded_bytes
    codec.encode(b"another beginning " + passage + b" and end")
    assert codec.encoded_bytes - before < 0.05 * len(passage)


def test_caches_are_bounded():
    kept = bpe.Generations(25 * (bpe.Generations.OBJECTS + 4))
    for i in range(1000):
        kept.put("%04d" % i, i)
    assert len(kept.young) + len(kept.old) <= 52 and kept.get("0999") == 999 and kept.get("0000") is None


def test_encoded_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (1, "Hello World", 0), (None, "", 0)], DOCS + ", n_tokens int")
    got = {(r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in bpe.encoded(df, tokenizer_path("word_bpe_49k.json")).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert (1, 0, none) in got and (None, 0, none) in got and len(got) == 3
    assert bpe.encoded(df.where("false"), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = [*enumerate(odd_texts(150, 2)), (900, None), (None, "x"), (900, "again " * 600)]
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(spark.createDataFrame(rows, DOCS), path).collect())
    n = [len(tok.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert got == Counter((i, len((t or "").encode()), k, k > 512) for (i, t), k in zip(rows, n, strict=True))
    assert token_counts.token_counts(spark.createDataFrame([], DOCS), path).count() == 0


def test_language_on_held_out(spark, sf):
    got = language.identified(spark.read.parquet(sf + "/documents.parquet")).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(sf + "/documents.parquet").collect()}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_without_letters(spark):
    rows = [(0, "le chat est la", "fr"), (1, "the cat is here", "en"), (3, None, "en"), (4, "123 !", "en"), (5, "", None), (6, "where the", None), (None, "est le chat", None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identified(spark.createDataFrame(rows, DOCS + ", lang string")).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert got[6][0] == "en" and got[None][0] == "fr"
    blank = spark.createDataFrame([(1, "a", None)], DOCS + ", lang string")
    assert [r["lang_pred"] for r in language.identified(blank).collect()] == ["und"]


def test_kernel_matches_plain_subsequences():
    def plain(u):
        x = [0, *(toxicity._symbol(c) for c in u), 1]
        f = defaultdict(float)
        for i in range(len(x)):
            for j in range(i + 1, len(x)):
                for k in range(j + 1, len(x)):
                    if k - i < toxicity.SPAN:
                        f[x[i], x[j], x[k]] += toxicity.DECAY ** (k - i - 2)
        return f

    def dot(a, b):
        return sum(v * b.get(k, 0) for k, v in a.items())

    units = ["idiot", "iddiot", "idxiot", "harmless", "été"]
    got = toxicity.kernel(units, units)
    for i, a in enumerate(map(plain, units)):
        for j, b in enumerate(map(plain, units)):
            assert abs(got[i, j] - dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5) < 0.02
    assert got[0, 1] > got[0, 3] and got[0, 2] > got[0, 3]


def test_toxicity_tolerates_gaps(spark):
    rng = random.Random(6)
    vocab = ["%s%s%s" % (rng.choice(["ba", "lo", "mi", "te"]), rng.choice(["ra", "no", "si"]), rng.choice(["n", "la", "ko", ""])) for _ in range(40)]
    bad = ["idiot", "moron", "pathetic"]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(vocab) for _ in range(30)]
        toxic = i % 3 == 0
        if toxic:
            w[rng.randrange(30)] = rng.choice(bad)
        rows.append((i, " ".join(w) + "."))
        labels.append((i, int(toxic)))
    for i, v in enumerate(["iddiot", "i.d.i.o.t", "mo-ron", "m o r o n"]):
        rows.append((1000 + i, "bara %s losi." % v))
    rows += [(2000, None), (2001, ""), (2002, "bara losi nola"), (None, "idiot")]
    got = {r["doc_id"]: r for r in toxicity.scored(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [(got[i]["predicted"], t) for i, t in labels if got[i]["held_out"]]
    assert sum(p == t for p, t in held) >= 0.98 * len(held)
    assert all(got[1000 + i]["predicted"] == 1 for i in range(4)) and got[None]["predicted"] == 1
    assert all(got[i]["predicted"] == 0 for i in (2000, 2001, 2002))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = toxicity.scored(spark.createDataFrame(rows[:5], DOCS), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.count() == 5 and none.where("predicted = 1").count() == 0


def test_scores_do_not_depend_on_the_cache(monkeypatch):
    class Plain:
        def margins(self, units):
            return np.array([1.5 if "insult" in u else -1.0 for u in units])

    words = [f"{i:064x}" for i in range(25_000)]
    texts = [" ".join(words[:k] + ["insult%d" % k] + words[k:]) for k in (0, 12_000, 25_000)] + [" ".join(words)]
    for size in (100, 4_000_000):
        monkeypatch.setattr(toxicity, "CACHE", size)
        assert toxicity.Scorer(Plain()).worst(texts) == [1.5, 1.5, 1.5, -1.0]


def test_line_dedup(spark):
    rows = [(i, "menu\nown line %d\n  menu \r\nfoot" % i, "h1") for i in range(10)] + [(20 + i, "menu\nother %d" % i, "h2") for i in range(400)]
    rows = [(i, t.replace("menu", "x%d" % i) if i >= 22 else t, h) for i, t, h in rows] + [(900, None, "h1"), (901, "menu", None), (902, "", "h1"), (903, "menu\n", "h1")]
    df = spark.createDataFrame(rows, DOCS + ", source string").selectExpr("*", "'old' AS lines_dropped")
    got = {r["doc_id"]: (r["text"], r["lines_dropped"]) for r in line_dedup.without_boilerplate(df, ratio=0.5).collect()}
    assert got[3] == ("own line 3", 3) and got[20] == ("menu\nother 0", 0)
    assert got[900] == (None, 0) and got[901] == ("menu", 0) and got[902] == ("", 0) and got[903] == ("", 1)
    assert len(got) == len(rows)
    assert line_dedup.without_boilerplate(df.where("false")).count() == 0


def test_shards(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, "x" * rng.randint(0, 300)) for i in range(500)] + [(7000, "y" * 5000), (8000, "same"), (8000, "same"), (None, None), (1, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", shard int")
    got = sharding.assigned(df, 2000).collect()
    assert len(got) == len(rows)
    size = Counter()
    for r in got:
        size[r["shard"]] += r["n_bytes"]
        assert len(r["shard"]) == r["depth"] and int(r["shard"] or "0", 2) == r["prefix"]
    assert all(size[r["shard"]] == r["shard_bytes"] for r in got)
    assert {r["doc_id"] for r in got if r["oversized"]} == {7000}
    shards = sorted(size)
    assert not any(b.startswith(a) for a in shards for b in shards if a != b)
    for a in shards:  # no split was needless
        if a and len(a) < sharding.BITS:
            parent = [r for r in got if r["shard"].startswith(a[:-1])]
            assert sum(r["n_bytes"] for r in parent) > 2000
    assert [r["shard"] for r in sharding.assigned(df.limit(1), 2000).collect()] == [""]
    sharding.write_shards(df, str(tmp_path / "s"), 2000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter(rows)
    assert sharding.assigned(df.where("false"), 2000).count() == 0


#: The contract's patterns, as Python spells them.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    n = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 * (x > 9) for x in n) % 10 == 0


def plain_spans(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans(spark):
    rng = random.Random(5)
    parts = ["1", "23", "4", "255", ".", "..", "-", " ", "(", ")", "+", "+1", "@", "a", "b.c", "x_y", "%", "é", "😀", "", "\n", "user@mail.com", "10.0.0.1", "4539578763621486", "+1 (555) 010-9999", "300.1.1.1", "0000255.1.2.3", "a@b.co_x@d.com"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += ["", None, "1" * 5000, "a" * 50_000, "a@b" + ".c" * 5000, "1 " * 3000, "+1" + " " * 20_000]
    rows = [*enumerate(texts), (None, "10.0.0.1"), (0, texts[0])]
    got = pii.digest(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    want = {(i, hashlib.sha256(",".join(plain_spans(t)).encode()).hexdigest(), *(sum(x.startswith(k + ":") for x in plain_spans(t)) for k in PLAIN)) for i, t in rows}
    assert {(r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got} == want
    assert pii.digest(spark.createDataFrame([], DOCS)).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    rng = random.Random(9)
    rows = [(i, "Please write. My phone number: +1 (555) 010-%04d thanks" % (1000 + i)) for i in range(12)]
    rows += [(100, "so my phone number: 555-0199, and"), (101, "it sold 555-0199 copies"), (102, "on page 17 of")]
    rows += [(200 + i, "in room %d there" % rng.randrange(1000)) for i in range(20)]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[100] == "phone:20:28" and got[101] == "" and got[102] == ""
    assert all(got[200 + i] == "" for i in range(20))
    assert got[3] == ",".join(plain_spans(rows[3][1]))


def test_second_generation_of_patterns(spark):
    """Values that one context gives support another in which no base span stands; values may have signs, spaces or no digits."""
    rows, odd = [], ["ann.lee(at)corp.example", "bo_ray(at)mail.example", "cy%dee(at)x.example", "di.eck(at)y.example", "ed.fox(at)z.example", "flo.gee(at)z.example"]
    for i in range(40):
        rows.append((i, f"please write to user{i}@corp.example today"))
    for i, x in enumerate(odd):
        rows.append((100 + i, f"please write to {x} today"))
        rows.append((200 + i, f"reachable under {x} always"))
    rows.append((300, "reachable under new.person(at)corp.example always"))
    rows.append((301, "it says nothing of new.person(at)corp.example always"))
    for i in range(30):
        rows.append((400 + i, f"dial +1 555 010 {1000 + i} now"))
    rows.append((500, "dial 555 010 7777 now"))
    got = {r["doc_id"]: r["spans"] for r in pii.digest(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[300] == "email:16:42" and got[301] == ""
    assert got[100] == f"email:16:{16 + len(odd[0])}" and got[500] == "phone:5:17"


def test_table_covers_all_partitions(spark):
    """Frequent words count wherever they stand, in whatever partition."""
    path = tokenizer_path("byte_bpe_50k.json")
    rows = [(i, "a " + " ".join([f"zebra{i // 100}"] * 50)) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS).repartitionByRange(4, "doc_id")
    table = token_counts.frequent_lengths(df, path)
    assert " zebra" in table and {"0", "1", "2", "3"} <= set(table)
    some = token_counts.Summary(10)
    for i in range(100):
        some.add({f"w{i}": 1, "often": 3}, 4)
    assert len(some.n) <= 12 and "often" in some.n


def test_language_against_plain_bayes(spark):
    """Batches of texts, cut anywhere, score like one n-gram at a time."""
    rng = np.random.default_rng(0)
    logp = rng.normal(size=(language.BUCKETS + 1, 3)).astype(np.float32)
    texts = [*odd_texts(40, 5), "", None, "123", "y" * 5000, "Aé b", "Aé b"]
    got = language.batch_scores(texts, logp)
    for t, row in zip(texts, got, strict=True):
        x = language.codes(t) if t else []
        if not len(x):
            assert np.isnan(row).all()
            continue
        want = logp[-1].astype(float)
        for n in language.ORDERS:
            for i in range(len(x) - n + 1):
                h = n
                for c in x[i : i + n]:
                    h = ((h ^ int(c)) * 0x9E3779B1) & 0xFFFFFFFF
                    h ^= h >> 15
                want = want + logp[h & (language.BUCKETS - 1)]
        assert np.allclose(row, want, rtol=1e-4)


def test_new_words_of_many_texts_are_met_together(monkeypatch):
    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.standard_normal(toxicity._FEATURES).astype(np.float32), -1.0)
    texts = [f"word{i} un-like{i}. ab cd ef{i % 7}\n_x_ s t u {i}" for i in range(300)] + ["", None, "word3", "a b c"]
    alone = [max([-3.0, *toxicity.Scorer(model)._learn(sorted({*(t or "").split(), *toxicity.fragments((t or "").split()), *("".join(m[0].split()) for m in toxicity._SINGLES.finditer(t or ""))}))]) for t in texts]
    calls, plain = [], toxicity.Model.margins
    monkeypatch.setattr(toxicity.Model, "margins", lambda self, units: calls.append(len(units)) or plain(self, units))
    scorer = toxicity.Scorer(model)
    assert np.allclose(scorer.worst(texts), alone, atol=1e-5) and len(calls) == 1
    monkeypatch.setattr(toxicity, "MET", 50)
    assert np.allclose(toxicity.Scorer(model).worst(texts), alone, atol=1e-5) and len(calls) < 60


def test_fragments():
    words = "abc de f gh i jkl longer a b c d xyz".split()
    want = {f"{a}\t{b}" for a, b in zip(words, words[1:], strict=False) if len(a) <= 3 and len(b) <= 3 and len(a) + len(b) > 3}
    want |= {f"{a}\t{b}\t{c}" for a, b, c in zip(words, words[1:], words[2:], strict=False) if max(len(a), len(b), len(c)) <= 3 and len(a) + len(b) + len(c) > 3}
    assert toxicity.fragments(words) == want and not toxicity.fragments([]) and not toxicity.fragments(["ab"]) and toxicity.fragments(["ab", "cd"]) == {"ab\tcd"}
