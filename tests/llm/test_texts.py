"""Encoding, leaks and subjects: exact round trips, brute force and planted cases."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taxograph.llm import leakage, subjects, tokenizer
from taxograph.workspace import Workspace

PATH = tokenizer.vocabulary_path("byte_bpe_50k")
SPECIAL = "<|endoftext|>"
BITS = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "'s", "'ll", "'", "1", "23", "é", "世界", "😀", "_", "==", "{}", " ", "zzzz", "aaaa", "    ", SPECIAL]


def tree(codec, parts, leaf):
    while len(parts) > 1:
        parts = [codec.join(*parts[i : i + 2], leaf) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(BITS), st.text(max_size=4)), max_size=60).map("".join), st.integers(1, 17), st.sampled_from([2, 4, 16, 4096]))
def test_parts_join_to_the_encoding(text, size, leaf):
    text = text.encode("utf-8", "ignore").decode()
    codec = tokenizer.codec(PATH)
    want = codec.encoding.encode_ordinary(text)
    assert tree(codec, [codec.encode(text[i : i + size]) for i in range(0, len(text), size)], leaf) == want
    assert codec.encode(text, size, leaf) == want


def test_long_texts_by_halves():
    codec, rnd = tokenizer.codec(PATH), random.Random(8)
    for text in ("q" * 50_000, "ab " * 20_000, "\u00e9" * 9000 + " x" * 9000, "".join(rnd.choice(BITS) for _ in range(30_000)), "{}" * 20_000 + "\n" * 3000, "a1" * 9000):
        assert codec.encode(text) == codec.encoding.encode_ordinary(text)


def test_same_ids_as_the_other_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    rnd = random.Random(2)
    for _ in range(500):
        text = "".join(rnd.choice(BITS) for _ in range(40))
        assert tokenizer.codec(PATH).encode(text) == other.encode(text, add_special_tokens=False).ids


def test_encode_corpus(spark):
    rnd = random.Random(4)
    texts = ["", None, "   ", "x", "word " * 300, "q" * 900, "".join(rnd.choice(BITS) for _ in range(400)), SPECIAL, "z" * 64]
    rows = [(i, t, 5, "k", [1]) for i, t in enumerate(texts)] + [(3, "x", 5, "k", [1]), (None, "abc" * 200, 5, "k", [1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, part int, key string, ids array<int>")
    want = sorted((str(r[0]), tokenizer.codec(PATH).encode(r[1] or "")) for r in rows)
    for size in (1 << 18, 64, 7):
        got = tokenizer.encode_corpus(docs, PATH, Workspace(spark, "test"), part_chars=size)
        assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
        assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got.collect()) == want
    assert tokenizer.encode_corpus(docs.limit(0), PATH, Workspace(spark, "test")).collect() == []
    known = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    assert tuple(tokenizer.same_ids(known, PATH, Workspace(spark, "test"), 7).first()) == (9, 9)


ITEM = "item_id int, prompt string, solution string, doc_id int"


def brute_leaks(docs, items, n):
    words = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    grams = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return {(d, i) for d, t in docs for i, p, s, _ in items if grams(words(t)) & (grams(words(p)) | grams(words(s)))}


@pytest.mark.parametrize("seed, block_words", [(0, 1 << 20), (1, 1 << 20), (2, 10)])
def test_leaks(spark, seed, block_words):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4)]
    line = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, line(rnd.randint(0, 20)), rnd.choice([None, line(15)]), 1) for i in range(25)] + [(None, line(20), None, 1)]
    docs = [(d, rnd.choice([line(rnd.randint(0, 60)), line(8).upper().replace(" ", "\n-- "), "other " + line(5)])) for d in range(60)] + [(900, None), (901, ""), (902, " .. ")]
    docs += [(903, "x " + (items[0][1] or "").upper().replace(" ", ", ") + " y")]
    frames = (spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, ITEM))
    n = 6
    got = leakage.leaks(*frames, min_words=n, block_words=block_words).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute_leaks(docs, [i for i in items if i[0] is not None], n) and len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    clean = leakage.decontaminate(*frames, min_words=n, max_coverage=1.0, block_words=block_words).collect()
    assert len(clean) == len(docs)
    leaked = {r["doc_id"] for r in got}
    before = dict(docs)
    for r in clean:
        assert (r["removed_words"] > 0) == (r["doc_id"] in leaked)
        if r["doc_id"] not in leaked:
            assert r["text"] == before[r["doc_id"]]


def test_leaks_of_nothing_and_places(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c", None, 1)], ITEM)
    assert [tuple(r) for r in leakage.leaks(docs, items, min_words=3).collect()] == [(1, 1, 4, 3, 3)]
    assert leakage.leaks(docs.limit(0), items, 3).collect() == [] and leakage.leaks(docs, items.limit(0), 3).collect() == []
    assert leakage.decontaminate(docs, items, 3, max_coverage=0.5).first()["text"] is None
    assert leakage.decontaminate(docs, items, 3, max_coverage=0.8).first()["text"] == " d"
    assert leakage.word_places("İa Bc") == [(0, 1), (1, 2), (3, 5)] or leakage.word_places("İa Bc")[-1] == (3, 5)


def test_subjects(spark):
    rnd = random.Random(6)
    areas = {a: [f"{a}{x}" for x in "abcdefghijklmnopqrst"] for a in ("sky", "food", "rail")}
    common = [f"common{x}" for x in "abcdefghijklmnopqrstuvwxyz"]
    docs, want, labels = [], set(), []
    for d in range(400):
        own = rnd.sample(sorted(areas), rnd.choice([0, 1, 1, 1, 2]))
        words = rnd.choices(common, k=20) + [w for a in own for w in rnd.sample(areas[a], 8)] + [rnd.choice(areas[rnd.choice(sorted(areas))])]
        rnd.shuffle(words)
        docs.append((d, "_".join(w.capitalize() if rnd.random() < 0.3 else w for w in words), "x"))
        want |= {(d, a.upper()) for a in own}
        if d < 80:
            labels += [(d, rnd.choice([a.upper(), f" {a}"]), "r") for a in own] or [(d, "None", "r")]
    docs += [(1000, None, "x"), (1001, "", "x"), (1002, "  ", "x")]
    frames = (spark.createDataFrame(docs, "doc_id bigint, text string, subject string"), spark.createDataFrame([(a.upper(), None) for a in areas], "subject string, about string"), spark.createDataFrame([*labels, (None, "sky", "r"), (5, None, "r"), (5, "nowhere", "r")], "doc_id bigint, subject string, reader string"))
    found = subjects.subjects(*frames, Workspace(spark, "test"), rank=16)
    got = {(r["doc_id"], r["subject"]) for r in found.collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.02 * len(got)
    assert found.count() == len(got) and found.agg({"cosine": "max"}).first()[0] <= 1
    twice = subjects.subjects(frames[0].union(frames[0]), frames[1], frames[2], Workspace(spark, "test"), rank=16)
    assert twice.count() == twice.select("doc_id", "subject").distinct().count()
    ws = Workspace(spark, "test")
    assert subjects.subjects(frames[0].limit(0), frames[1], frames[2], ws).collect() == []
    assert subjects.subjects(frames[0], frames[1].limit(0), frames[2], ws).collect() == []
    assert subjects.subjects(frames[0].limit(3), frames[1], frames[2].limit(0), Workspace(spark, "test")).count() >= 0
    assert subjects.terms_of("getTrains_fooBar HTTPClass") == ["bar", "foo", "get", "httpclass", "train"]


def test_singular_vectors_and_rounds_of_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(sorted({int(x) for x in rng.zipf(1.3, 30) % 200 + 40 * (d % 4)}),) for d in range(600)]
    features = spark.createDataFrame(rows, "buckets array<int>").repartition(23)
    basis = subjects.singular_vectors(features, rank=8, passes=8, fan_in=3)
    x = np.zeros((len(rows), len(basis.weight)))
    for d, (own,) in enumerate(rows):
        at = basis.row[own]
        at = at[at >= 0]
        x[d, at] = basis.weight[at] / max(np.linalg.norm(basis.weight[at]), 1e-9)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    held = np.linalg.norm(x @ basis.vectors) ** 2
    assert held >= 0.98 * (s[:8] ** 2).sum()  # the basis holds what the best one of that rank holds
    z = x @ basis.vectors
    white = (z - z.mean(0)) @ basis.whitening
    assert np.allclose(np.cov(white.T, bias=True), np.diag(np.diag(np.cov(white.T, bias=True))), atol=0.02) and white.std(axis=0).max() <= 1.01
    parts = spark.createDataFrame([(b, n, np.full(4, n, dtype="float32").tobytes()) for b in range(2) for n in range(23)], "block int, node int, part binary")
    summed = subjects.add_parts(parts, 23, 3)
    assert {(r["block"], r["node"], np.frombuffer(r["part"], dtype="float32")[0]) for r in summed.collect()} == {(0, 0, 253.0), (1, 0, 253.0)}
    assert summed._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 3  # 23 parts, 8, 3, 1
