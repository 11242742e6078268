"""LM scores and language ID against brute force and held-out data."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from planweave.llm import langid, lm_score, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, score string, id string"


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def brute(rows, least=1, base=math.sqrt(2), mu=2.0, alpha=0.1):
    uni, pairs = Counter(), Counter()
    for i, t, train in rows:
        if train:
            w = tokens(t)
            uni.update(w)
            pairs.update(zip([b"\n", *w[:-1]], w, strict=True))
    n, v = sum(uni.values()), len(uni)
    out = []
    for i, t, train in rows:
        w = tokens(t)
        p1 = {x: (uni[x] + alpha) / (n + alpha * (v + 1)) for x in w}
        total = 0.0
        for h, x in zip([b"\n", *w[:-1]], w, strict=True):
            c = pairs[h, x]
            c = base ** (1 + math.floor(math.log(c) / math.log(base) + 1e-9) - 0.5) if c >= least else 0.0
            c = min(c, uni[h], uni[x])
            total += math.log10((c + mu * p1[x]) / (uni[h] + mu))
        out.append((i, len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10(p1[x]) for x in w), total))
    return out


def agrees(got, want):
    """Rows equal to brute force but for false probes, which only raise a score, in one probe of 4096."""
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    assert len(got) == len(want)
    off = 0.0
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:4] == w[:4]
        assert g[4] == pytest.approx(w[4], rel=1e-9)
        assert g[5] <= 0 and g[5] >= w[5] - 1e-6
        off += g[5] - w[5]
    assert off <= 0.002 * -sum(w[5] for w in want)


@pytest.mark.parametrize(("block", "entries", "least", "spread"), [(5000, 3000, 1, 1 << 17), (5000, 3000, 3, 4), (1 << 19, 1 << 20, 1, 1 << 17)])
def test_score(spark, block, entries, least, spread):
    """Many small blocks and ranges, asked by groups or not, and one of each; a very long text; nulls, empty and repeated rows."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(None, "The of"), (9001, None), (9002, ""), (9003, "  \n"), (rows[0]), (9004, "é x y Aİ"), (9005, "the of and " * 60_000)]
    docs = spark.createDataFrame([(i, t, None, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    got = lm_score.score(docs, F.col("doc_id") % 10 != 0, block_tokens=block, range_entries=entries, min_count=least, spread=spread).collect()
    agrees(got, brute([(i, t, i is not None and i % 10 != 0) for i, t in rows], least))


@pytest.mark.parametrize("n", [50, 400])
def test_query_keeps_grams_seen_once(spark, monkeypatch, n):
    """Documents of words that no other has: every bigram but the first of a text has probability (1 + mu * P1) / 3."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}_{k}" for k in range(100))) for i in range(n)], "doc_id long, text string")
    monkeypatch.setattr(queries, "_read", lambda *a: docs)
    got = queries.op2_lm_score(spark, SF).filter("not held_out").collect()
    assert len(got) > n / 2 and all(r.score > (r.n_tokens - 1) * math.log10(1 / 3) - math.log10(n + 2) for r in got)


def test_score_edges(spark):
    docs = spark.createDataFrame([(10, "a b"), (20, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.score(docs, F.lit(False)).collect()}
    assert got[10].n_tokens == 3 and got[10].n_known == 0 and got[10].train_tokens == 0 and got[20].n_tokens == 1
    assert lm_score.score(docs.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("n", [1, 20_000])
def test_filter_is_one_sided(n):
    rng = np.random.default_rng(1)
    grams = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    levels = rng.integers(1, 6, len(grams))
    f = lm_score.Filter.of(grams, levels, 6, 2.0)
    assert (f.levels(grams) >= levels).all() and (f.levels(grams) > levels).mean() < 0.002
    other = rng.integers(2**63, 2**64 - 1, 100_000, dtype=np.uint64)
    assert (f.levels(other) > 0).mean() < (0.002 if n > 1 else 0.2)
    assert lm_score.counted(np.array([0, 1, 3]), 2.0) == pytest.approx([0, 2**0.5, 2**2.5])


def test_full_filter_errs_upwards():
    """Even a filter too small for what it holds never loses a level."""
    rng = np.random.default_rng(2)
    grams, levels = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64)), rng.integers(1, 6, 500)
    f = lm_score.Filter(512, 6, 2.0)
    f.put(grams, levels[: len(grams)])
    assert (f.levels(grams) >= levels[: len(grams)]).all()


def parse(text, train):
    """Phrases by plain substring search, in segments of 8 symbols."""
    n = 0
    for low in range(0, len(text), 8):
        part, i = text[low : low + 8], 0
        while i < len(part):
            j = i + 1
            while j < len(part) and bytes(part[i : j + 1]) in train:
                j += 1
            n, i = n + 1, j
    return n


def test_phrases():
    samples = {"b": ["abab cab! Écab abba", "xyz"], "a": ["The hen then, there"]}
    model = langid.Model(samples, segment=8)
    assert model.languages == ["a", "b"]
    texts = ["abab", "zzz the cab", "Q then? 9 there...", "é" * 30 + " hen"]
    seen = [model.alphabet.symbols(t) for t in texts]
    trains = [bytes(np.concatenate([model.alphabet.symbols(t) for t in samples[x]])) for x in model.languages]
    got = model.phrases(seen)
    for k, s in enumerate(seen):
        assert got[k].tolist() == [parse(s.tolist(), t) for t in trains]


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("score", F.lit("clash"))
    got = queries.op10_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) > 100
    samples = langid.sample(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 .,!"), (4, "Ñandú " * 40000)], "doc_id long, text string")
    back = {r.doc_id: r.f for r in odd.select("doc_id", langid.identify(odd, samples).alias("f")).collect()}
    assert [back[i].lang for i in (1, 2, 3)] == ["und"] * 3 and back[1].score == 0 and back[4].lang == "es"
    none = odd.select(langid.identify(odd, {}).alias("f")).collect()
    assert {r.f.lang for r in none} == {"und"}
    assert langid.sample(docs.limit(0)) == {}


def test_sample_is_whole_documents(spark):
    """Bounds are on rows: chosen texts are read to their end, and a bound on characters passes over whole documents."""
    rows = [(i, ("abc " if i % 2 else "xyz ") * (i % 50 + 1), "odd" if i % 2 else "even") for i in range(400)] + [(None, "abc", "odd"), (900, "abc", None), (901, "q" * 70_000, "odd"), (7, rows_text := "abc " * 8, "odd"), (7, rows_text, "odd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = langid.sample(docs)
    assert sorted(got) == ["even", "odd"] and all(60 < len(x) <= 64 and set(x) <= {r[1] for r in rows} for x in got.values())
    some = langid.sample(docs, symbols=500)
    assert all(400 < sum(map(len, x)) <= 500 and set(x) <= {r[1] for r in rows} for x in some.values())
    assert langid.sample(docs, languages=1) == {"odd": got["odd"]}
    many = spark.createDataFrame([(i, f"w{i} " * 30, f"l{i:04}") for i in range(500)], "doc_id long, text string, lang string")
    assert len(langid.sample(many)) == 256


def test_ties_and_long_texts(spark):
    """Equal languages: the first by code point; a text beyond a segment counts as its parts do."""
    model = langid.Model({"b": ["hello there"], "a": ["hello there"]}, segment=64)
    assert model.predict(["hello", None, "7"])[0] == ["a", "und", "und"]
    text = model.alphabet.symbols("hello there and back " * 500)
    parts = [text[k : k + 64] for k in range(0, len(text), 64)]
    assert model.phrases([text]).tolist() == [model.phrases(parts).sum(0).tolist()]
