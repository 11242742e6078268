"""Line dedup, n-gram join, mixing and quality rules against brute force."""

import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from planweave.llm import line_dedup, mixing, ngram_join, quality, queries
from planweave.llm.common import row_keys, stored
from tests_llm_brute import cut, dedup_brute, fill, groups_brute, lines, shingle_set, words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
@pytest.fixture(scope="module")
def docs(spark):
    """sf0.001 with nulls, empty and repeated rows, shared passages and near copies."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(400)}" for _ in range(300))
    passage = " ".join(f"Line {k} of a passage that many documents share here." for k in range(9))
    extra = []
    for k in range(60):  # near copies, by one to fifteen words
        w = base.split()
        for i in rng.sample(range(300), k % 15 + 1):
            w[i] = f"x{k}_{i}"
        extra.append(" ".join(w))
    extra += [f"Own words {k} go before. {passage} And {k} after it.\nThe end {k}." for k in range(12)]
    extra += [None, "", " \n\t", "a", "a", "one two three", "one two three", "One TWO three", "x\x01y. z\x01\n", "...", rows[0][1]]
    out = rows + [(10_000 + i, t, None, None if i % 3 else "hot", None) for i, t in enumerate(extra)]
    return out + [(None, "no id at all " * 20, "en", "hot", 1), rows[3], rows[3]]


def frame(spark, docs):
    clash = {c: F.lit("clash") for c in ("n", "fp", "target", "rate", "h", "u", "id", "row_key", "words", "lines")}
    return spark.createDataFrame(docs, DOCS).repartition(3).withColumns(clash)


def test_line_dedup(spark, docs):
    want = dedup_brute(docs)
    got = line_dedup.dedup(frame(spark, docs))
    cleaned = got.select("doc_id", "text", "h").collect()
    assert Counter((r.doc_id, r.text) for r in cleaned) == Counter((d[0], want[d[0], d[1]]) for d in docs) and cleaned[0].h == "clash"
    shared = [want[d[0], d[1]] for d in docs if d[1] and "passage that many" in d[1]]
    assert sum(t.count("passage that many") for t in shared) == 9  # only where it stands first
    assert line_dedup.dedup(frame(spark, docs).limit(0)).count() == 0


@pytest.mark.parametrize("bound", [0, 10_000])
def test_line_dedup_joins(spark, docs, bound):
    """The same by shuffle joins alone, and with a text of 300,000 lines, ties in every line and repeated documents."""
    rng = random.Random(8)
    long = "".join(f"{rng.randrange(200)} {rng.choice(['on', 'off'])}{rng.choice(['. ', ', ', chr(10)])}" for _ in range(300_000))
    rows = [*docs, (20_000, long, "en", "hot", 1), (20_001, "again, " * 300, "en", "hot", 1), (20_002, "again, " * 300, "en", "hot", 1), *[(20_003, " ".join(long.split()[:400]), "en", "hot", 1)] * 9]
    want = dedup_brute(rows)
    got = line_dedup.dedup(frame(spark, rows), broadcast_rows=bound).select("doc_id", "text").collect()
    assert Counter(map(tuple, got)) == Counter((d[0], want[d[0], d[1]]) for d in rows)


def test_line_dedup_cut(spark):
    """Lines are found as by the rule in any text, at any length without recursion; chunks of a single line, which are half
    of all, are neither hashed nor kept."""
    rng = random.Random(11)
    texts = [None, "", " ", ". ", "a.  ", "1," * 300_000, "a b " * 200_000, ". " * 50_000, *("".join(rng.choices("ab .!,;:\n\x01\r\té😀  ", k=rng.randrange(16))) for _ in range(20_000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = df.select("doc_id", line_dedup.lines(F.col("text")).alias("whole"), line_dedup.bare_lines(F.col("text")).alias("bare")).collect()
    made = {r.id: r.spans for r in line_dedup.cut(df, "doc_id", "text").collect()}
    for r in got:
        t = texts[r.doc_id]
        b, chunks = cut(t)
        assert (r.whole, r.bare) == ((None, None) if t is None else (lines(t), b))
        assert [(s.start, s.start + s.size) for s in made[r.doc_id] or []] == chunks


def test_stored_without_dictionary(spark):
    """Columns named as unlike get no dictionary, and the others keep theirs."""
    df = spark.range(100).selectExpr("id", "array(named_struct('h', id, 'n', 1)) as s")
    got = stored(df.coalesce(1), "plain", unlike=("id", "s.list.element.h"))
    (file,) = Path(got._planweave_path.removeprefix("file:")).glob("*.parquet")
    group = pq.ParquetFile(file).metadata.row_group(0)
    tried = {c.path_in_schema: c.has_dictionary_page for c in (group.column(i) for i in range(group.num_columns))}
    assert tried == {"id": False, "s.list.element.h": False, "s.list.element.n": True} and got.count() == 100


def test_line_dedup_finds_passages(spark):
    """Passages of 51 to 150 words put anywhere into two texts lose most of the second copy; clean texts stay."""
    rng = random.Random(4)
    sentence = lambda: ", ".join(" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(9999)}" for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(1, 4))).capitalize() + "."
    texts, passages = [" ".join(sentence() for _ in range(20)) for _ in range(600)], []
    for k in range(200):
        p = ""
        while len(p.split()) < 51 + k // 2:
            p = f"{p} {sentence()}".strip()
        passages.append(p)
        for i in (2 * k, 2 * k + 1):
            w = texts[i].split()
            at = rng.randrange(1, len(w))
            texts[i] = " ".join([*w[:at], p, *w[at:]])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup(df).collect()}
    left = [len(got[2 * k + 1].split()) - (len(texts[2 * k + 1].split()) - len(p.split())) for k, p in enumerate(passages)]
    removed = [1 - x / len(p.split()) for x, p in zip(left, passages, strict=True)]
    assert sum(removed) / 200 > 0.8 and sum(x > 0.5 for x in removed) > 170
    assert all(got[i] == texts[i] for i in range(600) if i >= 400 or i % 2 == 0)


def test_line_dedup_keeps_unequal_bytes(spark, docs, monkeypatch):
    """With one hash for all chunks nothing may be removed; with one for some, the others still are."""
    real = line_dedup.cut
    same = lambda s, h: s.withField("h", h(s))
    monkeypatch.setattr(line_dedup, "cut", lambda *a: real(*a).withColumn("spans", F.transform("spans", lambda s: same(s, lambda _: F.lit(7).cast("long")))))
    got = line_dedup.dedup(frame(spark, docs)).select("doc_id", "text").collect()
    assert Counter(map(tuple, got)) == Counter((d[0], d[1]) for d in docs)
    monkeypatch.setattr(line_dedup, "cut", lambda *a: real(*a).withColumn("spans", F.transform("spans", lambda s: same(s, lambda x: F.when(x["h"] % 5 == 0, 5).otherwise(x["h"])))))
    some = line_dedup.dedup(frame(spark, docs)).select("doc_id", "text").collect()
    want, whole = dedup_brute(docs), Counter((d[0], d[1]) for d in docs)
    assert sum(i not in whole for i in map(tuple, some)) > 5
    assert sum(len(t or "") for _, t in some) > sum(len(want[d[0], d[1]] or "") for d in docs)


@pytest.mark.parametrize("block", [4096, 5])
def test_ngram_join(spark, docs, block):
    want, size = groups_brute(docs)
    got = ngram_join.near_duplicates(frame(spark, docs), block=block).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter((d[0], size[d[0], d[1]], want[d[0], d[1]]) for d in docs)
    assert len({want[d[0], d[1]] for d in docs}) < len(docs) - 40


@pytest.mark.parametrize("block", [4096, 5])
def test_ngram_join_counts_links(spark, docs, block):
    """Each row's links with all other rows, those inside the largest component too."""
    sets = [shingle_set(d[1]) for d in docs]
    want = Counter()
    for a, d in enumerate(docs):
        n = 0
        for b, other in enumerate(sets):
            i = len(sets[a] & other)
            n += a != b and i > 0 and 100 * i >= 80 * (len(sets[a]) + len(other) - i)
        want[d[0], d[1], n] += 1
    by_key = frame(spark, docs).select("doc_id", "text", F.struct(*row_keys("doc_id", "text")).alias("row_key")).distinct()
    found = ngram_join.near_duplicates(frame(spark, docs), block=block, count_links=True).select("row_key", "n_links")
    got = by_key.join(found, "row_key").select("doc_id", "text", "n_links").collect()
    assert Counter(map(tuple, got)) == want and max(n for _, _, n in want) > 20


def test_rows_from_the_band_above_do_not_meet(spark):
    """A cell of one size goes to the groups of its own band only, and every pair of a cell of two sizes meets once."""
    for sizes, bands in (([100], 1), ([100, 120], 2)):
        rows = [(f"{k}".encode(), sizes[k % len(sizes)], 0, 7) for k in range(24)]
        posted = spark.createDataFrame(rows, "fp binary, n long, place int, cell long")
        got = ngram_join.dealt(posted, 80, 4, None, 1000).collect()
        assert len({r.band for r in got}) == bands
        groups = defaultdict(list)
        for r in got:
            groups[r.band, r.low, r.high].append(r)
        met = Counter(frozenset((bytes(a.fp), bytes(b.fp))) for g in groups.values() for i, a in enumerate(g) for b in g[:i] if ngram_join._fits(a.side, b.side))
        assert len(met) == 24 * 23 // 2 and set(met.values()) == {1}
        assert not any(all(r.side & 4 for r in g) for g in groups.values())


def test_ngram_join_empty(spark, docs):
    assert ngram_join.near_duplicates(frame(spark, docs).limit(0)).count() == 0


@pytest.mark.parametrize("exact", [{}, {"route": None, "sketch": None}])
def test_ngram_join_of_long_texts(spark, exact):
    """Texts of thousands of words, linked at the very threshold or just not, in cells cut by sizes and blocks."""
    rng = random.Random(11)
    rows = []
    for n in (400, 700, 1300, 300 if exact else 20_000):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for k in range(9):  # 5 shingles go with each word that is changed
            w = list(base)
            for i in range(0, round(n * (0.01 + 0.002 * k)) * 25, 25):
                w[i % n] = f"x{k}_{i}"
            rows.append(" ".join(w))
        rows += [" ".join(base[: n * 8 // 10 + d]) for d in (0, 1, 5, 40)]
    rows = [(i, t, None, None, None) for i, t in enumerate(rows)]
    want, size = groups_brute(rows)
    bounds = {"block": 6, "block_shingles": 8000} if exact else {"block": 5}
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3), count_links=True, **bounds, **exact).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d[0]: (size[d[0], d[1]], want[d[0], d[1]]) for d in rows}
    sets = [shingle_set(t) for _, t, *_ in rows]
    for r in got:
        i = [len(sets[r.doc_id] & s) for s in sets]
        assert r.n_links == sum(100 * x >= 80 * (len(sets[r.doc_id]) + len(s) - x) for x, s in zip(i, sets, strict=True)) - 1


def test_candidates_with_equal_low_bits():
    """Hashes that differ above their low 32 bits only are different."""
    core = np.arange(1, 61, dtype=np.uint64) << np.uint64(40)
    a = np.sort(np.append(core, np.uint64(5)))
    b = np.sort(np.append(core, np.uint64(5) + (np.uint64(1) << np.uint64(35))))
    place = np.array([1, 1])  # the cell of the first common shingle
    has = ngram_join.candidates([a, b], place, np.array([61, 61]), np.array([2, 2]), 80, 64)
    assert has.tolist() == [True, True]


def test_components(spark):
    from planweave.llm.components import components

    rng = random.Random(3)
    links = [(k, k + 1) for k in range(1, 600)] + [(1000, k) for k in range(1001, 1100)] + [(k, k) for k in range(5)] + [(2001, 2000), (2000, 2001), (2000, 2001), (None, 7), (7, None)]
    rng.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**dict.fromkeys(range(1, 601), 1), **dict.fromkeys(range(1000, 1100), 1000), 2000: 2000, 2001: 2000}
    assert components(df.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        components(df, most=2)


def test_search_is_exact():
    """Merge, probe and matrix paths of a large cell against plain intersections."""
    rng = np.random.default_rng(3)
    core = rng.choice(2**40, 60, replace=False)
    sets = []
    for k in range(150):
        own = rng.choice(2**40, 15)
        keep = rng.random(60) < (0.97 if k % 3 else 0.3)
        sets.append(np.unique(np.concatenate((core[keep], own[: k % 9]))).astype(np.uint64))
    n = np.array([len(s) for s in sets])
    hit = ngram_join._Lists(sets).search(np.arange(150), ngram_join._tops(n, 80))
    for a in range(150):
        for b in range(150):
            i = len(np.intersect1d(sets[a], sets[b]))
            assert hit[a, b] == (a != b and 100 * i >= 80 * (n[a] + n[b] - i))
    joined = ngram_join.links(sets, n, 80)
    assert len(joined) < 150 and all(hit[a, b] for a, b in joined)


def dual(sizes, target, limit=2.0):
    """The multiplier of a source, by bisection over its documents."""
    words = lambda lam: sum(n * min(limit, math.exp(min(lam * n, 9))) for n in sizes)
    low, high = -1.0, math.log(limit)
    while words(low) > target:
        low *= 2
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if words(mid) < target else (low, mid)
    return low


@pytest.mark.parametrize("bound", [0, 200_000])
def test_mix(spark, docs, bound):
    rows = mixing.mix(frame(spark, docs), broadcast_rows=bound).collect()
    again = mixing.mix(frame(spark, docs).repartition(5)).collect()
    assert Counter((r.doc_id, r.text, r._mix_copies) for r in rows) == Counter((r.doc_id, r.text, r._mix_copies) for r in again)
    sizes, taken, every = Counter(), Counter(), {}
    for r in rows:
        assert r._mix_size == len(words(r.text)) and 0 <= r._mix_copies <= 2 and r.target == "clash"
        sizes[r.source] += r._mix_size
        taken[r.source] += r._mix_size * r._mix_copies
        every.setdefault(r.source, []).append(r._mix_size)
    want = fill(sizes, (5, 2, 1), 1.5)
    lam = {s: dual(every[s], t) for s, t in want.items()}
    for r in rows:
        assert r._mix_source_size == sizes[r.source] and r._mix_target == pytest.approx(want[r.source])
        assert r._mix_rate == pytest.approx(min(2.0, math.exp(min(9, lam[r.source] * r._mix_size))), rel=1e-4)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(30, 0.03 * want[s]), (s, taken[s], want[s])
    assert len({round(r._mix_rate, 6) for r in rows}) > 20
    mixed = mixing.repeated(mixing.mix(frame(spark, docs)), ["doc_id", "text"]).count()
    assert mixed == sum(r._mix_copies for r in rows)


def test_mix_splits_rows_alike(spark):
    """A third of all rows one row, and ties of size everywhere: the words taken still meet the target."""
    rows = [(7, "one two three four", "hot")] * 1000 + [(100 + i, "w " * (3 + i % 3), "hot" if i % 2 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df.repartition(6)).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r._mix_size * r._mix_copies
        target[r.source] = r._mix_target
    assert len(got) == len(rows) and all(abs(taken[s] - t) <= 1.5 for s, t in target.items())
    again = mixing.mix(df.repartition(3)).collect()
    assert Counter((r.doc_id, r.text, r.source, r._mix_copies) for r in got) == Counter((r.doc_id, r.text, r.source, r._mix_copies) for r in again)
    assert len({r._mix_copies for r in got if r.doc_id == 7}) == 2


def test_mix_edges(spark):
    one = spark.createDataFrame([(1, None, "s"), (2, "", None), (3, "a b c", "t")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(one).collect()}
    assert got[1]._mix_size == 0 and got[1]._mix_target == 0 and got[3]._mix_target == pytest.approx(4.5) and got[3]._mix_copies in (1, 2)
    assert mixing.mix(one.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "a " * 400_000, "s"), (2, "b " * 100, "s"), (3, "c " * 100, "t")], "doc_id long, text string, source string")
    assert {r.doc_id: r._mix_size for r in mixing.mix(long).collect()} == {1: 400_000, 2: 100, 3: 100}


def test_mix_targets(spark):
    """Water-filling over many sources, ranked by ranges, and an error instead of an unfinished dual."""
    rng = random.Random(9)
    sizes = {f"s{k:03}" + "é" * (k % 3): rng.choice([0, 1, 5, 50, 5000]) for k in range(300)} | {None: 40}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(7)
    for budget in (0.1, 1.5, 2.0):
        got = {r.source: r.target for r in mixing.targets(df, (5, 2, 1), budget, 2.0).collect()}
        want = fill(sizes, (5, 2, 1), budget) if budget < 2 else {s: 2.0 * n for s, n in sizes.items()}
        assert got == pytest.approx(want)
    histogram = spark.createDataFrame([("a", 10, 5), ("a", 90, 5)], "source string, _size long, docs long")
    wanted = spark.createDataFrame([("a", 500, 300.0)], "source string, source_size long, target double")
    with pytest.raises(RuntimeError):
        mixing.multipliers(histogram, wanted, 2.0, most=1)


def test_quality(spark, docs):
    con = duckdb.connect()
    frame(spark, docs).select("doc_id", "text").toPandas().pipe(lambda p: con.register("documents", p))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_bullet_lines", "n_ellipsis_lines", "failures"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.OP6_SQL})").fetchall()
    book = quality.ledger(frame(spark, docs)).cache()
    got = [tuple(r) for r in book.select(*cols).collect()]
    clean = lambda rows: Counter(tuple(None if x != x else x for x in r) for r in rows)
    assert clean(got) == clean(want)
    bits = [r[-1] for r in got]
    rows = {r.rule: r for r in quality.ablate(book, quality.STANDARD).collect()}
    for name, bit in quality.BITS.items():
        r = rows[name]
        assert (r.failed, r.failed_alone, r.kept_without, r.kept) == (sum(b & bit > 0 for b in bits), bits.count(bit), sum(b & ~bit == 0 for b in bits), bits.count(0))
    assert quality.apply(book, quality.STANDARD).filter("kept").count() == bits.count(0)
    assert quality.ledger(frame(spark, docs).limit(0)).count() == 0


def test_repeat_words_of_huge_texts(spark, monkeypatch):
    """The path for more windows than the packed index holds gives the same."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcd") for _ in range(n)) for n in (0, 2, 3, 9, 40, 200)] + ["x y z " * 9]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    usual = {r.doc_id: r.n_repeat_words for r in quality.measure(df).collect()}
    monkeypatch.setattr(quality, "INDEX_BITS", 1)
    assert {r.doc_id: r.n_repeat_words for r in quality.measure(df).collect()} == usual
    for i, t in enumerate(texts):
        w = t.split()
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        assert usual[i] == len({k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)})


def test_repeat_words_compares_words(spark):
    """Windows whose hashes are equal by chance are different, in short and in long texts."""
    words = "a b c d a b c x y z".split()
    hashes = [5, 9, 9, 9, 5, 7, 9, 9]  # of its windows; only a b c occurs twice
    df = spark.createDataFrame([(n, words, [h << 40 for h in hashes]) for n in (7, 5000)], "n long, words array<string>, hashes array<long>")
    got = df.select(quality.repeat_words(F.col("words"), F.col("n"), F.col("hashes")).alias("r")).collect()
    assert [r.r for r in got] == [6, 6]


def test_quality_of_a_very_long_text(spark):
    """3,000,000 words of which two windows are equal."""
    words = [f"w{i}" for i in range(3_000_000)]
    words[2_000_000:2_000_003] = words[5:8]
    got = quality.measure(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert (got.n_words, got.n_repeat_words, got.n_lines) == (3_000_000, 6, 1)
