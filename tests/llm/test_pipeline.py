"""The pipeline, stage by stage, against brute force."""

import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark import TaskContext, cloudpickle
from pyspark.sql import functions as F

import corpus_pipeline as cp
from planweave.llm import langid, packing
from tests_llm_brute import dedup_brute, fill, groups_brute, words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rng = random.Random(2)
    w = [rng.choice("the thing and other than shor on of in was".split()) + rng.choice("abcde") for _ in range(200)]
    extra = [(5000 + k, " ".join([*w[:k], "changed", *w[k:]]), "en", None, 7) for k in range(5)]
    odd = [(6000, None, "en", "src1", None), (6001, "", None, None, 0), (6002, "12 34 !!", "en", "src1", 8), (None, rows[5][1], None, "src2", None), rows[7], rows[7]]
    return spark.createDataFrame(rows + extra + odd, DOCS).repartition(3)


def collected(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stages(spark, docs):
    rows = collected(docs)
    model = langid.Model(langid.sample(docs))
    lang, score, _ = model.predict([r[1] for r in rows])
    after = cp.stage_language(spark, docs, SF).persist()
    got = collected(after)
    assert Counter(got) == Counter(r for r, p, x in zip(rows, lang, score, strict=True) if p != "und" and x >= cp.LEAST_SCORE) and len(got) >= len(rows) - 8

    own = set()
    rows, want = got, dedup_brute(got, own=own)
    scraps = lambda d: d not in own and len(words(want[d])) < cp.LEAST_LEFT * len(words(d[1]))
    after = cp.stage_lines(spark, after, SF).persist()
    got = collected(after)
    clean = [(r[0], want[r[0], r[1]], *r[2:4], r[4] if want[r[0], r[1]] == r[1] else len(want[r[0], r[1]])) for r in rows if want[r[0], r[1]] == r[1] or words(want[r[0], r[1]]) and not scraps(r[:2])]
    assert Counter(got) == Counter(clean)

    rows = got
    groups, _ = groups_brute(rows)
    after = cp.stage_near_duplicates(spark, after, SF).persist()
    got = collected(after)
    texts = defaultdict(set)
    for r in rows:
        texts[groups[r[0], r[1]]].add(r[:2])
    assert Counter(groups[r[0], r[1]] for r in got) == Counter({g: 1 for g in texts}) and all(r[0] == groups[r[0], r[1]] and r in rows for r in got)

    rows = got
    got = collected(cp.stage_mix(spark, after, SF))
    copies, sizes, taken, largest = Counter(got), Counter(), Counter(), Counter()
    for r in rows:
        largest[r[3]] = max(largest[r[3]], len(words(r[1])))
        sizes[r[3]] += len(words(r[1]))
        taken[r[3]] += len(words(r[1])) * copies[r]
    assert set(got) <= set(rows) and max(copies.values()) <= 2
    for s, t in fill(sizes, (5, 2, 1), 1.5).items():
        assert abs(taken[s] - t) <= max(0.03 * t, largest[s] / 2)  # a source of ten documents cannot come nearer for sure

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    mixed = spark.createDataFrame(got, DOCS)
    pieces = cp.stage_pack(spark, mixed, SF).collect()
    want_ids = sum(len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in got)
    assert sum(p.length for p in pieces) == want_ids and max(p.offset + p.length for p in pieces) <= 4096
    assert sorted(p.sequence_id * 4096 + p.offset for p in pieces) == sorted(p.stream_start + p.start for p in pieces)


def test_run(spark, tmp_path):
    """All of run() on whole tables gives what the stages give one after the other."""
    source = spark.read.parquet(f"{SF}/documents.parquet")
    source.write.parquet(str(tmp_path / "documents.parquet"))
    got = cp.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()
    docs = source
    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(collected(stage(spark, docs, SF)), DOCS)
    want = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in want} and sum(r.length for r in got) == sum(r.length for r in want)


def test_rows_alike_but_for_other_columns(spark):
    """Of rows alike in id and text one stays, the same whatever the partitions; with nulls in every column too."""
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, text, lang, source, n) for lang, source, n in (("en", "b", 3), ("en", "a", None), (None, None, 7), ("de", "b", 1))] + [(None, None, None, None, None)] * 3 + [(2, text + " more", "en", "a", 2), (3, "", None, None, 0), (3, "", None, None, 0)]
    kept = [Counter(collected(cp.stage_near_duplicates(spark, spark.createDataFrame(rows, DOCS).repartition(n), SF))) for n in (1, 4)]
    assert kept[0] == kept[1] and set(kept[0].values()) == {1} and sorted(r[0] or 0 for r in kept[0]) == [0, 1, 3]


def test_empty(spark, docs):
    none = docs.limit(0)
    for name, stage in cp.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0 and (name == "pack" or out.columns == none.columns)


def test_extra_columns(spark, docs):
    clash = docs.withColumns({c: F.lit("clash") for c in ("n", "fp", "target", "rate", "h", "id", "row_key", "size", "score", "block")})
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, clash, SF).columns == clash.columns, name


def test_workers_remember_one_stage(docs, monkeypatch):
    """All tasks of a worker share one table of word ids; what it remembers of another stage is forgotten."""
    sent, built = [], []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: sent.append(cloudpickle.dumps(f)) or self)
    monkeypatch.setattr(TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    init = packing.WordIds.__init__
    monkeypatch.setattr(packing.WordIds, "__init__", lambda self, *a: built.append(a) or init(self, *a))
    packing.tokenise(docs, public_tokenizers.path("word_bpe_49k.json"), 2, "doc_id", "text")
    langid._model('{"samples": {"en": ["the thing"], "xx": ["jeg er"]}}')
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "text": ["some words", None]})
    tasks = [[b.to_pydict() for b in cloudpickle.loads(sent[0])([batch])] for _ in range(3)]
    assert len(built) == 1 and tasks[0] == tasks[1] == tasks[2] and tasks[0][0]["n"][1] == 1
    assert packing._WORDS and not langid._MODELS
    langid._model('{"samples": {}}')
    assert langid._MODELS and not packing._WORDS
