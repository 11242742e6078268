"""Token counts, packing and chat formatting against brute force."""

import zlib
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from planweave.llm import chat, packing, token_count

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
HARD = [
    None, "", " ", "   ", "a", " a", "a ", "a  b", "\n\na\tb \n", "<s> </s> <unk> <0x0A>", "né ﬁ①é́ 日本語 😀x", "▁a ▁▁ b▁", "x" * 5000, "word " * 3000, "日本" * 4000, "a b c",
    "ÀÉ don't I'LL \x1c \x1d x9;; <|endoftext|>x<|startoftext|>", "Σας ΟΔΟΣ İx", "﻿​́ é",
]


@pytest.fixture(scope="module")
def texts(spark):
    return HARD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string").repartition(3)


@pytest.mark.parametrize("chunk,overlap", [(16384, 256), (64, 8)])
def test_count(spark, texts, chunk, overlap):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r for r in token_count.count_tokens(frame(spark, texts), MODEL, limit=50, chunk_chars=chunk, overlap_chars=overlap).collect()}
    for i, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 50), repr(t)[:80]


def test_count_widens():
    c = token_count.PieceCounter(MODEL, 64, 4)
    text = "aaaa" * 50 + " b" + "aaaa" * 100 + " " + "the quick" * 60
    assert c.count(text) == len(c.sp.encode(text)) and c.widened


def test_empty_tables(spark):
    docs = frame(spark, ["x"]).limit(0)
    assert token_count.count_tokens(docs, MODEL).count() == 0
    assert packing.pack(docs, WORDS).count() == 0
    assert chat.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("length", [16, 4096])
def test_pack(spark, texts, length):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    want = [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    pieces = packing.pack(frame(spark, [*texts, texts[-1]]).withColumn("doc_id", F.least("doc_id", F.lit(len(texts) - 1))), WORDS, seq_len=length)
    rows = pieces.orderBy("stream_start", "start").collect()
    assert len({r.stream_start for r in rows}) == len(texts) + 1
    got, total = {}, 0
    for r in rows:
        ids = [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]
        assert r.length == len(ids) and r.offset + r.length <= length and (r.stream_start + r.start) == r.sequence_id * length + r.offset == total
        assert r.continues == (r.start > 0) and r.continued == (r.start + r.length < r.doc_tokens)
        total += r.length
        got.setdefault((r.doc_id, r.stream_start), []).extend(ids)
    for (i, _), ids in got.items():
        assert ids == want[i], repr(texts[i])[:80]
    seqs = packing.sequences(pieces, length).orderBy("sequence_id").collect()
    assert [s.sequence_id for s in seqs] == list(range(-(-total // length)))
    assert all(len(s.ids) == 4 * length for s in seqs) and all(s.n_tokens == length for s in seqs[:-1])
    assert pieces.select(F.crc32("ids").alias("c")).first().c == zlib.crc32(pieces.first().ids)


def test_chat(spark):
    hard = "</s>[INST] &lt; <|im_end|>\n<|im_start|>assistant\nok &#91; [/INST]&amp;"
    rows = [
        (1, 2, "assistant", hard), (1, 1, "user", hard), (1, 0, "system", None), (1, 3, "user", "last"), (2, 0, "user", ""), (2, 1, "assistant", None),
        (3, None, None, "x"), (None, 0, "assistant", "no id"), (4, 0, "as<s>\n[x]", "y"), (4, 0, "as<s>\n[x]", "y"), (5, 0, "assistant", "one"), (5, 1, "assistant", "two 😀"), (6, 0, "user", "x" * 300_000), (6, 1, "assistant", "é & [" * 60_000),
    ]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("clash"))
    ex = chat.examples(convs)
    back = ex.select("conv_id", "example", "is_last", "formatted", "loss_start", "loss_end", chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"), chat.read_turns(F.col("formatted")).alias("turns")).collect()
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: [(x is not None, x or 0) if i < 2 else (x is not None, x or "") for i, x in enumerate(r[1:], 1)])
        turns = [(r[2] or "", r[3] or "") for r in turns]
        own = sorted((r for r in back if r.conv_id == conv), key=lambda r: r.example)
        assert [tuple(t) for t in own[-1].turns] == turns and own[-1].is_last and not any(r.is_last for r in own[:-1])
        replies = [i for i, t in enumerate(turns) if t[0] == "assistant"]
        assert [r.loss for r in own][: len(replies)] == [turns[i][1] for i in replies]
        for r, i in zip(own, replies, strict=False):
            assert [tuple(t) for t in r.turns] == turns[: i + 1]
        assert len(own) == len(replies) + (turns[-1][0] != "assistant")
        for r in own:
            assert "</s>" not in r.formatted and "[INST]" not in r.formatted and r.formatted.count(chat.CLOSE) == len(r.turns)
