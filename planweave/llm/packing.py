"""Packing by concatenate and cut.

First pass: every task tokenises its partition and records, with each document, how many tokens stand
before it in that partition; the table is written once. Second pass: prefix sums over the partitions'
totals (one row per partition) turn those into global offsets, and every document is cut at the
multiples of the sequence length. A piece says where it lies in its document and in its sequence and
whether the document goes on over the boundary, so sequences can be rebuilt without order.

Edge cases: a null or empty text is its end token alone; repeated rows are packed each by itself; a
null id stays null; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import array
import os
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planweave.llm.common import at_work, remembered, ship, stored

_CORE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*$%&#|]*)")
_LATIN = "".join(chr(c) for c in [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)])
#: White space to str.split() that the tokenizer reads as symbols.
_ODD = re.compile("[\x1c-\x1f]")


def _le(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordIds(dict):
    """Ids of words as little-endian 32-bit bytes, each encoded when first met.

    The tokenizer splits at white space before it merges, so the ids of a text are those of its words.
    A word that is Latin letters and then punctuation is split again there, as the tokenizer does, and
    the letters are lower-cased as it does; so few words need encoding, and letters go to its merges
    directly. All of that is checked on the tokenizer itself, else texts are encoded whole. Bounded:
    when `entries` words are known, those not met since the last such time are forgotten."""

    def __init__(self, path: str, entries: int = 300_000):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok, self.entries, self.older = Tokenizer.from_file(path), entries, {}
        self.model = self.tok.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in _LATIN})
        probe = "Ab'll céD, x9;; \n\t　Zz*** don't. Straße ÀÉÎõü"
        words = [*probe.split(), *"the strasse élan ñandú überœuvre".split()]
        self.apart = self.encode(probe) == b"".join(map(self.encode, probe.split())) and self.encode("AbÉc.,") == self.encode("abéc") + self.encode(".,")
        self.direct = all(self.merge(w) == self.encode(w) for w in words if _CORE.fullmatch(w) and w.isalpha() and w == w.lower())

    def encode(self, text: str) -> bytes:
        return _le(self.tok.encode(text, add_special_tokens=False).ids)

    def merge(self, core: str) -> bytes:
        """Ids of lower-case Latin letters, by the model's merges alone."""
        return _le([t.id for t in self.model.tokenize(core if core.isascii() else core.translate(self.as_bytes))])

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            m = _CORE.fullmatch(word)
            if m and (m[2] or not word.islower()):
                out = self[m[1].lower()] + (self[m[2]] if m[2] else b"")
            else:
                out = self.merge(word) if m and self.direct else self.encode(word)
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[word] = out
        return out

    def text(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.apart or _ODD.search(text):
            return self.encode(text)
        return b"".join(map(self.__getitem__, text.split()))


_WORDS: dict[str, WordIds] = {}
remembered("tokens", _WORDS.clear)


def words_of(path: str) -> WordIds:
    """One for a worker and path, whatever the number of tasks."""
    at_work("tokens")
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """id, block (the partition), block_start (tokens before it there), n, ids (little-endian bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer_path)
        block, at, end = TaskContext.get().partitionId(), 0, _le([end_id])
        for b in batches:
            for low in range(0, b.num_rows, 512):  # a few megabytes at a time
                part = b.slice(low, 512)
                ids = [words.text(t.as_py()) + end for t in part.column(1)]
                starts = []
                for x in ids:
                    starts.append(at)
                    at += len(x) // 4
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([block] * len(ids), pa.int64()), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "block", "block_start", "n", "ids"])

    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in ("block", "block_start", "n")] + [T.StructField("ids", T.BinaryType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, out)


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: id, start, length, ids (bytes), doc_tokens, sequence_id, offset, stream_start (the
    document's global offset, unique per row of docs), continues and continued (boundary marks)."""
    ship(docs.sparkSession)
    tokens = stored(tokenise(docs, tokenizer_path, end_id, id_col, text_col), "tokens")
    totals = tokens.groupBy("block").agg(F.max(F.col("block_start") + F.col("n")).alias("total"))
    # One row of two longs per partition of the input, so its size is bounded by the number of tasks.
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(base), "block").withColumn("g", F.col("base") + F.col("block_start"))
    length, g, n = F.lit(seq_len).cast("long"), F.col("g"), F.col("n")

    def piece(s):
        low = F.greatest(s * length, g)
        high = F.least((s + 1) * length, g + n)
        start = low - g
        return F.struct(
            start.alias("start"), (high - low).alias("length"),
            F.substring(F.col("ids"), (start * 4 + 1).cast("int"), ((high - low) * 4).cast("int")).alias("piece_ids"),
            s.alias("sequence_id"), (low - s * length).alias("offset"), (start > 0).alias("continues"), (high < g + n).alias("continued"),
        )

    cut = F.transform(F.sequence(F.floor(g / length), F.floor((g + n - 1) / length)), piece)
    pieces = placed.select(F.col("id").alias(id_col), n.alias("doc_tokens"), g.alias("stream_start"), F.inline(cut))
    return pieces.withColumnRenamed("piece_ids", "ids")


def sequences(pieces: DataFrame, seq_len: int = 4096, pad_id: int = 0) -> DataFrame:
    """Rebuild the sequences: sequence_id, n_tokens (without padding), ids (bytes, padded to seq_len).
    A sequence has at most seq_len tokens, so its group is bounded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b""), lambda out, p: F.concat(out, p["ids"]))
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(seq_len) - F.col("n_tokens")).cast("int")))
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), whole.alias("ids"))
    return rows.select("sequence_id", "n_tokens", F.concat("ids", pad).alias("ids"))
