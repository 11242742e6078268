"""Language-model scores from a log-frequency Bloom filter of bigram counts.

Counts of bigrams are quantised on a logarithmic scale: a bigram of level q is put into a Bloom filter q
times, as (bigram, 1) to (bigram, q). A reader probes (bigram, 1), (bigram, 2), ... until a probe fails, and so
learns the level; the error is one-sided and falls geometrically. Probabilities are smoothed towards the
unigrams, whose counts are exact: P(w | h) = (count(h w) + mu * P1(w)) / (count(h) + mu).

Flow. A first pass turns the texts into blocks of about `block_tokens` tokens: a list of the block's distinct words as
hashes and every token as a place in that list; blocks are written once. Each block counts its words
and bigrams and deals both out by ranges of their hashes. A range merges the counts of all blocks. For words it
sends the corpus counts back to each block that asked. For bigrams it builds its segment of the filter and
probes it with the bigrams of every block, training or not, and sends the levels back. A block with its
answers scores its texts.

The filter grows with the corpus, so it is never in one place: a segment has as many bits as its own
levels need to fill a quarter of it (20.9 a level at 6 probes; a bigram that is not there passes with
probability 1 / 4096) and lives in the task of its range, and the probes come to it. Every bigram seen `min_count` times
or more is stored (1, the default: all), so a text's score does not depend on the room that others leave. Bigrams are
known by their range and 32 more bits; since a range holds about `range_entries` at any size, two share these
with a probability below that of a false probe.

Bounds. A worker holds a block, or a range of about `range_entries` counts. A hot word or bigram is one entry a block, so
beyond `spread` blocks there is a step between: blocks are dealt into groups of about `spread`, a group of neighbouring ranges
and of blocks merges its counts and asks as one block would, and hands the answers on. Then a hot one is an entry a group.
The driver gets a few numbers. A text longer than a block is a block of its own.

Words are runs of anything but ASCII white space, in ASCII lower case, by 64-bit hash; a text's tokens
are its words and one end, which is also the history of its first word. Edge cases: a null or empty
text is its end alone; repeated rows count and are scored each; a null id stays null; other columns are
ignored; without training text every count is 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planweave.llm.common import ship, stored
from planweave.llm.words import WordHashes

#: No word holds a line feed, so this is no word's hash.
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_HASHES = WordHashes(100_000)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _A
        x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _grams(history: np.ndarray, word: np.ndarray, bits: int) -> np.ndarray:
    """Keys of bigrams: the range in the upper 32 bits (of which `bits` are used), 32 more bits below."""
    with np.errstate(over="ignore"):
        return _mix(_mix(history) + word * _B) >> np.uint64(32 - bits)


def level(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(base) + 1e-9).astype(np.int64)


class Filter:
    """A segment of the filter."""

    def __init__(self, bits: int, probes: int, base: float):
        self.bits, self.probes, self.base = bits, probes, base
        self.data = np.zeros(-(-bits // 8), np.uint8)

    @classmethod
    def of(cls, grams: np.ndarray, levels: np.ndarray, probes: int, base: float) -> Filter:
        """With bits enough to be a quarter full."""
        out = cls(max(8, math.ceil(int(levels.sum()) * probes / math.log(4 / 3))), probes, base)
        out.put(grams, levels)
        return out

    def _places(self, grams: np.ndarray, lev: int, probe: int) -> np.ndarray:
        step = np.uint64((lev * self.probes + probe + 1) & 0xFFFFFFFF)
        with np.errstate(over="ignore"):
            return (_mix(grams + step * _A) % np.uint64(self.bits)).astype(np.int64)

    def put(self, grams: np.ndarray, levels: np.ndarray) -> None:
        held = np.unpackbits(self.data, bitorder="little", count=self.bits).astype(bool)
        lev = 1
        while len(grams):
            for j in range(self.probes):
                held[self._places(grams, lev, j)] = True
            lev += 1
            more = levels >= lev
            grams, levels = grams[more], levels[more]
        self.data = np.packbits(held, bitorder="little")

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """Levels by repeated probes; 0 if not even the first is there."""
        out = np.zeros(len(grams), np.uint8)
        alive, lev = np.arange(len(grams)), 1
        while len(alive) and lev < 200:
            for j in range(self.probes):
                at = self._places(grams[alive], lev, j)
                alive = alive[(self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
                if not len(alive):
                    break
            out[alive] = lev
            lev += 1
        return out


def counted(levels: np.ndarray, base: float) -> np.ndarray:
    """The counts that levels stand for."""
    return np.where(levels > 0, base ** (levels.astype(np.float64) - 0.5), 0.0)


def _pack(places: np.ndarray) -> bytes:
    """Token places, byte plane by byte plane, compressed."""
    planes = places.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def blocks_of(docs: DataFrame, train: Column, id_col: str, text_col: str, block_tokens: int) -> DataFrame:
    """block, n (tokens), ids, train (a byte each), sizes (tokens, int32 each), words (sorted hashes), tokens (places in words)."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        ids, flags, sizes, held, total = [], [], [], [], 0

        def row() -> pa.RecordBatch:
            nonlocal serial, ids, flags, sizes, held, total
            flat, held = np.concatenate(held), []
            words, tokens = np.unique(flat, return_inverse=True)
            del flat
            values = (bytes(flags), np.array(sizes, np.int32).tobytes(), words.tobytes(), _pack(tokens))
            out = [pa.array([(part << 32) | serial], pa.int64()), pa.array([total], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(flags)], pa.int32()), pa.concat_arrays(ids)), *(pa.array([x], pa.binary()) for x in values)]
            serial, ids, flags, sizes, total = serial + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays(out, ["block", "n", "ids", "train", "sizes", "words", "tokens"])

        for b in batches:
            texts, fits = b.column(1).cast(pa.binary()), b.column(2).to_pylist()
            for i in range(b.num_rows):
                words = (texts[i].as_py() or b"").lower().split()
                n = len(words)
                h = np.empty(n + 1, np.uint64)
                h[:n] = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
                h[n] = END
                ids.append(b.column(0).slice(i, 1)), flags.append(bool(fits[i])), sizes.append(n + 1), held.append(h)
                total += n + 1
                if total >= block_tokens:
                    yield row()
        if held:
            yield row()

    out = T.StructType([T.StructField("block", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(kind))] + [T.StructField(c, T.BinaryType()) for c in ("train", "sizes", "words", "tokens")])
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(train, F.lit(False)).alias("train")).mapInArrow(run, out)


class _Block:
    def __init__(self, train: bytes, sizes: bytes, words: bytes, tokens: bytes):
        self.train, self.sizes = np.frombuffer(train, bool), np.frombuffer(sizes, np.int32).astype(np.int64)
        self.words, self.tokens = np.frombuffer(words, np.uint64), _unpack(tokens)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))

    def pairs(self) -> np.ndarray:
        """Every token as history * number of words + word."""
        history = np.empty_like(self.tokens)
        history[1:] = self.tokens[:-1]
        history[self.starts] = int(np.searchsorted(self.words, END))
        return history * len(self.words) + self.tokens

    def trained(self) -> np.ndarray:
        return np.repeat(self.train, self.sizes)

    def keys(self, pairs: np.ndarray, bits: int) -> np.ndarray:
        return _grams(self.words[pairs // len(self.words)], self.words[pairs % len(self.words)], bits)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, _Block]]:
    for i in range(batch.num_rows):
        yield i, _Block(*(batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("train", "sizes", "words", "tokens")))


def _runs(parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of every part that occurs in a sorted array."""
    if len(parts):
        at = np.concatenate(([0], np.flatnonzero(parts[1:] != parts[:-1]) + 1, [len(parts)]))
        yield from zip(parts[at[:-1]].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)


def _merge(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(first) else c


def _joined(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


_SENT = "part long, block long, hashes binary, counts binary"
_BACK = "block long, kind int, part long, data binary, tokens long, types long"


def _sent(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["part", "block", "hashes", "counts"])


class _Hashes:
    """How the hashes of a range are sent: words whole, bigrams without the bits that the range tells."""

    def __init__(self, kind: int, bits: int):
        self.kind, self.bits = kind, bits

    def whole(self, part: int, sent: bytes) -> np.ndarray:
        if self.kind == 1:
            return np.frombuffer(sent, "<u8")
        return np.frombuffer(sent, "<u4").astype(np.uint64) | (np.uint64(part) << np.uint64(32))

    def parts(self, keys: np.ndarray) -> np.ndarray:
        if self.kind == 1:
            return (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        return (keys >> np.uint64(32)).astype(np.int64)

    def sent(self, keys: np.ndarray) -> bytes:
        return keys.tobytes() if self.kind == 1 else (keys & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes()


def _counts(pdf: pd.DataFrame, how: _Hashes) -> np.ndarray:
    """Of a block 32 bits each, of a group of blocks 64."""
    wide = sum(map(len, pdf["counts"])) > sum(map(len, pdf["hashes"])) // (8 if how.kind == 1 else 4) * 4
    return _joined(pdf["counts"], "<i8" if wide else "<u4").astype(np.int64)


def _asked(pdf: pd.DataFrame, how: _Hashes) -> list[np.ndarray]:
    return [how.whole(int(p), x) for p, x in zip(pdf["part"], pdf["hashes"], strict=True)]


def by_groups(sent: DataFrame, how: _Hashes, n_blocks: int, spread: int, answer) -> DataFrame:
    """answer(sent), of groups of blocks in their place if there are more than `spread`."""
    if n_blocks <= spread:
        return answer(sent)
    n = 1 << math.ceil(math.log2(n_blocks / spread))  # groups, and ranges that a group takes together
    group = F.floor(F.col("part") / n) * n + F.pmod(F.xxhash64("block"), n)
    rows = sent.withColumn("group", group.cast("long"))

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        h, c = _merge(np.concatenate(_asked(pdf, how)), _counts(pdf, how))
        group = int(pdf["group"].iloc[0])
        out = [(p, group, how.sent(h[x:y]), c[x:y].tobytes()) for p, x, y in _runs(how.parts(h))]
        return pd.DataFrame(out, columns=["part", "block", "hashes", "counts"])

    def hand_on(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        asked = _asked(pdf, how)
        keys = np.unique(np.concatenate(asked))
        data = _joined(answers.sort_values("part")["data"], "<i8" if how.kind == 1 else "u1")
        back = [data[np.searchsorted(keys, x)].tobytes() for x in asked]
        return pd.DataFrame({"block": pdf["block"], "kind": how.kind, "part": pdf["part"], "data": back, "tokens": 0, "types": 0})

    told = answer(rows.groupBy("group").applyInPandas(gather, _SENT))
    handed = rows.groupBy("group").cogroup(told.filter("block >= 0").groupBy("block")).applyInPandas(hand_on, _BACK)
    return handed.unionByName(told.filter("block < 0"))


def word_counts(blocks: DataFrame, bits: int, n_blocks: int, spread: int) -> DataFrame:
    """block, kind 1, part, data (corpus counts of the block's words of that range), and a row for each range
    with its tokens and types."""
    how = _Hashes(1, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, b in _rows(batch):
                block = batch.column(0)[i].as_py()
                c = np.bincount(b.tokens[b.trained()], minlength=len(b.words)).astype("<u4")
                yield _sent([(p, block, how.sent(b.words[x:y]), c[x:y].tobytes()) for p, x, y in _runs(how.parts(b.words))])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        h, c = _merge(_joined(pdf["hashes"], "<u8"), _counts(pdf, how))
        back = [c[np.searchsorted(h, np.frombuffer(x, "<u8"))].tobytes() for x in pdf["hashes"]]
        n = len(back)
        return pd.DataFrame({"block": [*pdf["block"], -1], "kind": 1, "part": int(pdf["part"].iloc[0]), "data": [*back, b""], "tokens": [0] * n + [int(c.sum())], "types": [0] * n + [int((c > 0).sum())]})

    sent = blocks.select("block", "train", "sizes", "words", "tokens").mapInArrow(count, _SENT)
    return by_groups(sent, how, n_blocks, spread, lambda x: x.groupBy("part").applyInPandas(merge, _BACK))


def gram_levels(blocks: DataFrame, bits: int, base: float, probes: int, min_count: int, n_blocks: int, spread: int) -> DataFrame:
    """block, kind 2, part, data (a level for each of the block's bigrams of that range, in order of keys)."""
    how = _Hashes(2, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, b in _rows(batch):
                block, every = batch.column(0)[i].as_py(), b.pairs()
                pairs, at = np.unique(every, return_inverse=True)
                c = np.bincount(at[b.trained()], minlength=len(pairs)).astype("<u4")
                del at, every
                keys = b.keys(pairs, bits)
                order = np.argsort(keys, kind="stable")
                keys, c = keys[order], c[order]
                yield _sent([(p, block, how.sent(keys[x:y]), c[x:y].tobytes()) for p, x, y in _runs(how.parts(keys))])

    def probe(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        asked = how.whole(part, b"".join(pdf["hashes"]))
        h, c = _merge(asked, _counts(pdf, how))
        kept = c >= min_count
        segment = Filter.of(h[kept], level(c[kept], base), probes, base)
        del h, c, kept
        levels = segment.levels(asked).tobytes()
        at = np.concatenate(([0], np.cumsum([len(x) // 4 for x in pdf["hashes"]])))
        return pd.DataFrame({"block": pdf["block"], "kind": 2, "part": part, "data": [levels[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], "tokens": 0, "types": 0})

    sent = blocks.select("block", "train", "sizes", "words", "tokens").mapInArrow(count, _SENT)
    return by_groups(sent, how, n_blocks, spread, lambda x: x.groupBy("part").applyInPandas(probe, _BACK))


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.1, mu: float = 2.0, base: float = math.sqrt(2), probes: int = 6, min_count: int = 1, block_tokens: int = 1 << 19, range_entries: int = 1 << 20, spread: int = 1 << 17) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score. train is a condition on docs' columns."""
    ship(docs.sparkSession)
    blocks = stored(blocks_of(docs, train, id_col, text_col, block_tokens), "blocks", codec="uncompressed")  # its columns are packed already
    size = blocks.agg(F.sum(F.length("words") / 8).alias("words"), F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("blocks")).first()
    bits = lambda n: max(0, math.ceil(math.log2(max(1, n or 0) / range_entries)))
    gram_bits = min(31, bits(size.tokens))
    known = stored(word_counts(blocks, min(31, bits(size.words)), size.blocks, spread), "known", codec="zstd")
    totals = known.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    n_train, n_types = totals.tokens or 0, totals.types or 0

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, b in _rows(batch):
                pieces = sorted(batch.column(batch.schema.get_field_index("pieces"))[i].as_py(), key=lambda x: (x["kind"], x["part"]))
                c = np.frombuffer(b"".join(x["data"] for x in pieces if x["kind"] == 1), "<i8")
                levels = np.frombuffer(b"".join(x["data"] for x in pieces if x["kind"] == 2), np.uint8)
                del pieces
                p1 = (c + alpha) / (n_train + alpha * (n_types + 1))
                pairs, at = np.unique(b.pairs(), return_inverse=True)
                times = np.empty(len(pairs))
                times[np.argsort(b.keys(pairs, gram_bits), kind="stable")] = counted(levels, base)
                hist, word = pairs // len(b.words), pairs % len(b.words)
                logs = np.log10((np.minimum(times, np.minimum(c[hist], c[word])) + mu * p1[word]) / (c[hist] + mu))
                per = lambda x: np.add.reduceat(x, b.starts)
                out = [b.sizes, per((c > 0).astype(np.int64)[b.tokens]), np.full(len(b.sizes), n_train, np.int64), per(np.log10(p1)[b.tokens]), per(logs[at])]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("ids"))[i].values, *map(pa.array, out)], ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    answers = known.filter("block >= 0").unionByName(gram_levels(blocks, gram_bits, base, probes, min_count, size.blocks, spread))
    pieces = answers.groupBy("block").agg(F.collect_list(F.struct("kind", "part", "data")).alias("pieces"))
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(x, T.DoubleType()) for x in ("base_score", "score"))])
    return blocks.drop("n").join(pieces, "block").mapInArrow(rate, out).withColumnRenamed("id", id_col)
