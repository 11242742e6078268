"""Token counts by overlap resynchronisation.

Small texts are counted piece by piece at boundaries that the vocabulary proves to be stable; huge
texts are encoded in overlapping chunks with offsets, spliced at a stable boundary that both
encodings have in common, and the overlap is widened until there is one.

Why a boundary can be proven: the encoder merges neighbouring characters into vocabulary pieces and
nothing else. If no piece holds character x directly before character y, no token can ever span the
two, whatever stands around them, so the text may be cut there and both halves encoded apart.

Edge cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each by itself;
a null id stays null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planweave.llm.common import ship

SPACE_MARK = "▁"
_RUN = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+$")


class PieceCounter:
    """Counts the tokens that a sentencepiece model gives for a text."""

    def __init__(self, model_path: str, chunk_chars: int = 16_384, overlap_chars: int = 256, memo_entries: int = 400_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.chunk, self.overlap, self.memo_entries = chunk_chars, overlap_chars, memo_entries
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        #: every pair of characters that some piece holds side by side
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        probe = "ﬁ①é  x \t\nＡ "
        verbatim = self.sp.normalize(probe) == SPACE_MARK + probe.replace(" ", SPACE_MARK)
        #: words may be counted apart if nothing joins a character to a following space mark
        self.words_apart = verbatim and not any(a != SPACE_MARK and b == SPACE_MARK for a, b in self.joined)
        self.verbatim = verbatim
        self.lone_mark = len(self.sp.encode("x ")) - len(self.sp.encode("x"))
        self.memo: dict[str, int] = {}
        self.widened = 0

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(text) > self.chunk and self.verbatim:
            return self.count_huge(text)
        return self.count_words(text) if self.words_apart else len(self.sp.encode(text))

    # small texts: one look-up for each word

    def _word(self, run: str) -> int:
        """Tokens of one run that starts with a space mark."""
        got = self.memo.get(run)
        if got is None:
            if len(self.memo) >= self.memo_entries:
                self.memo.clear()
            got = self.memo[run] = self.lone_mark if run == SPACE_MARK else len(self.sp.encode(run[1:]))
        return got

    def count_words(self, text: str) -> int:
        marked = SPACE_MARK + text.replace(" ", SPACE_MARK)
        if SPACE_MARK * 2 in marked:
            return sum(map(self._word, _RUN.findall(marked)))
        get, total = self.memo.get, 0
        for word in marked.split(SPACE_MARK)[1:]:
            n = get(word)  # without the mark: never a key that _word makes
            if n is None:
                n = self._word(SPACE_MARK + word)
                self.memo.pop(SPACE_MARK + word, None)
                self.memo[word] = n
            total += n
        return total

    # huge texts: overlapping chunks

    def _ends(self, pieces: list[str], start: int) -> list[int]:
        """End offset in the text of every token of a chunk that begins at start."""
        ends, at, byte_run = [], start - 1, []  # the mark that the encoder puts before is no character of the text
        for p in pieces:
            if len(p) == 6 and p.startswith("<0x"):
                byte_run.append(int(p[3:5], 16))
                lead = byte_run[0]
                width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                if len(byte_run) == width:
                    at, byte_run = at + 1, []
                    ends.append(at)
                else:
                    ends.append(-1)  # inside a character
            else:
                at += len(p)
                ends.append(at)
        return ends

    def _stable(self, text: str, at: int) -> bool:
        left, right = (SPACE_MARK if c == " " else c for c in text[at - 1 : at + 1])
        return left + right not in self.joined

    def count_huge(self, text: str) -> int:
        size, total = len(text), 0
        start, done = 0, -1  # where the chunk begins; up to where tokens are counted
        ends = self._ends(self.sp.encode(text[: self.chunk], out_type=str), 0)
        stop = min(self.chunk, size)
        while stop < size:
            overlap = min(self.overlap, stop - max(done, 0))
            while True:
                begin, until = stop - overlap, min(stop - overlap + self.chunk, size)
                fresh = self._ends(self.sp.encode(text[begin:until], out_type=str), begin)
                both = set(e for e in ends if begin < e < stop) & set(e for e in fresh if begin < e < stop)
                cut = next((e for e in sorted(both, reverse=True) if e > done and self._stable(text, e)), None)
                if cut is not None:
                    total += sum(1 for e in self._closed(ends) if done < e <= cut)
                    start, ends, stop, done = begin, fresh, until, cut
                    break
                self.widened += 1
                if overlap < stop - max(done, 0):
                    overlap = min(overlap * 2, stop - max(done, 0))
                else:  # nothing in common over the whole chunk: read on until there is
                    stop = min(stop + self.chunk, size)
                    ends = self._ends(self.sp.encode(text[start:stop], out_type=str), start)
                    if stop == size:
                        break
        return total + sum(1 for e in self._closed(ends) if e > done)

    @staticmethod
    def _closed(ends: list[int]) -> list[int]:
        """Tokens inside a character count where that character ends."""
        out, pending = [], 0
        for e in ends:
            if e < 0:
                pending += 1
            else:
                out.extend([e] * (pending + 1))
                pending = 0
        return out


_COUNTERS: dict[tuple, PieceCounter] = {}


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 16_384, overlap_chars: int = 256) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit. No shuffle: a map over the scan."""
    ship(docs.sparkSession)
    key = (model_path, chunk_chars, overlap_chars)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(key) or _COUNTERS.setdefault(key, PieceCounter(*key))
        for b in batches:
            n = pa.array([counter.count(t.as_py()) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), n], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType
    text = F.col(text_col)
    out = T.StructType([T.StructField("id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    seen = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return seen.mapInArrow(count, out).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
