"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled texts. A text is parsed
from left to right into the longest phrases that occur in that sample; the fewer phrases it takes, the
more alike they are. The language with the fewest phrases, normalised by the logarithm of its sample's
length and by the text's length (the Ziv-Merhav estimate of cross entropy), wins.

Texts are read whole, as symbols: letters in lower case, and one separator for every run of other
characters. All texts of a batch are parsed at once, one vector operation a symbol; texts of more than `segment` symbols
are parsed in segments, and a phrase ends where its segment ends (once in 8192 symbols).

Bounds, all on the labelled rows that are learned from: per language the documents with the smallest hashes of their ids, at
most `docs_per_language`, each whole, as long as they have `symbols` characters together (a document that would
go beyond is passed over); at most `languages` languages, those with most labelled rows. The choice reads ids, labels and
lengths. Only those texts are sent to the workers, which build the automata themselves, 2 * symbols * alphabet * 4 bytes
each; if there are more than four languages `symbols` is shared out, so that the automata of all take 100 MB or so.

Edge cases: a text that is null or has no letter gets `und` and score 0; if nothing could be learned,
every text does; ties go to the first language by code point; repeated rows are judged each by itself; a text of any length is read
whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.llm.common import at_work, give_back, remembered, ship

UNDETERMINED = "und"
#: Distinct letters that have a symbol of their own; all others share one.
LETTERS = 96
SEP = 0


class Alphabet:
    """Code points to symbols: 0 separator, 1 rare letter, 2... letters."""

    def __init__(self, letters: str):
        self.size = 2 + len(letters)
        self.table = np.zeros(0x110000, np.uint8)
        own = {c: 2 + k for k, c in enumerate(letters)}
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                self.table[cp] = own.get(low if len(low) == 1 else low[0], 1)

    def symbols(self, text: str) -> np.ndarray:
        """Separator first, one for each run of other characters."""
        s = self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        s = np.concatenate((np.zeros(1, np.uint8), s))
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != SEP) | (s[:-1] != SEP)
        return s[keep]


def letters_of(texts: list[str]) -> str:
    found = Counter(c for t in texts for c in t.lower() if c.isalpha())
    return "".join(sorted(c for c, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:LETTERS]))


def automaton(text: np.ndarray, alphabet: int) -> np.ndarray:
    """Flat transition table of the suffix automaton of text, for cross-parsing: entry [state, symbol] is
    2 * (next state * alphabet) + 1 where a phrase begins with this symbol, else without the 1."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        cur = len(nxt)
        nxt.append({}), length.append(length[last] + 1), link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q])), length.append(length[p] + 1), link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        else:
            link[cur] = 0
        last = cur
    restart = np.ones(alphabet, np.int32)  # an unknown symbol is a phrase and leaves the root
    for c, s in nxt[0].items():
        restart[c] = 2 * s * alphabet + 1
    table = np.tile(restart, (len(nxt), 1))
    for s, edges in enumerate(nxt[1:], 1):
        for c, to in edges.items():
            table[s, c] = 2 * to * alphabet
    return table.ravel()


class Model:
    def __init__(self, samples: dict[str, list[str]], segment: int = 8192):
        self.segment = segment
        self.languages = sorted(samples)
        self.alphabet = Alphabet(letters_of([t for x in samples.values() for t in x]))
        self.tables, self.lengths = [], []
        for lang in self.languages:
            text = np.concatenate([self.alphabet.symbols(t) for t in samples[lang]] + [np.zeros(0, np.uint8)])
            self.tables.append(automaton(text, self.alphabet.size))
            self.lengths.append(max(2, len(text)))

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of every text in every language. Segments are lanes, longest first, so that those still
        running are the first ones."""
        flat = np.concatenate(texts)
        sizes = np.array([len(t) for t in texts])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        per = -(-sizes // self.segment)
        owner = np.repeat(np.arange(len(texts)), per)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        at = starts[owner] + nth * self.segment
        length = np.minimum(sizes[owner] - nth * self.segment, self.segment)
        order = np.argsort(-length, kind="stable")
        owner, at, length = owner[order], at[order], length[order]
        running = np.searchsorted(-length, -np.arange(length[0]), side="left")  # lanes longer than each step
        state = [np.zeros(len(owner), np.int32) for _ in self.tables]
        count = [np.zeros(len(owner), np.int32) for _ in self.tables]
        for step, n in enumerate(running.tolist()):
            symbols = flat[at[:n] + step]
            for table, s, c in zip(self.tables, state, count, strict=True):
                v = table[s[:n] + symbols]
                c[:n] += v & 1
                s[:n] = v >> 1
        out = np.zeros((len(texts), len(self.tables)), np.int64)
        for k, c in enumerate(count):
            out[:, k] = np.bincount(owner, weights=c, minlength=len(texts)).astype(np.int64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score (share of 2 ** -(4 * entropy) among the languages) and its entropy."""
        langs, scores, bits = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        todo: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush() -> None:
            nonlocal todo, held
            if todo and self.languages:
                n = np.array([len(s) for _, s in todo], float)
                h = self.phrases([s for _, s in todo]) * np.log2(self.lengths)[None, :] / n[:, None]
                best = h.argmin(1)
                share = 1.0 / np.exp2(4 * (h.min(1, keepdims=True) - h)).sum(1)
                for (i, _), b, p, x in zip(todo, best, share, h.min(1), strict=True):
                    langs[i], scores[i], bits[i] = self.languages[b], float(p), float(x)
            todo, held = [], 0

        for i, t in enumerate(texts):
            if t:
                s = self.alphabet.symbols(t)
                if s.any():
                    todo.append((i, s))
                    held += len(s)
                    if held > 8_000_000:
                        flush()
        flush()
        return langs, scores, bits


def sample(docs: DataFrame, docs_per_language: int = 64, symbols: int = 1 << 16, languages: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """The labelled texts to learn from, as the module says. Only ids, labels and lengths are ranked, and
    docs_per_language rows a task and language are kept before they are shuffled."""
    mark = F.xxhash64(F.col(f"`{id_col}`"))
    rows = docs.filter(F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{lang_col}`").alias("lang"), mark.alias("mark"), F.col(f"`{text_col}`").alias("text"))
    # Languages of most rows; a count per language, cut to a bounded list before it is collected.
    most = [r.lang for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()]
    if not most:
        return {}
    room = min(symbols, 4 * symbols // len(most))
    slim = rows.filter(F.col("lang").isin(most) & (F.length("text") <= room)).select("lang", "mark", F.length("text").alias("size"), F.xxhash64("text").alias("key"))
    first = slim.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("mark", "key"))).filter(F.col("k") <= docs_per_language).collect()
    chosen: set[tuple[str, int, int]] = set()
    left = dict.fromkeys(most, room)
    for r in sorted(first, key=lambda r: (r.lang, r.k)):
        if r.size <= left[r.lang] and (r.lang, r.mark, r.key) not in chosen:
            left[r.lang] -= r.size
            chosen.add((r.lang, r.mark, r.key))
    if not chosen:
        return {}
    picked = docs.sparkSession.createDataFrame(sorted(chosen), "lang string, mark long, key long")
    got = rows.withColumn("key", F.xxhash64("text")).join(F.broadcast(picked), ["lang", "mark", "key"]).groupBy("lang", "mark", "key").agg(F.min("text").alias("text")).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r.lang, r.mark, r.key)):
        out.setdefault(r.lang, []).append(r.text or "")
    return out


_MODELS: dict[str, Model] = {}
remembered("languages", _MODELS.clear)


def _model(key: str) -> Model:
    at_work("languages")
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(**json.loads(key))
    return _MODELS[key]


def identifier(docs: DataFrame, samples: dict[str, list[str]], segment: int = 8192):
    """A function from a text column to struct<lang, score, bits>."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(json.dumps({"samples": samples, "segment": segment}, sort_keys=True))

    @F.pandas_udf("lang string, score double, bits double")
    def run(texts: pd.Series) -> pd.DataFrame:
        lang, score, bits = _model(sent.value).predict(texts.tolist())
        give_back()
        return pd.DataFrame({"lang": lang, "score": score, "bits": bits})

    return run


def identify(docs: DataFrame, samples: dict[str, list[str]], text_col: str = "text", **bounds) -> Column:
    return identifier(docs, samples, **bounds)(F.col(f"`{text_col}`"))
