"""Line deduplication by content-defined chunks of lines.

A line ends after a line feed, a sentence or a clause (`. ` `! ` `? ` `, ` `; ` `: `), so that passages
inside long lines are seen. Line hashes, in a window of two that rolls over them, decide where chunks end:
after a line whose hash is less than the next one's. So a boundary depends on nothing but the lines beside
it, a passage is cut alike wherever it stands, and half of the lines end a chunk.

A chunk of two lines or more that occurs elsewhere marks its place. At every later occurrence (by id, then place) the mark
grows line by line to both sides, up to `REACH` lines, as long as the lines are those around the first
occurrence. Marks that touch are one passage; a passage of `min_words` words or more is removed
everywhere but at its first occurrence, once the bytes of its chunks and of the lines it grew by are
known to be equal. A chunk of which unequal bytes share a hash is not removed at all.

DataFrame functions only. What is shuffled: chunk hashes; places of repeated chunks; texts once, with
their marks; the distinct texts of repeated chunks, for the comparison. Counts and first occurrences are
aggregated in each task first, so a chunk that a third of all documents hold is one row per task;
joins on a chunk read stored tables on both sides, so the planner can split a hot one. Up to
`broadcast_rows` hashes (8 bytes each) are broadcast to filter the chunks, beyond that they are joined by
shuffle; the same bound decides whether documents without a mark (their keys, 16 bytes) skip the shuffle of texts.

Edge cases: a null text stays null, an empty one empty; rows alike in id and text are one document,
all treated alike, and never duplicates of themselves; between equal ids the row with the smaller hash of
id and text is first; null ids come last; a text is read whole at any length, in time proportional to it;
other columns are kept; an empty table gives no rows. A text may become empty if all of it stands elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweave.llm.common import SPACE, drop_stored, row_keys, stored

#: Lines that a mark may grow by, on each side.
REACH = 3
_SIDES = [f"{side}{j}" for side in "lr" for j in range(1, REACH + 1)]


#: A line: what can not end one is passed over at once, and only from there each place is tried.
_LINE = r"(?s)(?!\z)[^.!?,;:\n]*(?:[.!?,;:] |\n|\z|.+?(?:(?<=[.!?,;:] )|(?<=\n)|\z))"
#: The same without spaces at its ends, in group 1, for a text that does not end with a space.
_BARE_LINE = r"(?s)(?!\z) *+([^.!?,;:\n]*(?:[.!?,;:](?= )|\n|\z|.+?(?:(?<=[.!?,;:])(?= )|(?<=\n)|\z)))"


def lines(text: Column) -> Column:
    """The lines of a text; joined without anything between, they are the text."""
    return F.regexp_extract_all(text, F.lit(_LINE), F.lit(0))


def bare_lines(text: Column) -> Column:
    """The same, each without spaces at its ends."""
    return F.when(text.endswith(" "), F.transform(lines(text), _bare)).otherwise(F.regexp_extract_all(text, F.lit(_BARE_LINE), F.lit(1)))


def _bare(line: Column) -> Column:
    """Lines are compared without spaces at their ends."""
    return F.trim(line)


def _key(h: Column, place: str) -> Column:
    return F.xxhash64(h, F.lit(place))


def _bind(made: Column, body) -> Column:
    """body(made), with made computed once wherever the planner puts it."""
    return F.element_at(F.transform(F.array(made), body), 1)


def cut(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k1, k2, id, x (a hash of each line) and spans (h, start, size of each chunk of two lines or more): a row for each document."""

    def spans(m: Column) -> Column:
        low = F.array_compact(F.transform(m, lambda h, i: F.when(h < F.get(m, i + 1), i + 1)))
        h = lambda start, size: F.xxhash64(F.slice(m, start + 1, size))
        row = lambda start, size: F.when(size > 1, F.struct(h(start, size).alias("h"), start.alias("start"), size.alias("size")))
        return F.array_compact(_bind(low, lambda ends: F.zip_with(F.concat(F.array(F.lit(0)), ends), F.concat(ends, F.array(F.size(m))), lambda start, end: row(start, end - start))))

    def hashed(b: Column) -> Column:
        return F.struct(F.transform(b, lambda x: F.hash(x)).alias("x"), _bind(F.transform(b, lambda x: F.md5(x.cast("binary"))), spans).alias("spans"))

    text = F.col(f"`{text_col}`")
    df = docs.select(*row_keys(id_col, text_col), F.col(f"`{id_col}`").alias("id"), _bind(bare_lines(text), hashed).alias("c"))
    return df.select("k1", "k2", "id", "c.x", "c.spans")


def places(chunks: DataFrame, repeated: DataFrame, around: bool) -> DataFrame:
    """k1, k2, id, h, start, size of every repeated chunk, and if asked for l1... and r1..., the hashes of the lines before and after it."""
    near = lambda s: [F.get("x", s["start"] - j).alias(f"l{j}") for j in range(1, REACH + 1)] + [F.get("x", s["start"] + s["size"] + j - 1).alias(f"r{j}") for j in range(1, REACH + 1)]
    row = lambda s: F.struct(s["h"].alias("h"), s["start"].alias("start"), s["size"].alias("size"), *near(s))
    rows = chunks.select("k1", "k2", "id", F.explode(F.transform("spans", row) if around else F.col("spans")).alias("s")).select("k1", "k2", "id", "s.*")
    return rows.join(repeated, F.col("h") == F.col("g"), "left_semi")


def marks(docs: DataFrame, id_col: str, text_col: str, broadcast_rows: int) -> DataFrame:
    """m1, m2 (the row's keys) and marks, in order: each repeated chunk, whether it is a later occurrence, for those
    the lines around the first, and whether that is in the same document."""
    chunks = stored(cut(docs, id_col, text_col), "chunks", unlike=("k1", "k2", "x.list.element", "spans.list.element.h"))
    counted = chunks.select(F.explode("spans.h").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    repeated = stored(counted.filter("n > 1").select("g"), "repeated")
    known = F.broadcast(repeated) if repeated.count() <= broadcast_rows else repeated
    place = F.struct(F.col("id").isNull().alias("none"), "id", F.col("k1").alias("f1"), F.col("k2").alias("f2"), F.col("start").alias("fstart"), *_SIDES)
    first = places(chunks, known, True).groupBy(F.col("h").alias("fh")).agg(F.min(place).alias("first"))
    first = stored(first.select("fh", *[F.col(f"first.{c}").alias(c) for c in ("f1", "f2", "fstart", *_SIDES)]), "first")
    held = places(chunks, known, False).join(first, F.col("h") == F.col("fh"))
    other = (F.col("f1") != F.col("k1")) | (F.col("f2") != F.col("k2"))
    later = other | (F.col("fstart") != F.col("start"))
    row = F.struct("start", "size", "h", later.alias("later"), *[F.when(later, F.col(c)).alias(c) for c in _SIDES], (later & ~other).alias("own"))
    out = stored(held.groupBy(F.col("k1").alias("m1"), F.col("k2").alias("m2")).agg(F.sort_array(F.collect_set(row)).alias("marks")), "marks")
    drop_stored(chunks, repeated, first)
    return out


def _many_words(text: Column, least: int) -> Column:
    """Whether a text has `least` words; its beginning often tells."""
    some = lambda t: F.size(F.array_remove(F.split(t, SPACE), "")) >= least
    return F.when(some(F.substring(text, 1, 20 * least)), True).otherwise(some(text))


def _found(text: Column, min_words: int) -> Column:
    """From a text and its `marks`: struct of drop (start and size in lines of each passage that goes), clean
    (the text without them) and check (key, t: texts that must agree wherever the key occurs)."""

    def grown(u: Column, m: Column, before: Column, after: Column) -> Column:
        """Lines from start to end, no further than the neighbouring marks."""
        same = lambda i, side, j: F.coalesce((i >= 0) & (F.hash(_bare(F.get(u, i))) == m[f"{side}{j}"]), F.lit(False))
        left, right = F.lit(REACH), F.lit(REACH)
        end = m["start"] + m["size"]
        for j in range(REACH, 0, -1):
            left = F.when(~same(m["start"] - j, "l", j), j - 1).otherwise(left)
            right = F.when(~same(end + j - 1, "r", j), j - 1).otherwise(right)
        low = F.coalesce(before["start"] + before["size"], F.lit(0))
        high = F.coalesce(after["start"], F.size(u))
        left = F.when(m["start"] <= low, 0).otherwise(left)
        right = F.when(end >= high, 0).otherwise(right)
        return F.struct(F.greatest(m["start"] - left, low).alias("start"), F.least(end + right, high).alias("end"))

    def joined(spans: Column) -> Column:
        """Spans that touch, as one."""
        heads = F.array_compact(F.transform(spans, lambda s, i: F.when((i == 0) | (s["start"] > F.get(spans, i - 1)["end"]), s["start"])))
        tails = F.array_compact(F.transform(spans, lambda s, i: F.when((i == F.size(spans) - 1) | (s["end"] < F.get(spans, i + 1)["start"]), s["end"])))
        return F.zip_with(heads, tails, lambda a, b: F.struct(a.alias("start"), (b - a).alias("size")))

    def text_of(u: Column, start: Column, size: Column) -> Column:
        return F.array_join(F.slice(u, start + 1, size), "")

    def of(u: Column) -> Column:
        def with_later(later: Column) -> Column:
            spans = F.transform(later, lambda m, i: grown(u, m, F.get(later, i - 1), F.get(later, i + 1)))
            return _bind(spans, lambda g: result(later, g))

        def result(later: Column, g: Column) -> Column:
            gone = F.filter(joined(g), lambda d: _bind(text_of(u, d["start"], d["size"]), lambda t: _many_words(t, min_words)))
            return _bind(gone, lambda d: F.struct(d.alias("drop"), cleaned(d).alias("clean"), check(later, g).alias("check")))

        def cleaned(d: Column) -> Column:
            kept = F.transform(d, lambda x, i: _bind(F.coalesce(F.get(d, i - 1)["start"] + F.get(d, i - 1)["size"], F.lit(0)), lambda a: text_of(u, a, x["start"] - a)))
            rest = _bind(F.element_at(d, -1), lambda x: text_of(u, x["start"] + x["size"], F.size(u) - x["start"] - x["size"]))
            return F.when(F.size(d) == 0, text).otherwise(F.concat(F.array_join(kept, ""), rest))

        def check(later: Column, g: Column) -> Column:
            row = lambda key, t: F.struct(key.alias("key"), t.alias("t"))
            bare = lambda i: _bare(F.get(u, i))
            chunk = F.transform("marks", lambda m: row(m["h"], F.array_join(F.transform(F.slice(u, m["start"] + 1, m["size"]), _bare), "\n")))

            def sides(m: Column, low: Column, high: Column) -> Column:
                before = [F.when(m["start"] - j >= low, row(_key(m["h"], f"l{j}"), bare(m["start"] - j))) for j in range(1, REACH + 1)]
                after = [F.when(m["start"] + m["size"] + j <= high, row(_key(m["h"], f"r{j}"), bare(m["start"] + m["size"] + j - 1))) for j in range(1, REACH + 1)]
                return F.array_compact(F.array(*before, *after))

            first = F.flatten(F.transform(F.filter("marks", lambda m: ~m["later"]), lambda m: sides(m, F.lit(0), F.size(u))))
            grew = F.flatten(F.transform(later, lambda m, i: sides(m, F.get(g, i)["start"], F.get(g, i)["end"])))
            return F.concat(chunk, first, grew)

        return _bind(F.filter("marks", lambda m: m["later"]), with_later)

    return _bind(lines(text), of)


def _applied(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, min_words: int, how: str) -> DataFrame:
    """The rows of docs (with an inner join those that have marks) with _ld_drop, _ld_clean, _ld_own and _ld_check."""
    columns, text = [F.col(f"`{c}`") for c in docs.columns], F.col(f"`{text_col}`")
    found = found.select(*[F.col(c).alias(f"_ld_{c}") for c in ("m1", "m2", "marks")])
    rows = _keyed(docs, id_col, text_col).join(found, F.expr(_SAME), how)
    inside = rows.select(F.struct(*columns).alias("_ld_row"), text.alias("_ld_text"), F.col("_ld_marks").alias("marks"))
    inside = inside.select("_ld_row", "_ld_text", F.when(F.col("marks").isNotNull(), _found(F.col("_ld_text"), min_words)).alias("_ld_found"), F.coalesce(F.exists("marks", lambda m: m["own"]), F.lit(False)).alias("_ld_own"))
    got = F.col("_ld_found")
    return inside.select(*[F.col(f"_ld_row.`{c}`").alias(c) for c in docs.columns], F.coalesce(got["drop"], _NOTHING()).alias("_ld_drop"), F.when(got.isNull(), F.col("_ld_text")).otherwise(got["clean"]).alias("_ld_clean"), "_ld_own", got["check"].alias("_ld_check"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], *[k.alias(f"_ld_{name}") for k, name in zip(row_keys(id_col, text_col), ("k1", "k2"), strict=True)])


_SAME = "_ld_k1 = _ld_m1 and _ld_k2 = _ld_m2"
_NOTHING = lambda: F.array().cast("array<struct<start:int,size:int>>")


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 25, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs with _ld_drop (array of struct<start, size>: the lines to remove), _ld_clean (the text
    without them) and _ld_own (whether a text repeats a chunk of its own). Names that begin with _ld_ are reserved."""
    found = marks(docs, id_col, text_col, broadcast_rows)
    keys = found.select(F.col("m1").alias("_ld_m1"), F.col("m2").alias("_ld_m2"))
    few = keys.count() <= broadcast_rows / 2
    hit = _keyed(docs, id_col, text_col).join(F.broadcast(keys), F.expr(_SAME), "left_semi").drop("_ld_k1", "_ld_k2") if few else docs
    how = "inner" if few else "left"
    rows = stored(_applied(hit, found, id_col, text_col, min_words, how), "marked", codec="zstd", unlike=(text_col, "_ld_clean", "_ld_check.list.element.key", "_ld_check.list.element.t"))
    # Byte comparison: what shares a key is the same text if the key has one distinct text.
    texts = rows.select(F.explode("_ld_check").alias("c")).select("c.*").distinct()
    bad = texts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("b"))
    if bad.limit(1).count():
        bad = stored(bad, "unequal")
        flat = found.select("m1", "m2", F.explode("marks").alias("m"))
        keys_of = F.array(F.col("m.h"), *[_key(F.col("m.h"), c) for c in _SIDES])
        off = flat.select("m1", "m2", F.col("m.start").alias("start"), F.explode(keys_of).alias("k")).join(bad, F.col("k") == F.col("b"), "left_semi").select("m1", "m2", "start").distinct()
        flat = flat.withColumn("start", F.col("m.start")).join(off, ["m1", "m2", "start"], "left_anti")
        good = stored(flat.groupBy("m1", "m2").agg(F.sort_array(F.collect_set("m")).alias("marks")), "marks")
        again = stored(_applied(hit, good, id_col, text_col, min_words, "left"), "marked")
        drop_stored(rows, good, bad)
        rows = again
    rows = rows.drop("_ld_check")
    if not few:
        drop_stored(found)
        return rows
    rest = _keyed(docs, id_col, text_col).join(F.broadcast(keys), F.expr(_SAME), "left_anti").drop("_ld_k1", "_ld_k2")
    return rows.unionByName(rest.withColumns({"_ld_drop": _NOTHING(), "_ld_clean": F.col(f"`{text_col}`"), "_ld_own": F.lit(False)}))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """The rows of docs, their texts without repeated passages, and _ld_drop, _ld_own, _ld_before (the text as it was)."""
    rows = mark(docs, id_col, text_col, **bounds)
    return rows.select(*[F.col("_ld_clean").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], "_ld_drop", "_ld_own", F.col(f"`{text_col}`").alias("_ld_before"))
