"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def any_of(c: Column, words: Sequence[str]) -> Column:
    """Whether c holds one of the words."""
    return reduce(Column.__or__, [F.contains(c, F.lit(w)) for w in words])


def occurrences(c: Column, word: str) -> Column:
    """Occurrences that do not overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("int")


def last_place(c: Column, word: str) -> Column:
    """Place (from 0) of the last occurrence, -1 without one."""
    back = F.instr(F.reverse(c), word[::-1])
    return F.when(back > 0, F.length(c) - back - len(word) + 1).otherwise(-1)


def first_or(default: str, *columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(default))


def title_case(c: Column) -> Column:
    return F.initcap(F.lower(c))


def safe_filename(name: Column, most: int = 100) -> Column:
    """Base name with a stem of safe characters, at most `most` of them, and the extension."""
    base = F.replace(F.element_at(F.split(name, "/"), -1), F.lit("\x00"), F.lit(""))
    ext = F.regexp_extract(base, r"(?s)^\.*[^.]+.*?(\.[^.]*)$", 1)  # leading dots belong to the stem
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ext))
    stem = strip(F.regexp_replace(stem, r"[^\p{L}\p{N}_\-. ]", "_"))
    return F.concat(F.substring(first_or("file", stem), 1, most), ext)


#: Classes of characters that count as damage.
GARBLED = (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\xFF]+", r"""[^\p{L}\p{N}_\s\.,!?;:()\[\]{}"'\-]+""", r"\b[a-zA-Z]{1}\s[a-zA-Z]{1}\s", r"[0-9]{4,}")


def garbled_ratio(text: Column) -> Column:
    """Characters in damaged runs over all, at most 1; an empty text counts as damaged."""
    hit = F.lit(0)
    for p in GARBLED:
        hit = hit + F.aggregate(F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(1.0)).otherwise(F.least(F.lit(1.0), hit / F.length(text)))


def numbered(name: str, n: Column, width: int, suffix: str) -> Column:
    """A file name with a number of at least `width` digits: page_0007.png."""
    return F.format_string(f"{name}_%0{width}d{suffix}", n.cast("long"))


def stable_uuid(*parts: Column) -> Column:
    """An id in the form of a UUID of version 4, from the parts' hash, so that a rerun gives the same."""
    h = F.md5(F.to_json(F.struct(*[p.alias(f"p{k}") for k, p in enumerate(parts)])))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("4"), cut(14, 3)), F.concat(F.lit("a"), cut(18, 3)), cut(21, 12))


def normal_path(path: Column) -> Column:
    """An absolute path without `.`, `..` and double slashes; `..` above the root stays at the root."""
    step = lambda out, p: F.when(p.isin("", "."), out).when(p == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def inside(path: Column, root: Column) -> Column:
    """Whether a path, made normal, lies below a folder."""
    return F.startswith(normal_path(path), F.concat(normal_path(root), F.lit("/")))


def valid_name(name: Column) -> Column:
    return F.length(strip(F.coalesce(name, F.lit("")))) >= 2


def valid_password(word: Column) -> Column:
    word = F.coalesce(word, F.lit(""))
    return (F.length(word) >= 8) & word.rlike(r"\p{Lu}") & word.rlike(r"\p{Ll}") & word.rlike(r"\p{Nd}")


def valid_email(address: Column) -> Column:
    return F.coalesce(address, F.lit("")).rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")
