"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per failed
rule. A policy is a named, versioned set of rules, that is a mask: its verdict is a bitwise AND, so
policies can be changed, compared and ablated on the stored ledger without reading a text again.
DataFrame functions only; a map over the scan, no shuffle. Ablations aggregate the ledger's distinct
bit patterns (at most two to the number of rules).

Edge cases: a null text has no words and fails `few_words`; repeated rows are judged each by itself; a text of any
length is measured whole, in time n log n; a null id stays null; other columns are ignored; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweave.llm.common import SPACE

#: Texts of up to 4095 words pack 52 bits of a window's hash beside its place; longer ones keep all 64. Words of equal hashes are compared.
INDEX_BITS = 12

#: Rules in order of their bits: (name, measurement-based condition for failure). The first two are the base.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("short_words", "2 * word_chars < 5 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("few_letters", "10 * n_letters < 6 * word_chars"),
    ("bullets", "10 * n_bullet_lines > 9 * n_lines"),
    ("ellipses", "10 * n_ellipsis_lines > 3 * n_lines"),
)
BITS = {name: 1 << k for k, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STANDARD = Policy("standard", 1, tuple(BITS))


def repeat_words(words: Column, n: Column, hashes: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: sort (hash, place), keep what equals a
    neighbour in hash and words, then add up the union of the intervals. O(n log n), inside the row."""
    mask = (1 << INDEX_BITS) - 1

    def same_words(a: Column, b: Column) -> Column:
        at = lambda i, k: F.get(words, i.cast("int") + k)
        return (at(a, 0) == at(b, 0)) & (at(a, 1) == at(b, 1)) & (at(a, 2) == at(b, 2))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("sum"))
        step = lambda a, i: F.struct((i + 3).alias("end"), (a["sum"] + 3 - F.greatest(a["end"] - i, F.lit(0))).alias("sum"))
        return F.aggregate(places, start, step, lambda a: a["sum"])

    def packed(p: Column) -> Column:
        place = lambda x: x.bitwiseAND(F.lit(mask).cast("long"))
        same = lambda x, j: (F.shiftright(x, INDEX_BITS) == F.shiftright(F.get(p, j), INDEX_BITS)) & same_words(place(x), place(F.get(p, j)))
        twice = F.filter(p, lambda x, j: F.coalesce(same(x, j + 1), F.lit(False)) | ((j > 0) & same(x, F.greatest(j - 1, F.lit(0)))))
        return covered(F.sort_array(F.transform(twice, place)))

    def paired(p: Column) -> Column:
        same = lambda x, j: (x["h"] == F.get(p, j)["h"]) & same_words(x["i"], F.get(p, j)["i"])
        twice = F.filter(p, lambda x, j: F.coalesce(same(x, j + 1), F.lit(False)) | ((j > 0) & same(x, F.greatest(j - 1, F.lit(0)))))
        return covered(F.sort_array(F.transform(twice, lambda x: x["i"])))

    bind = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  evaluates value once
    short = bind(F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~mask).cast("long")).bitwiseOR(i.cast("long")))), packed)
    huge = bind(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))), paired)
    none = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when(none, F.lit(0).cast("long")).when(n <= mask, short).otherwise(huge)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    has_word = lambda line: F.length(F.translate(line, " \t\n\x0b\x0c\r", "")) > 0
    df = df.select("doc_id", "text", F.array_remove(F.split("text", SPACE), "").alias("words"), F.filter(F.split("text", "\n"), has_word).alias("lines"))
    n = F.size("words")
    window = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    bare = F.transform("lines", lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    df = df.select(
        "doc_id", "words", "lines", n.cast("long").alias("n_words"), F.slice(window, 1, F.greatest(n - 2, F.lit(0))).alias("windows"), bare.alias("bare"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("text", r"\P{L}+", "")).cast("long").alias("n_letters"),
    )
    count = lambda test: F.size(F.filter("bare", test)).cast("long")
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words"), n, F.col("windows")).alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"), "n_letters",
        count(lambda x: x.rlike("^[-*•]")).alias("n_bullet_lines"), count(lambda x: x.endswith("...") | x.endswith("…")).alias("n_ellipsis_lines"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and failures (a bit for each rule that failed)."""
    bits = [F.when(F.expr(test), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, (_, test) in enumerate(RULES)]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return measure(docs, id_col, text_col).withColumn("failures", failures)


def fails(policy: Policy) -> Column:
    return F.col("failures").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply(book: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with policy, policy_version, kept."""
    return book.withColumns({"policy": F.lit(policy.name), "policy_version": F.lit(policy.version), "kept": ~fails(policy)})


def ablate(book: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that the policy would
    keep without it; with the policy's own count beside. One aggregation to bit patterns, then bit
    arithmetic on those."""
    mask = F.lit(policy.mask).cast("long")
    patterns = book.groupBy(F.col("failures").bitwiseAND(mask).alias("bits")).agg(F.count(F.lit(1)).alias("docs"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in policy.rules]))
    rows = patterns.select("bits", "docs", rules.alias("r")).select("bits", "docs", "r.*")
    total = lambda test: F.sum(F.when(test, F.col("docs")).otherwise(0))
    return rows.groupBy("rule", "bit").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("failed"), total(F.col("bits") == F.col("bit")).alias("failed_alone"),
        total(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without"), total(F.col("bits") == 0).alias("kept"),
    )
