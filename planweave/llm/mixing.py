"""Mixing sources to target weights by entropy balancing.

Every document starts at rate 1. Among all document rates r from 0 to `max_rate` that meet the token constraints
(for each source the sum of size times r equals its target), take those of least relative entropy to the
start. The dual is convex, one multiplier per source, and the answer is an exponential tilt: a
document's rate is exp(multiplier * size), or `max_rate` where that is less. So a source that is cut
loses long documents first, and one that is repeated repeats long ones first. The multipliers are found by
Newton iterations: gradient (the sum of size * r) and curvature (of size^2 * r, over rates below the limit) of
all sources come from one distributed aggregation of a histogram (source, size) an iteration; a step that leaves
the interval known to hold the answer is halved into it. The multipliers stay a table; the driver gets the largest miss.

Rates become copies: per source, from the largest size class down, each class gets the whole number of
copies nearest to its share plus the error carried over from the larger ones; so a source misses its
target by about its smallest documents. Within a class the extra copies go to the documents with the
smallest hashes: a threshold per class, found from bucket counts and the counts of one bucket's hashes, so no
task sorts a whole source and texts are never shuffled. Hashes are of id, source and text: reruns agree. Rows alike
have one hash and are counted as one; where the threshold falls among them, as many as are still owed get the
extra copy, by their place among the rows alike (places are dealt out per input partition, so a row repeated
a billion times is many tasks).

DataFrame functions only. Sources are ranked by a range sort, so their number is not bounded. Edge cases: a null
text has size 0; a null source is a source, last in order; a document of size 0 has rate 1 (0 if its source
has words and no target); other columns are ignored by sizes and kept by mix(); very long texts are one size like any other;
empty tables give no rows. Iterations that do not converge raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planweave.llm.common import n_words, stored

#: Size classes for rounding: exact up to 64 words, then 64 to every doubling.
STEPS = 64
#: Bits of a document's hash that count.
HASH_BITS = 48


def size_class(size):
    octave = F.floor(F.log2(F.greatest(size, F.lit(STEPS)).cast("double")))
    width = F.pow(F.lit(2.0), octave - int(math.log2(STEPS)))
    return F.when(size < STEPS, size).otherwise(octave * STEPS + F.floor(size / width)).cast("long")


def _hash(id_col: str, source_col: str, text_col: str):
    return F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`") for c in (id_col, source_col, text_col)]), 64 - HASH_BITS)


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """source, _size, _class and _hash of every row."""
    rows = docs.select(F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("_size"), _hash(id_col, source_col, text_col).alias("_hash"))
    return rows.withColumn("_class", size_class(F.col("_size")))


def ranked(sources: DataFrame) -> DataFrame:
    """sources in order of code points, null last, with place (from 0): sorted by ranges, numbered in each range,
    shifted by what stands before (one row a range)."""
    rows = stored(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    part, own = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("part", part).join(F.broadcast(sizes.select("part", before.alias("before"))), "part").withColumn("place", F.col("before") + own).drop("at", "part", "before")


def targets(sources: DataFrame, weights: Sequence[float], budget: float, max_rate: float) -> DataFrame:
    """source, source_size -> and target: weights go round the sources in order of code points, null
    last; a target stops at max_rate times its source and the excess is shared again by weight, until no
    target is above: each round is one aggregation."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = ranked(sources).select("source", "source_size", w.alias("w"), (F.col("source_size") * float(max_rate)).alias("limit")).checkpoint()
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * budget
    per_weight, full = 0.0, -1
    while True:
        at_limit = F.col("limit") <= F.col("w") * per_weight if full >= 0 else F.lit(False)
        found = rows.agg(F.count_if(at_limit).alias("full"), F.sum(F.when(at_limit, F.col("limit")).otherwise(0.0)).alias("spent"), F.sum(F.when(at_limit, 0.0).otherwise(F.col("w"))).alias("open")).first()
        if found.full == full or not found.open:
            break
        per_weight, full = (total - found.spent) / found.open, found.full
    return rows.select("source", "source_size", F.least("limit", F.col("w") * per_weight).alias("target") if (found.open or 0) else F.col("limit").alias("target"))


def rate_of(size, lam, max_rate: float):
    """A document's rate; lam is null for a source that is to give nothing."""
    top = math.log(max_rate)
    return F.when(lam.isNull(), 0.0).when(size * lam >= top, float(max_rate)).otherwise(F.exp(size * lam))


def multipliers(histogram: DataFrame, wanted: DataFrame, max_rate: float, tolerance: float = 1e-9, most: int = 200) -> DataFrame:
    """Newton on the dual: source, source_size, target, lam with sum(size * rate) = target over the histogram
    (source, _size, docs); lam is null where the target is 0 and all rates at the limit where it is out of reach."""
    top = math.log(max_rate)
    some = (F.col("target") > 0) & (F.col("source_size") > 0)
    reach = F.col("target") >= F.col("source_size") * max_rate * (1 - tolerance)
    state = wanted.select(
        "source", "source_size", "target", F.when(some, F.when(reach, F.lit(top)).otherwise(0.0)).alias("lam"), F.when(some & ~reach, F.lit(True)).otherwise(False).alias("open"),
        F.lit(-math.inf).alias("low"), F.lit(top).alias("high"),
    ).checkpoint()
    for _ in range(most):
        known = state.filter("open").select(F.col("source").alias("s"), "lam")
        r = rate_of(F.col("_size"), F.col("lam"), max_rate)
        words = F.col("docs") * F.col("_size") * r
        fitted = histogram.join(known, F.col("source").eqNullSafe(F.col("s"))).groupBy("source").agg(F.sum(words).alias("fitted"), F.sum(F.when(r < max_rate, words * F.col("_size")).otherwise(0.0)).alias("curvature")).withColumnRenamed("source", "s")
        rows = state.join(fitted, F.col("source").eqNullSafe(F.col("s")), "left")
        over = F.col("fitted") - F.col("target")
        low, high = F.when(over < 0, F.col("lam")).otherwise(F.col("low")), F.when(over > 0, F.col("lam")).otherwise(F.col("high"))
        rows = rows.withColumns({"low": F.when(F.col("open"), low).otherwise(F.col("low")), "high": F.when(F.col("open"), high).otherwise(F.col("high")), "miss": F.abs(over) / F.col("target")})
        newton = F.col("lam") - over / F.greatest("curvature", F.lit(1e-300))
        # outside of the known interval: half of it, or twice as far where it has no end yet
        half = F.when(F.col("low") == -math.inf, 2 * F.col("lam") - 1.0 / F.col("source_size")).otherwise((F.col("low") + F.col("high")) / 2)
        step = F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(half)
        done = F.coalesce("miss", F.lit(0.0)) <= tolerance
        same = (F.col("high") - F.col("low")) <= 1e-15 * F.abs("lam")  # no number lies between
        state = rows.select("source", "source_size", "target", F.when(F.col("open") & ~done, step).otherwise(F.col("lam")).alias("lam"), (F.col("open") & ~done & ~same).alias("open"), "low", "high").checkpoint()
        if not state.filter("open").limit(1).count():
            return state.select("source", "source_size", "target", "lam")
    raise RuntimeError(f"no multipliers after {most} iterations")


def quotas(classes: DataFrame, max_rate: float) -> DataFrame:
    """classes(source, _class, docs, words, owed_words, owed_docs) -> copies for each (source, class): a fold over a
    source's classes, at most a few thousand."""
    by = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("_class", "docs", "words", "owed_words", "owed_docs")), asc=False).alias("classes"))

    def step(a, c):
        mean = c["words"] / c["docs"]
        owed = F.when(mean > 0, (c["owed_words"] + a["carry"]) / F.when(mean > 0, mean)).otherwise(c["owed_docs"])
        n = F.greatest(F.lit(0.0), F.least(F.floor(c["docs"] * F.lit(float(max_rate))), F.round(owed)))
        row = F.struct(c["_class"].alias("_class"), c["docs"].alias("docs"), n.cast("long").alias("copies"))
        return F.struct((a["carry"] + c["owed_words"] - n * mean).alias("carry"), F.concat(a["out"], F.array(row)).alias("out"))

    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<_class:bigint,docs:bigint,copies:bigint>>").alias("out"))
    rows = by.select("source", F.inline(F.aggregate("classes", start, step, lambda a: a["out"])))
    return rows.withColumn("every", F.floor(F.col("copies") / F.col("docs"))).withColumn("extra", F.col("copies") - F.col("every") * F.col("docs"))


def plan(rows: DataFrame, weights: Sequence[float], budget: float, max_rate: float) -> DataFrame:
    """From sized() rows (source, _size, _class, _hash): per (source, class) source_size, target, lam, every (copies
    of each document), below (one more for hashes under it), and of the `alike` rows at that hash, `take`."""
    slim = stored(rows.select("source", "_size", "_class", "_hash"), "sizes")
    n = slim.count()
    bits = min(HASH_BITS, max(8, math.ceil(math.log2(max(1, n) / 50_000))))  # a bucket has some 50,000 hashes at most
    histogram = slim.groupBy("source", "_size").agg(F.count(F.lit(1)).alias("docs")).checkpoint()
    wanted = targets(histogram.groupBy("source").agg(F.sum(F.col("docs") * F.col("_size")).alias("source_size")), weights, budget, max_rate)
    state = multipliers(histogram, wanted, max_rate)
    known = state.select(F.col("source").alias("t"), "source_size", "target", "lam")
    r = F.when((F.col("_size") == 0) & ((F.col("target") > 0) | (F.col("source_size") == 0)), 1.0).otherwise(rate_of(F.col("_size"), F.col("lam"), max_rate))
    fitted = histogram.join(known, F.col("source").eqNullSafe(F.col("t"))).withColumn("r", r).withColumn("_class", size_class(F.col("_size")))
    owed = fitted.groupBy("source", "_class").agg(F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("_size")).alias("words"), F.sum(F.col("docs") * F.col("_size") * F.col("r")).alias("owed_words"), F.sum(F.col("docs") * F.col("r")).alias("owed_docs"))
    quota = quotas(owed, max_rate).checkpoint()
    # Which bucket holds the last document with an extra copy, and which hash there?
    fine = slim.groupBy("source", "_class", F.shiftrightunsigned("_hash", HASH_BITS - bits).alias("bucket")).agg(F.count(F.lit(1)).alias("docs"))
    upto = F.sum("docs").over(Window.partitionBy("source", "_class").orderBy("bucket"))
    q = quota.filter("extra > 0").select(F.col("source").alias("s"), F.col("_class").alias("c"), "extra")
    at = fine.withColumn("upto", upto).join(q, F.col("source").eqNullSafe(F.col("s")) & (F.col("_class") == F.col("c")))
    at = at.filter((F.col("upto") >= F.col("extra")) & (F.col("upto") - F.col("docs") < F.col("extra")))
    at = at.select("s", "c", F.col("bucket").alias("b"), (F.col("extra") - F.col("upto") + F.col("docs")).alias("place")).checkpoint()
    held = slim.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col("_class") == F.col("c")) & (F.shiftrightunsigned("_hash", HASH_BITS - bits) == F.col("b")))
    held = held.groupBy("s", "c", "place", "_hash").agg(F.count(F.lit(1)).alias("alike"))
    held = held.withColumn("upto", F.sum("alike").over(Window.partitionBy("s", "c").orderBy("_hash"))).filter("upto >= place and upto - alike < place")
    below = held.select("s", "c", F.col("_hash").alias("below"), "alike", (F.col("place") - F.col("upto") + F.col("alike")).alias("take"))
    out = quota.join(below, F.col("source").eqNullSafe(F.col("s")) & (F.col("_class") == F.col("c")), "left").join(known, F.col("source").eqNullSafe(F.col("t")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(F.col("source").alias("_source"), F.col("_class").alias("_c"), "source_size", "target", "lam", "every", F.coalesce("below", F.lit(-1)).cast("long").alias("below"), zero("alike"), zero("take")).checkpoint()


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget: float = 1.5, max_rate: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", broadcast_rows: int = 200_000) -> DataFrame:
    """The rows of docs with _mix_size, _mix_source_size, _mix_target, _mix_rate and _mix_copies (0 to max_rate
    rounded up); names that begin with _mix_ are reserved. The plan has a row for each source and size class that
    occurs; up to broadcast_rows rows (some 20 MB) it is broadcast, beyond that joined by shuffle."""
    rows = sized(docs, id_col, source_col, text_col)
    found = plan(rows, weights, budget, max_rate)
    found = found.select(*[F.col(c).alias(f"_mix_{c.strip('_')}") for c in found.columns])
    split = found.filter("_mix_alike > _mix_take").limit(1).count()
    if found.count() <= broadcast_rows:
        found = F.broadcast(found)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*columns, n_words(F.col(f"`{text_col}`")).alias("_mix_size"), _hash(id_col, source_col, text_col).alias("_mix_hash"))
    out = rows.join(found, F.col(f"`{source_col}`").eqNullSafe(F.col("_mix_source")) & (size_class(F.col("_mix_size")) == F.col("_mix_c")), "left")
    zero = (F.col("_mix_size") == 0) & ((F.col("_mix_target") > 0) | (F.col("_mix_source_size") == 0))
    out = out.withColumn("_mix_rate", F.when(zero, 1.0).otherwise(rate_of(F.col("_mix_size"), F.col("_mix_lam"), max_rate)))
    last = F.col("_mix_hash") == F.col("_mix_below")
    extra = lambda more: (F.col("_mix_every") + F.when((F.col("_mix_hash") < F.col("_mix_below")) | more, 1).otherwise(0)).cast("long").alias("_mix_copies")
    kept = [*columns, "_mix_size", "_mix_source_size", "_mix_target", "_mix_rate"]
    if not split:
        return out.select(*kept, extra(last))
    among = last & (F.col("_mix_alike") > F.col("_mix_take"))
    return out.filter(~among).select(*kept, extra(last)).unionByName(placed(out.filter(among)).select(*kept, extra(F.col("_mix_place") < F.col("_mix_take"))))


def placed(alike: DataFrame) -> DataFrame:
    """Rows alike (of one source, class and hash) with _mix_place, 0, 1, ...: numbered in each input partition, after
    those of the partitions before."""
    keys = ["_mix_source", "_mix_c"]
    rows = alike.withColumn("_mix_part", F.spark_partition_id())
    rows = stored(rows, "alike")
    counts = rows.groupBy(*keys, "_mix_part").agg(F.count(F.lit(1)).alias("_mix_n"))
    before = F.coalesce(F.sum("_mix_n").over(Window.partitionBy(*keys).orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("_mix_source").alias("_mix_s"), F.col("_mix_c").alias("_mix_k"), F.col("_mix_part").alias("_mix_p"), before.alias("_mix_before"))
    own = F.row_number().over(Window.partitionBy(*keys, "_mix_part").orderBy("_mix_hash")) - 1
    rows = rows.withColumn("_mix_own", own)
    on = F.col("_mix_source").eqNullSafe(F.col("_mix_s")) & (F.col("_mix_c") == F.col("_mix_k")) & (F.col("_mix_part") == F.col("_mix_p"))
    return rows.join(counts, on).withColumn("_mix_place", F.col("_mix_before") + F.col("_mix_own"))


def repeated(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: every row as many times as it has copies."""
    rows = mixed.filter("_mix_copies > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))))
    return rows.select(*[F.col(f"`{c}`") for c in columns])
