"""Tables inside a stream of text lines: page marks, fences, the text before a table, candidates.

The fences are a state machine: in text, a line `TABLE ... rows ...` opens a table; the next fence begins
its data and the one after ends it. Only those few lines per document go through a fold; every other
line gets its state by a window, so a long document is never one array."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.functions.text import any_of, strip
from planweave.operators import rules as R

PAGE_MARK = r"(?i)===\s*PAGE\s+(\d+)\s*==="


def sectioned(lines: DataFrame) -> DataFrame:
    """lines(document_id, line_no, line) with text (stripped), page, state (text, wait, table, mark) and seg
    (the tables that ended before)."""
    text = strip(F.col("line"))
    df = lines.withColumns({"text": text, "own_page": F.regexp_extract(text, PAGE_MARK, 1).try_cast("int")})
    past = Window.partitionBy("document_id").orderBy("line_no")
    df = df.withColumn("page", F.coalesce(F.last("own_page", ignorenulls=True).over(past), F.lit(0)))
    start = F.col("text").startswith("TABLE ") & F.contains(F.lower("text"), F.lit("rows"))
    kind = F.when(F.col("own_page").isNotNull(), None).when(start, "start").when(F.col("text").startswith("======="), "fence")
    events = df.select("document_id", "line_no", kind.alias("kind")).filter("kind is not null")
    events = events.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "kind"))).alias("events"))
    begin = F.struct(F.lit("text").alias("state"), F.array().cast("array<struct<line_no:int,to:string>>").alias("out"))

    def step(a: Column, e: Column) -> Column:
        to = (
            F.when((a["state"] == "text") & (e["kind"] == "start"), "wait").when((a["state"] == "wait") & (e["kind"] == "fence"), "table")
            .when((a["state"] == "table") & (e["kind"] == "fence"), "text")
        )
        row = F.struct(e["line_no"].alias("line_no"), to.alias("to"))
        return F.struct(F.coalesce(to, a["state"]).alias("state"), F.when(to.isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(row))).alias("out"))

    turns = events.select("document_id", F.inline(F.aggregate("events", begin, step, lambda a: a["out"])))
    df = df.join(turns, ["document_id", "line_no"], "left")
    state = F.coalesce(F.last("to", ignorenulls=True).over(past), F.lit("text"))
    df = df.withColumns({"state": F.when(F.col("own_page").isNotNull(), "mark").when(F.col("to").isNotNull(), "turn").otherwise(state), "seg": F.count(F.when(F.col("to") == "text", 1)).over(past)})
    # the closing fence counts to its own table
    return df.withColumn("seg", F.col("seg") - F.when(F.col("to") == "text", 1).otherwise(0)).select(*lines.columns, "text", "page", "state", "to", "seg")


def tables(lines: DataFrame, context: int = 15) -> DataFrame:
    """document_id, seg, page, n_lines, context (the last lines of text before), body; closed tables only."""
    df = sectioned(lines)
    plain = (F.col("text") != "") & ~reduce(Column.__or__, [F.col("text").startswith(p) for p in ("==", "--", "──")])
    order = lambda test: F.transform(F.sort_array(F.collect_list(F.when(test, F.struct("line_no", "text")))), lambda x: x["text"])
    before, body = order((F.col("state") == "text") & plain), order(F.col("state") == "table")
    out = df.groupBy("document_id", "seg").agg(
        F.max(F.when(F.col("to") == "wait", F.col("page"))).alias("page"), F.count(F.when(F.col("to") == "text", 1)).alias("closed"), before.alias("before"), body.alias("body"),
    )
    last = F.slice("before", F.greatest(F.lit(1), F.size("before") - (context - 1)), F.lit(context))
    return out.filter("closed = 1").select("document_id", "seg", "page", F.size("body").alias("n_lines"), F.array_join(last, " ").alias("context"), F.array_join("body", "\n").alias("body"))


def candidates(lines: DataFrame) -> DataFrame:
    """Tables that a schedule title precedes or begins, with is_fixture and is_index."""
    df = tables(lines)
    target = F.concat(F.col("context"), F.lit(" \n "), F.substring("body", 1, 500)).rlike("(?i)" + R.TARGET)
    low = F.lower(F.substring("body", 1, 1000))
    words = reduce(Column.__add__, [F.contains(low, F.lit(w)).cast("int") for w in R.SECTION_WORDS])
    fixture = ~any_of(low, R.CONTROL_WORDS) & (words >= 2) & any_of(low, R.STRONG_SECTION_WORDS)
    return df.filter(target).withColumns({"is_fixture": fixture, "is_index": any_of(F.lower(F.substring("body", 1, 500)), R.INDEX_SECTION_WORDS)})


def best_candidate(lines: DataFrame) -> DataFrame:
    """Per document the best candidate: fixture tables before others that are no index before all; most
    lines; the first of equals. pages: those of its tier, of the last tier its own."""
    df = candidates(lines)
    tier = F.when(F.col("is_fixture") & ~F.col("is_index"), 3).when(~F.col("is_index"), 2).otherwise(1)
    df = df.withColumn("tier", tier)
    best = F.max_by(F.struct("seg", "page", "n_lines", "tier"), F.struct("tier", "n_lines", (-F.col("seg")).alias("early")))
    pages = lambda test: F.transform(F.sort_array(F.collect_list(F.when(test & (F.col("page") > 0), F.struct("seg", "page")))), lambda p: p["page"])
    out = df.groupBy("document_id").agg(best.alias("b"), pages(F.col("tier") == 3).alias("p3"), pages(~F.col("is_index")).alias("p2"))
    own = F.when(F.col("b.page") > 0, F.array("b.page")).otherwise(F.array().cast("array<int>"))
    return out.select("document_id", "b.seg", "b.n_lines", "b.tier", F.when(F.col("b.tier") == 3, F.col("p3")).when(F.col("b.tier") == 2, F.col("p2")).otherwise(own).alias("pages"))


def schedule_csv(lines: DataFrame) -> DataFrame:
    """document_id, csv (the lines of the best candidate), pages: what a document's schedule file holds."""
    best = best_candidate(lines).select("document_id", "seg", "pages")
    return tables(lines).select("document_id", "seg", F.col("body").alias("csv")).join(best, ["document_id", "seg"]).select("document_id", "csv", "pages")
