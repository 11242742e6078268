"""Tables as rows of cells: header search, classification, trimming, records.

A table is known by its document and its place there (`KEY`); nothing is ranked, grouped or joined across documents.

Header scoring works on rows (document or table key, row_idx, cells): nine fields in order, each taking
the leftmost free column that one of its aliases fits, as nine projections that carry the used columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.functions.text import any_of, collapse, strip
from planweave.operators import rules as R

KEY = ["document_id", "table_index"]


def rows_of(cells: DataFrame) -> DataFrame:
    """document_id, table_index, page_number, row_idx, cells (array in order of columns)."""
    order = F.sort_array(F.collect_list(F.struct("col_idx", F.coalesce("text", F.lit("")).alias("text"))))
    return cells.groupBy(*KEY, "page_number", "row_idx").agg(F.transform(order, lambda c: c["text"]).alias("cells"))


#: The fields as a literal: aliases in order and what a field is worth.
def _fields() -> Column:
    names = lambda aliases: F.array(*[F.struct(F.lit(a).alias("a"), F.lit(exact).alias("exact")) for a, exact in aliases])
    return F.array(*[F.struct(names(aliases).alias("aliases"), F.lit(3 if f in R.STRONG_FIELDS else 1).alias("worth")) for f, aliases in R.ALIASES])


def score_rows(rows: DataFrame) -> DataFrame:
    """rows with score, n_fields and a column (from 0) or null per field: one fold over the fields that
    carries the columns in use."""
    low = F.transform("cells", lambda c: F.lower(collapse(c)))

    def step(acc: Column, f: Column) -> Column:
        def fit(c: Column, i: Column) -> Column:
            named = F.exists(f["aliases"], lambda a: F.when(a["exact"], c == a["a"]).otherwise(F.contains(c, a["a"])))
            return F.when((c != "") & ~F.exists(acc["columns"], lambda u: u.eqNullSafe(i)) & named, i)

        def grown(i: Column) -> Column:
            return F.struct(F.concat(acc["columns"], F.array(i)).alias("columns"), (acc["score"] + F.when(i.isNull(), 0).otherwise(f["worth"])).alias("score"))

        first = F.get(F.filter(F.transform(acc["low"], fit), lambda i: i.isNotNull()), F.lit(0))
        new = F.element_at(F.transform(F.array(first), grown), 1)
        return F.element_at(F.transform(F.array(new), lambda n: F.struct(acc["low"].alias("low"), n["columns"].alias("columns"), n["score"].alias("score"))), 1)

    start = F.struct(low.alias("low"), F.array().cast("array<int>").alias("columns"), F.lit(0).alias("score"))
    df = rows.withColumn("_found", F.aggregate(_fields(), start, step, lambda a: F.struct(a["score"].alias("score"), a["columns"].alias("columns"))))
    columns = [F.get("_found.columns", F.lit(k)).alias(f"c_{f}") for k, f in enumerate(R.FIELDS)]
    n = F.size(F.filter("_found.columns", lambda i: i.isNotNull())).alias("n_fields")
    return df.select(*rows.columns, *columns, F.col("_found.score").alias("score"), n)


def merged_pairs(rows: DataFrame) -> DataFrame:
    """Each row joined cell by cell with the next."""
    after = Window.partitionBy(*KEY).orderBy("row_idx")
    both = lambda a, b: F.array_join(F.filter(F.array(strip(F.coalesce(a, F.lit(""))), strip(F.coalesce(b, F.lit("")))), lambda x: x != ""), " ")
    pairs = rows.withColumn("next", F.lead("cells").over(after)).filter("next is not null")
    return pairs.withColumn("cells", F.zip_with("cells", "next", both)).drop("next")


def find_header(rows: DataFrame, first: int = 10) -> DataFrame:
    """Per table the header: header_idx, merged, header (cells), score, n_fields and columns of fields. Best
    score; single rows before merged ones, then the earliest; only if it has a code column."""
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy(*KEY).orderBy("row_idx"))).filter(F.col("k") <= first).drop("k")
    tried = numbered.withColumn("merged", F.lit(False)).unionByName(merged_pairs(numbered).withColumn("merged", F.lit(True)))
    scored = score_rows(tried).filter("score > 0")
    best = F.max_by(F.struct(*scored.columns), F.struct("score", (~F.col("merged")).alias("single"), (-F.col("row_idx")).alias("early")))
    out = scored.groupBy(*KEY).agg(best.alias("b")).select("b.*").filter("c_code is not null")
    return out.withColumnsRenamed({"row_idx": "header_idx", "cells": "header"})


def grids_of(rows: DataFrame) -> DataFrame:
    """document_id, table_index, page_number, first_idx, grid: the rows of a table in order."""
    order = F.sort_array(F.collect_list(F.struct("row_idx", "cells")))
    return rows.groupBy(*KEY, "page_number").agg(F.transform(order, lambda r: r["cells"]).alias("grid"))


def header_text(grid: Column) -> Column:
    return F.lower(collapse(F.array_join(F.transform(F.slice(grid, 1, 3), lambda r: F.array_join(r, " ")), " ")))


def header_label(grid: Column) -> Column:
    found = F.transform(F.flatten(F.slice(grid, 1, 3)), lambda c: F.regexp_extract(c, "(?i)" + R.LABEL, 1))
    return F.coalesce(F.initcap(F.lower(strip(F.get(F.filter(found, lambda x: x != ""), F.lit(0))))), F.lit(""))


def classify_tables(rows: DataFrame) -> DataFrame:
    """document_id, table_index, page_number, n_rows, classification, header_label, is_fixture_schedule."""
    grids = grids_of(rows).select(*KEY, "page_number", F.size("grid").alias("n_rows"), header_text(F.col("grid")).alias("text"), header_label(F.col("grid")).alias("label"))
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy(*KEY).orderBy("row_idx"))).filter("k <= 5")
    scored = score_rows(numbered).filter("score > 0")
    electrical = reduce(Column.__or__, [F.col(f"c_{f}").isNotNull() for f in R.ELECTRICAL_FIELDS])
    entry = F.struct("score", (-F.col("k")).alias("early"), "n_fields", electrical.alias("electrical"))
    best = scored.groupBy(*KEY).agg(F.max(entry).alias("five"), F.max(F.when(F.col("k") <= 3, entry)).alias("three"))
    df = grids.join(best, KEY, "left")
    text, label = F.col("text"), F.col("label")
    gate = any_of(F.lower(F.concat(label, F.lit(" "), F.substring(text, 1, 200))), R.TITLE_GATE)
    at = lambda s, f: F.coalesce(F.col(f"{s}.{f}"), F.lit(0))
    light, panel, other = F.lit("LIGHT_FIXTURE_SCHEDULE"), F.lit("PANEL_SCHEDULE"), F.lit("OTHER")
    made = lambda kind, name: F.struct(kind.alias("kind"), F.coalesce(F.nullif(label, F.lit("")), F.lit(name)).alias("label"))
    verdict = (
        F.when(any_of(text, R.POSITIVE_WORDS) & gate, made(light, "Light Fixture Schedule"))
        .when(any_of(text, R.NEGATIVE_WORDS) & (at("five", "score") >= 8) & (at("five", "n_fields") >= 4) & gate, made(light, "Light Fixture Schedule"))
        .when(any_of(text, R.NEGATIVE_WORDS), made(panel, "Panel Schedule"))
        .when(F.contains(text, F.lit(R.AMBIGUOUS_WORD)) & (at("five", "score") >= 3) & gate, made(light, "Fixture Schedule"))
        .when(F.contains(text, F.lit(R.AMBIGUOUS_WORD)), made(other, "Fixture Schedule"))
        .when(text.rlike("(?i)" + R.PANEL_LABEL), made(panel, "Panel Schedule"))
        .when(any_of(text, R.BROAD_NEGATIVE_WORDS), made(other, "Other"))
        .when((at("three", "score") >= 3) & (at("three", "n_fields") >= 2) & F.coalesce("three.electrical", F.lit(False)) & gate, made(light, "Fixture Schedule"))
        .otherwise(made(other, "Other"))
    )
    out = df.withColumn("v", verdict)
    return out.select(*KEY, "page_number", "n_rows", F.col("v.kind").alias("classification"), F.col("v.label").alias("header_label"), (F.col("v.kind") == "LIGHT_FIXTURE_SCHEDULE").alias("is_fixture_schedule"))


def filter_verdict(rows: DataFrame) -> DataFrame:
    """document_id, table_index, verdict: positive, negative or ambiguous by words, columns and panel label."""
    grids = grids_of(rows).select(*KEY, F.lower(F.array_join(F.transform(F.slice("grid", 1, 3), lambda r: F.array_join(r, " ")), " ")).alias("text"))
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy(*KEY).orderBy("row_idx"))).filter("k <= 5")
    best = score_rows(numbered).groupBy(*KEY).agg(F.max("score").alias("best"))
    text = F.col("text")
    verdict = (
        F.when(any_of(text, R.POSITIVE_WORDS), "positive").when(any_of(text, R.NEGATIVE_WORDS), "negative")
        .when(F.contains(text, F.lit(R.AMBIGUOUS_WORD)), F.when(F.col("best") >= 3, "positive").otherwise("negative"))
        .when(text.rlike("(?i)" + R.PANEL_LABEL), "negative").otherwise("ambiguous")
    )
    return grids.join(best, KEY).select(*KEY, verdict.alias("verdict"))


def notes_cell(cell: Column) -> Column:
    s = strip(cell)
    return (s != "") & (s.rlike("(?i)" + R.NOTE) | ((F.length(s) > 80) & (F.regexp_count(s, F.lit("[.!?]")) > 1)))


def header_word(cell: Column) -> Column:
    return F.lower(cell).isin(*R.HEADER_WORDS)


def strip_rows(rows: DataFrame) -> DataFrame:
    """Rows of each table without what stands above its header and without trailing rows that are no data.
    Cells of notes in the first row left are deleted, which shifts that row's columns."""
    order = Window.partitionBy(*KEY).orderBy("row_idx")
    filled = F.filter(F.transform("cells", strip), lambda c: c != "")
    noise = F.forall(filled, notes_cell)  # also true of a blank row
    df = rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(*KEY))).withColumn("lead", F.min(F.when(~noise, F.col("row_idx"))).over(Window.partitionBy(*KEY)))
    small = df.filter("size < 2")
    df = df.filter("size >= 2 and row_idx >= lead")
    clean = F.filter("cells", lambda c: ~notes_cell(c))
    df = df.withColumn("cells", F.when((F.col("row_idx") == F.col("lead")) & (F.size(clean) > 0), clean).otherwise(F.col("cells")))
    header = find_header(df.select(*rows.columns)).select(*KEY, "header_idx")
    df = df.join(header, KEY, "left").filter("header_idx is null or row_idx >= header_idx")
    df = df.withColumns({"k": F.row_number().over(order), "left": F.count(F.lit(1)).over(Window.partitionBy(*KEY))})
    first = strip(F.coalesce(F.get("cells", F.lit(0)), F.lit("")))
    idle = F.forall(F.transform("cells", strip), lambda c: c == "") | ((first != "") & first.rlike("(?i)" + R.NOTE)) | header_word(first)
    last = F.max(F.when((F.col("k") == 1) | ~idle, F.col("k"))).over(Window.partitionBy(*KEY))
    df = df.withColumn("last", last).filter((F.col("left") < 3) | (F.col("k") <= F.col("last")))
    return df.select(*rows.columns).unionByName(small.select(*rows.columns))


def data_row(code: Column) -> Column:
    c = strip(code)
    return (c != "") & ~header_word(c) & ((F.length(c) <= 3) | c.rlike(r"\d"))


def clean_code(code: Column, last: Column, last_is_code: Column) -> Column:
    """A short code in the last column wins over a longer one; else a long one keeps its leading code."""
    short = ~last_is_code & (last != "") & (F.length(last) <= 6) & last.rlike(R.SHORT_CODE) & ~header_word(last) & (F.length(code) > F.length(last))
    lead = F.regexp_extract(code, R.LEADING_CODE, 1)
    return F.when(code == "", code).when(short, last).when((F.length(code) > 6) & (lead != ""), lead).otherwise(code)


def embedded(header: DataFrame) -> DataFrame:
    """A row of the values that stand in header cells after the first alias that fits (`SYMBOL A`)."""
    places = F.array(*[F.col(f"c_{f}") for f in R.FIELDS])
    fields = F.zip_with(places, _fields(), lambda at, f: F.struct(at.alias("at"), f["aliases"].alias("aliases")))

    def step(cells: Column, f: Column) -> Column:
        raw = F.coalesce(F.get("header", f["at"]), F.lit(""))
        low = F.lower(collapse(raw))
        alias = F.get(F.filter(f["aliases"], lambda a: F.when(a["exact"], low == a["a"]).otherwise(F.contains(low, a["a"]))), F.lit(0))["a"]
        value = strip(F.call_function("regexp_extract", raw, F.concat(F.lit(r"(?i)^\s*\Q"), alias, F.lit(r"\E\s+(.+)$")), F.lit(1)))
        return F.transform(cells, lambda c, i: F.coalesce(F.when(i == f["at"], F.nullif(value, F.lit(""))), c))

    df = header.withColumn("cells", F.aggregate(fields, F.transform("header", lambda c: F.lit("")), step))
    return df.filter(F.exists("cells", lambda c: c != "")).withColumn("row_idx", F.lit(-1))


def fixtures(rows: DataFrame, filtered: bool = True) -> DataFrame:
    """document_id, table_index, page_number, row_idx, the nine fields, raw_data: records of every table with a header;
    tables that the word filter refuses are left out (unless filtered is false: they are classified
    already), and those whose codes are mostly numbers."""
    if filtered:
        rows = rows.join(filter_verdict(rows).filter("verdict = 'negative'").select(*KEY), KEY, "left_anti").select(*rows.columns)
    header = find_header(rows)
    columns = [f"c_{f}" for f in R.FIELDS]
    body = rows.join(header.select(*KEY, "header_idx", "merged", "header", *columns), KEY)
    body = body.filter(F.col("row_idx") > F.col("header_idx") + F.col("merged").cast("int"))
    extra = embedded(header).select(*body.columns)
    cell = lambda f: F.coalesce(strip(F.get("cells", F.col(f"c_{f}"))), F.lit(""))
    all_rows = body.unionByName(extra).filter(data_row(cell("code")))
    last = strip(F.element_at("cells", -1))
    code = clean_code(cell("code"), last, F.size("cells") - 1 == F.col("c_code"))
    name = lambda i: F.coalesce(F.nullif(strip(F.get("header", i)), F.lit("")), F.concat(F.lit("Column_"), i + 1))
    pairs = F.transform("cells", lambda c, i: F.struct(name(i).alias("k"), strip(c).alias("v"), i.alias("i")))
    pairs = F.filter(pairs, lambda p: ~F.exists(F.slice(pairs, p["i"] + 2, F.size("cells")), lambda o: o["k"] == p["k"]))  # the last of equal names
    raw = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"], p["v"])))
    out = all_rows.select(*KEY, "page_number", "row_idx", code.alias("code"), *[cell(f).alias(f) for f in R.FIELDS if f != "code"], raw.alias("raw_data"))
    numbers = F.col("code").rlike("^[0-9]+$").cast("double")
    per = Window.partitionBy(*KEY)
    return out.withColumn("panel", (F.count(F.lit(1)).over(per) > 5) & (F.avg(numbers).over(per) > 0.60)).filter("not panel").drop("panel")


def first_of_code(records: DataFrame, keys: tuple[str, ...] = ("page_number", "table_index", "row_idx")) -> DataFrame:
    """The first record of each code of a document, without regard to case and space; records without code all stay."""
    code = F.lower(strip(F.col("code")))
    nth = F.row_number().over(Window.partitionBy("document_id", code).orderBy(*keys))
    return records.withColumn("_nth", nth).filter((code == "") | (F.col("_nth") == 1)).drop("_nth")


def only_new(records: DataFrame, known: DataFrame) -> DataFrame:
    """Records whose code no record of `known` in the same document has."""
    key = lambda: F.lower(strip(F.col("code"))).alias("known_code")
    have = known.select("document_id", key()).distinct()
    rows = records.select("*", key())
    return rows.join(have, ["document_id", "known_code"], "left_anti").drop("known_code")


def best_schedule(tables: DataFrame) -> DataFrame:
    """The fixture schedule with most rows of each document, the first of equals, and the pages that hold one."""
    best = F.max_by(F.struct("table_index", "page_number", "n_rows"), F.struct("n_rows", (-F.col("table_index")).alias("early")))
    pages = F.sort_array(F.collect_set("page_number")).alias("pages")
    return tables.filter("is_fixture_schedule and n_rows >= 2").groupBy("document_id").agg(best.alias("b"), pages).select("document_id", "b.*", "pages")


def by_label(tables: DataFrame) -> DataFrame:
    """document_id, header_label, the tables under it in order, with their place in their page (from 0)."""
    place = F.row_number().over(Window.partitionBy("document_id", "page_number").orderBy("table_index")) - 1
    rows = tables.withColumn("place", place)
    order = F.sort_array(F.collect_list(F.struct("page_number", "place", "table_index")))
    return rows.groupBy("document_id", "header_label").agg(F.count(F.lit(1)).alias("tables"), F.transform(order, lambda t: t["table_index"]).alias("table_indexes"))


def page_counts(tables: DataFrame) -> DataFrame:
    """Tables and fixture schedules on each page."""
    return tables.groupBy("document_id", "page_number").agg(F.count(F.lit(1)).alias("tables"), F.count_if("is_fixture_schedule").alias("fixture_tables"))


def relevant_tables(tables: DataFrame, pages: DataFrame) -> DataFrame:
    """Tables of two rows or more on the relevant pages of their document; on all its pages if none is relevant."""
    some = pages.select("document_id", "page_number", F.lit(True).alias("hit")).distinct()
    any_page = pages.select("document_id", F.lit(True).alias("some")).distinct()
    kept = tables.filter("n_rows >= 2").join(some, ["document_id", "page_number"], "left").join(any_page, "document_id", "left")
    return kept.filter("hit or some is null").drop("hit", "some")


def with_pages(tables: DataFrame, pages: DataFrame) -> DataFrame:
    """Tables with the type and sheet code of their page, null for a page that is not known."""
    known = pages.select("document_id", "page_number", "page_type", F.nullif("sheet_code", F.lit("")).alias("sheet_code"))
    return tables.join(known, ["document_id", "page_number"], "left")


def common_prefix(names: Column) -> Column:
    """The longest text that every name begins with."""

    def both(a: Column, b: Column) -> Column:
        n = F.least(F.length(a), F.length(b))
        differs = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i > n) | (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
        return F.substring(a, F.lit(1), F.coalesce(F.get(differs, F.lit(0)) - 1, n))

    return F.aggregate(names, F.coalesce(F.get(names, F.lit(0)), F.lit("")), both)


def prefix_stripped(names: Column, least: int = 10) -> Column:
    """Column names without the prefix that two or more share, if that has `least` characters: up to its last dot,
    unless that is its first character. A name that is blank then is Column_i, from 0."""
    shared = common_prefix(names)
    dot = F.length(shared) - F.instr(F.reverse(shared), ".") + 1
    size = F.when((F.size(names) > 1) & (F.length(shared) >= least) & (F.instr(shared, ".") > 0) & (dot > 1), dot).otherwise(0)
    left = lambda n: F.substring(n, size + 1, F.length(n))
    return F.transform(names, lambda n, i: F.when((size > 0) & (strip(left(n)) == ""), F.concat(F.lit("Column_"), i)).otherwise(left(n)))


#: The order of the columns of a table of model records.
MODEL_FIELDS = ("code", "description", "fixture_style", "voltage", "mounting", "lumens", "cct", "dimming", "max_va")


def synthetic_grid(records: DataFrame) -> DataFrame:
    """Records of a model as one table per document and page: a header row, then values in order; table_index -1."""
    names = MODEL_FIELDS
    head = records.select("document_id", "page_number").distinct().select("document_id", "page_number", F.lit(0).alias("row_idx"), F.array(*map(F.lit, names)).alias("cells"))
    nth = F.row_number().over(Window.partitionBy("document_id", "page_number").orderBy("row_idx"))
    body = records.select("document_id", "page_number", nth.alias("row_idx"), F.array(*[F.coalesce(F.col(f), F.lit("")) for f in names]).alias("cells"))
    return head.unionByName(body).select("document_id", F.lit(-1).cast("long").alias("table_index"), "page_number", "row_idx", "cells")


def with_model_tables(tables: DataFrame, records: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page of a document its tables and fixture schedules, a synthetic one of a model's records added to the page that they
    were read from (which need not have other tables), with the page's type and sheet code ('' if not known)."""
    counted = page_counts(tables)
    extra = records.select("document_id", "page_number").distinct().select("document_id", "page_number", F.lit(1).alias("more"))
    rows = counted.join(extra, ["document_id", "page_number"], "full").na.fill(0, ["tables", "fixture_tables", "more"])
    rows = rows.withColumns({"tables": F.col("tables") + F.col("more"), "fixture_tables": F.col("fixture_tables") + F.col("more")}).drop("more")
    known = pages.select("document_id", "page_number", "page_type", "sheet_code")
    return rows.join(known, ["document_id", "page_number"], "left").na.fill("", ["page_type", "sheet_code"])


def extract(records: DataFrame, pages: DataFrame) -> DataFrame:
    """Records of a document's schedule pages, and those of its plan pages whose code is new; where the schedule pages give none,
    those of all pages; each code once."""
    typed = pages.select("document_id", "page_number", "page_type")
    rows = records.join(typed, ["document_id", "page_number"], "left")
    own = F.max((F.col("page_type") == "SCHEDULE").cast("int")).over(Window.partitionBy("document_id"))
    rows = rows.withColumn("_own", F.coalesce(own, F.lit(0)))
    # Schedules first, plans second; of a code only the first kind that has it counts.
    kind = F.when((F.col("page_type") == "SCHEDULE") | (F.col("_own") == 0), 0).when(F.col("page_type") == "LIGHTING_PLAN", 1)
    rows = rows.withColumn("_kind", kind).filter("_kind is not null")
    least = F.min("_kind").over(Window.partitionBy("document_id", F.lower(strip(F.col("code")))))
    return first_of_code(rows.withColumn("_least", least).filter("_kind = _least").select(*records.columns))


def kept_grids(rows: DataFrame) -> DataFrame:
    """Rows of tables that have two rows or more and a cell that is not blank."""
    per = Window.partitionBy(*KEY)
    filled = F.exists("cells", lambda c: strip(F.coalesce(c, F.lit(""))) != "")
    out = rows.withColumns({"_n": F.count(F.lit(1)).over(per), "_some": F.max(filled).over(per)})
    return out.filter("_n >= 2 and _some").drop("_n", "_some")


def blocks_to_rows(blocks: DataFrame, zero_based: bool = False) -> DataFrame:
    """Tables from a block graph: words (or a selection mark) of each cell in order, spans filled by the
    later cell, and every place of the grid. With counts from 1 and zero_based false the grid keeps its
    empty first row and column."""
    shift = 1 if zero_based else 0
    cells = blocks.filter("kind = 'CELL'").select("id", F.col("parent").alias("table_id"), (F.col("row_index") - shift).alias("r"), (F.col("col_index") - shift).alias("c"), "row_span", "col_span")
    word = F.when(F.col("kind") == "SELECTION", F.lit("X")).otherwise(F.col("text"))
    words = blocks.filter("kind in ('WORD', 'SELECTION')").groupBy(F.col("parent").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("id").alias("w"), word.alias("t")))), lambda w: w["t"]), " ").alias("text"))
    placed = cells.join(words, "id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    placed = placed.withColumn("rr", F.explode(F.sequence(F.col("r"), F.col("r") + F.col("row_span") - 1)))
    placed = placed.withColumn("cc", F.explode(F.sequence(F.col("c"), F.col("c") + F.col("col_span") - 1)))
    filled = placed.groupBy("table_id", "rr", "cc").agg(F.max_by("text", F.struct("r", "c")).alias("text"))
    size = filled.groupBy("table_id").agg(F.max("rr").alias("rows"), F.max("cc").alias("cols"))
    places = size.withColumn("row_idx", F.explode(F.sequence(F.lit(0), F.col("rows")))).withColumn("col_idx", F.explode(F.sequence(F.lit(0), F.col("cols"))))
    out = places.join(filled.withColumnsRenamed({"rr": "row_idx", "cc": "col_idx"}), ["table_id", "row_idx", "col_idx"], "left")
    return out.select("table_id", "row_idx", "col_idx", F.coalesce("text", F.lit("")).alias("text"))
