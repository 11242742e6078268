"""Codes from schedules and their counts on plan pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.functions.text import any_of, strip
from planweave.operators import rules as R
from planweave.operators.grid import KEY

NONE = "No Description"
#: Height of the strips of a page in which words meet, in points.
STRIP = 32.0


def schedule_rows(cells: DataFrame) -> DataFrame:
    """cells(document_id, table_index, row_idx, col_idx, text) -> document_id, table_index, row_idx, cells: stripped,
    without columns that are empty everywhere."""
    df = cells.select(*KEY, "row_idx", "col_idx", strip(F.coalesce("text", F.lit(""))).alias("text"))
    df = df.withColumn("used", F.max(F.col("text") != "").over(Window.partitionBy(*KEY, "col_idx"))).filter("used")
    order = F.sort_array(F.collect_list(F.struct("col_idx", "text")))
    return df.groupBy(*KEY, "row_idx").agg(F.transform(order, lambda c: c["text"]).alias("cells"))


def schedule_header(rows: DataFrame) -> DataFrame:
    """document_id, table_index, header_idx, names (unique), code_col, desc_col (from 0)."""
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy(*KEY).orderBy("row_idx"))).filter("k <= 5")
    hits = F.size(F.filter("cells", lambda c: any_of(F.lower(c), R.CSV_HEADER_WORDS)))
    best = F.max_by(F.struct("row_idx", "cells"), F.struct(hits.alias("hits"), (-F.col("k")).alias("early")))
    df = numbered.groupBy(*KEY).agg(best.alias("b")).select(*KEY, F.col("b.row_idx").alias("header_idx"), "b.cells")
    named = F.transform("cells", lambda c, i: F.when((c == "") | (F.lower(c) == "nan"), F.concat(F.lit("Column_"), i + 1)).otherwise(c))
    df = df.select(*KEY, "header_idx", named.alias("names"))
    nth = lambda c, i: F.size(F.filter(F.slice("names", F.lit(1), i + 1), lambda x: x == c))
    unique = F.transform("names", lambda c, i: F.when(nth(c, i) == 1, c).otherwise(F.concat(c, F.lit("_"), nth(c, i))))
    df = df.select(*KEY, "header_idx", unique.alias("names"))
    at = lambda test: F.get(F.filter(F.transform("names", lambda c, i: F.when(test(F.lower(c)), i)), lambda i: i.isNotNull()), F.lit(0))
    return df.withColumns({"code_col": F.coalesce(at(lambda c: any_of(c, R.CSV_CODE_WORDS)), F.lit(0)), "desc_col": F.coalesce(at(lambda c: F.contains(c, F.lit("desc"))), F.lit(1))})


def given_codes(cells: DataFrame) -> DataFrame:
    """document_id, table_index, ord, code, description: codes as the schedule gives them, once each, with the last
    description at the first place."""
    rows = schedule_rows(cells)
    df = rows.join(schedule_header(rows), KEY).filter("row_idx > header_idx")
    last, second = F.element_at("cells", -1), F.coalesce(F.get("cells", F.size("cells") - 2), F.lit(""))
    other = F.when((last != "") & (F.lower(last) != "nan"), last).otherwise(second)
    code = F.coalesce(F.get("cells", "code_col"), F.lit(""))
    odd = (F.length(code) > 6) | F.contains(code, F.lit(" "))
    fixed = F.when((other != "") & (F.length(other) <= 6) & ~F.contains(other, F.lit(" ")) & odd, other).otherwise(code)
    quotes = lambda c: F.regexp_replace(c, "^['\"]+|['\"]+$", "")
    text = F.when(F.col("desc_col") < F.size("cells"), quotes(F.coalesce(F.get("cells", "desc_col"), F.lit("")))).otherwise(NONE)
    df = df.select(*KEY, "row_idx", quotes(fixed).alias("code"), F.coalesce(F.nullif(text, F.lit("")), F.lit(NONE)).alias("description"))
    df = df.filter((F.col("code") != "") & ~F.lower("code").isin(*R.CSV_STOP_WORDS) & (F.length("code") <= 15))
    return df.groupBy(*KEY, "code").agg(F.min("row_idx").alias("ord"), F.max_by("description", "row_idx").alias("description"))


def split_codes(given: DataFrame) -> DataFrame:
    """given_codes() with codes of 12 characters or fewer split at their spaces: given, part (from 0), code."""
    parts = F.when(F.contains("code", F.lit(" ")) & (F.length("code") <= 12), F.filter(F.split("code", r"\s+"), lambda c: c != "")).otherwise(F.array("code"))
    return given.select(*KEY, "ord", "description", F.col("code").alias("given"), F.posexplode(parts).alias("part", "code"))


def codes(cells: DataFrame) -> DataFrame:
    """document_id, table_index, place, code, description; of a code given twice the last description at the first place."""
    place = F.struct("ord", "part")
    return split_codes(given_codes(cells)).groupBy(*KEY, "code").agg(F.min(place).alias("place"), F.max_by("description", place).alias("description"))


def with_bases(found: DataFrame) -> DataFrame:
    """Codes and, where no code is the same, those that are left without a suffix like -EM; a base takes
    the description of the first code that gives it."""
    base = F.regexp_replace("code", "(?i)" + R.CODE_SUFFIX, "")
    bases = found.withColumn("base", base).filter("base <> '' and base <> code")
    bases = bases.groupBy(*KEY, F.col("base").alias("code")).agg(F.min_by("description", "place").alias("description"), F.min_by(F.col("code"), "place").alias("base_of"))
    new = bases.join(found.select(*KEY, "code"), [*KEY, "code"], "left_anti")
    return found.select(*KEY, "code", "description", F.lit(None).cast("string").alias("base_of")).unionByName(new)


def sheet_ids(words: DataFrame, known: Sequence[str], width: float, height: float) -> DataFrame:
    """document_id, page_number, sheet: the sheet number of each page: usual prefixes first, then the one
    nearest to the lower right corner."""
    token = F.regexp_replace(strip(F.col("word")), r"^[.,;:!]+|[.,;:!]+$", "")
    fit = token.rlike("(?i)" + R.SHEET_TOKEN) & ~token.isin(*known)
    away = F.pow(F.lit(width) - F.col("x0"), 2) + F.pow(F.lit(height) - F.col("y0"), 2)
    rank = F.struct((~token.rlike("(?i)" + R.PRIORITY_SHEET)).alias("unusual"), away.alias("away"), token.alias("token"))
    best = F.min_by(F.when(fit, F.upper(token)), F.when(fit, rank))
    return words.groupBy("document_id", "page_number").agg(F.coalesce(best, F.concat(F.lit("Page_"), F.first("page_number"))).alias("sheet"))


def matches(words: DataFrame, known: Sequence[str]) -> DataFrame:
    """Places of codes: document_id, page_number, code, code_ord, x0 ... y1, word. A word that holds a code in
    any case is a candidate; the text around it (2 points, 30 to the right) without spaces must hold the
    code in its own case with no letter or digit beside it. A range join within pages, by strips of `STRIP` points:
    both sides go to every strip that they touch, and a pair counts in the first one they share."""
    codes = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(k).alias("code_ord")) for k, c in enumerate(known)])
    box = words.select("document_id", "page_number", "x0", "y0", "x1", "y1", "word")
    found = box.withColumn("c", F.explode(F.filter(codes, lambda c: F.contains(F.upper("word"), F.upper(c["code"])))))
    found = found.groupBy("document_id", "page_number", "x0", "y0", "x1", "y1", "word", "c").agg(F.count(F.lit(1)).alias("copies"))
    near = box.select(F.col("document_id").alias("d"), F.col("page_number").alias("p"), *[F.col(c).alias(f"w_{c}") for c in ("x0", "y0", "x1", "y1", "word")])
    strip_of = lambda y: F.floor(y / STRIP).cast("int")
    found = found.withColumn("first", strip_of(F.col("y0") - 2)).withColumn("strip", F.explode(F.sequence("first", strip_of(F.col("y1") + 2))))
    near = near.withColumn("w_first", strip_of(F.col("w_y0"))).withColumn("w_strip", F.explode(F.sequence("w_first", strip_of(F.col("w_y1")))))
    same = (F.col("d") == F.col("document_id")) & (F.col("p") == F.col("page_number")) & (F.col("strip") == F.col("w_strip")) & (F.col("strip") == F.greatest("first", "w_first"))
    on = same & (F.col("w_x1") >= F.col("x0") - 2) & (F.col("w_x0") <= F.col("x1") + 30) & (F.col("w_y1") >= F.col("y0") - 2) & (F.col("w_y0") <= F.col("y1") + 2)
    keys = ["document_id", "page_number", "x0", "y0", "x1", "y1", "word", "c", "copies"]
    line = found.join(near, on).groupBy(*keys, "w_y0").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("w_x0", "w_word"))), lambda w: w["w_word"]), "").alias("line"))
    around = line.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("w_y0", "line"))), lambda x: x["line"]), "\n").alias("around"))
    alone = F.concat(F.lit(r"(?:^|[^a-zA-Z0-9])\Q"), F.col("c.code"), F.lit(r"\E(?:[^a-zA-Z0-9]|$)"))
    ok = around.filter(F.regexp(F.replace("around", F.lit(" "), F.lit("")), alone))
    ok = ok.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return ok.select("document_id", "page_number", "c.code", "c.code_ord", "x0", "y0", "x1", "y1", "word")


def suppress(found: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Of places that overlap, the one of the longer code, then of the earlier code and place. A fold over
    the places of one page."""
    order = F.struct((-F.length("code")).alias("size"), "code_ord", "y0", "x0", "word", "x1", "y1", "code")
    pages = found.groupBy("document_id", "page_number").agg(F.sort_array(F.collect_list(order)).alias("places"))
    none = F.array().cast("array<struct<code:string,x0:double,y0:double,x1:double,y1:double>>")
    apart = lambda a, b: (a["x1"] + tolerance < b["x0"]) | (b["x1"] + tolerance < a["x0"]) | (a["y1"] + tolerance < b["y0"]) | (b["y1"] + tolerance < a["y0"])

    def step(kept: Column, p: Column) -> Column:
        row = F.struct(*[p[c].alias(c) for c in ("code", "x0", "y0", "x1", "y1")])
        return F.when(F.exists(kept, lambda k: ~apart(k, p)), kept).otherwise(F.concat(kept, F.array(row)))

    return pages.select("document_id", "page_number", F.posexplode(F.aggregate("places", none, step)).alias("nth", "i")).select("document_id", "page_number", "nth", "i.*")


def instances(accepted: DataFrame, sheets: DataFrame) -> DataFrame:
    """Accepted places with their sheet and an id."""
    rows = accepted.join(sheets, ["document_id", "page_number"])
    place = [F.round(c, 2).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return rows.select("document_id", "page_number", "sheet", F.concat_ws("_", "sheet", "code", "nth").alias("id"), "code", *place)


def counts(accepted: DataFrame, sheets: DataFrame, known: Sequence[str]) -> DataFrame:
    """document_id, sheet, code, n: also the codes that a sheet has none of; pages of one sheet add up."""
    every = sheets.select("document_id", "sheet").distinct().withColumn("code", F.explode(F.array(*map(F.lit, known))))
    n = accepted.join(sheets, ["document_id", "page_number"]).groupBy("document_id", "sheet", "code").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, ["document_id", "sheet", "code"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def matrix(counted: DataFrame, sheets: DataFrame, descriptions: Mapping[str, str] | None = None) -> DataFrame:
    """document_id, code, description, sheets (in the order in which the document's pages show them), counts
    (in that order), total: a row for each code of each document, with whatever sheets the document has."""
    seen = sheets.groupBy("document_id", "sheet").agg(F.min("page_number").alias("first_page"))
    order = F.sort_array(F.collect_list(F.struct("first_page", "sheet", "n")))
    rows = counted.join(seen, ["document_id", "sheet"]).groupBy("document_id", "code").agg(order.alias("cells"), F.sum("n").alias("total"))
    told = F.create_map(*[F.lit(x) for pair in (descriptions or {}).items() for x in pair]) if descriptions else F.create_map(F.lit(""), F.lit(""))
    text = F.coalesce(F.element_at(told, F.col("code")), F.lit(""))
    return rows.select("document_id", "code", text.alias("description"), F.transform("cells", lambda c: c["sheet"]).alias("sheets"), F.transform("cells", lambda c: c["n"]).alias("counts"), "total")


def matrix_of(document_id: int, matrices: DataFrame) -> DataFrame:
    """One document's matrix as its file has it: TYPE, DESCRIPTION, a column per sheet, TOTAL. The sheet names of
    that document, a handful, become columns."""
    rows = matrices.filter(F.col("document_id") == document_id)
    first = rows.select("sheets").first()
    columns = [F.col("counts")[k].alias(s) for k, s in enumerate(first.sheets if first else [])]
    return rows.select(F.col("code").alias("TYPE"), F.col("description").alias("DESCRIPTION"), *columns, F.col("total").alias("TOTAL"))


def count_maps(counted: DataFrame) -> DataFrame:
    """document_id, counts: map of code to map of sheet to count."""
    by_code = counted.groupBy("document_id", "code").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("sheet", "n")))).alias("sheets"))
    return by_code.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "sheets")), lambda a, b: F.when(a["code"] < b["code"], -1).otherwise(1))).alias("counts"))


def grand_total(counts: Column, nested: bool = True) -> Column:
    """Sum over a map of counts, or over a map of such maps."""
    add = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, n: a + n)
    return F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, m: a + add(m)) if nested else add(counts)


def plan_codes(pages: DataFrame) -> DataFrame:
    """document_id, codes: codes with a circuit on plan pages, for documents without a schedule."""
    found = F.filter(F.array_distinct(F.regexp_extract_all("extracted_text", F.lit(R.PLAN_CODE), F.lit(1))), lambda c: ~c.isin(*R.NOT_CODES))
    return pages.select("document_id", F.explode(found).alias("code")).groupBy("document_id").agg(F.sort_array(F.collect_set("code")).alias("codes"))


def status(running: Column, has_counts: Column, has_schedule: Column, has_plans: Column, has_files: Column) -> Column:
    return F.when(running, "running").when(has_counts, "completed").when(has_schedule | has_plans, "partial").when(has_files, "failed").otherwise("not_run")


def result_or_batch(documents: DataFrame, results: DataFrame) -> DataFrame:
    """Each document's own result (document_id, batch_id, total), else its batch's, else zero."""
    own = results.filter("document_id is not null").select("document_id", F.col("total").alias("own"))
    shared = results.filter("document_id is null").select("batch_id", F.col("total").alias("shared"))
    rows = documents.join(own, "document_id", "left").join(shared, "batch_id", "left")
    origin = F.when(F.col("own") > 0, "document").when(F.col("shared") > 0, "batch").otherwise("none")
    return rows.select("document_id", "batch_id", origin.alias("origin"), F.coalesce(F.when(F.col("own") > 0, F.col("own")), F.when(F.col("shared") > 0, F.col("shared")), F.lit(0)).alias("total"))
