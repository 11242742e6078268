"""Page classification: ordered rules as column expressions; no Python runs on the workers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.functions.text import any_of, collapse, last_place, occurrences, strip
from planweave.operators import rules as R


def _ci(pattern: str, flags: str = "i") -> str:
    return f"(?{flags}){pattern}"


def _first(pairs: list[tuple[Column, str]]) -> Column:
    """The type of the first condition that holds, else null."""
    return F.coalesce(*[F.when(c, F.lit(t)) for c, t in pairs])


def description_type(description: Column) -> Column:
    low = F.lower(description)
    return _first([(any_of(low, words), t) for words, t in R.DESCRIPTION_RULES])


def title_type(title: Column) -> Column:
    low = F.lower(title)
    return _first([(any_of(low, words), t) for words, t in R.TITLE_RULES] + [(title.rlike(_ci(p)), t) for p, t in R.TITLE_PATTERNS])


def title_type_last(title: Column) -> Column:
    """The rule whose words stand last; of equal places the earlier rule. Patterns count by their first match."""
    low, found = F.lower(title), []
    for words, t in R.TITLE_RULES:
        found += [(last_place(low, w), t) for w in words]
    for p, t in R.TITLE_PATTERNS:
        before = F.regexp_extract(title, f"(?is)^(.*?)(?:(?-s){p})", 1)
        found.append((F.when(title.rlike(_ci(p)), F.length(before)).otherwise(-1), t))
    best = F.array_max(F.array(*[F.struct(place.cast("int").alias("place"), F.lit(-k).alias("order"), F.lit(t).alias("type")) for k, (place, t) in enumerate(found)]))
    return F.when(best["place"] >= 0, best["type"])


def sheet_code(title: Column) -> Column:
    """The first code of an electrical sheet or cover, else the first code."""
    codes = F.transform(F.regexp_extract_all(title, F.lit(_ci(R.SHEET_CODE)), F.lit(1)), F.upper)
    own = F.filter(codes, lambda c: c.startswith("E") | (c == "CS"))
    return F.coalesce(F.get(own, F.lit(0)), F.get(codes, F.lit(0)))


def code_type(code: Column, title: Column) -> Column:
    code, low = F.upper(strip(code)), F.lower(F.coalesce(title, F.lit("")))
    demolition = any_of(low, ("demolition plan", "demo plan")) | low.startswith("demo")
    says = lambda w: F.contains(low, F.lit(w))
    has = lambda *p: reduce(Column.__or__, [code.startswith(x) for x in p])
    return (
        F.when(code == "CS", "COVER")
        .when(has("E0"), "SYMBOLS_LEGEND")
        .when(has("E1"), F.when(demolition, "DEMOLITION_PLAN").otherwise("LIGHTING_PLAN"))
        .when(has("E2"), F.when(says("power"), "POWER_PLAN").when(says("signal"), "OTHER").when(demolition, "DEMOLITION_PLAN").otherwise("LIGHTING_PLAN"))
        .when(has("E3"), F.when(says("lighting"), "LIGHTING_PLAN").otherwise("POWER_PLAN"))
        .when(has("E4"), "POWER_PLAN")
        .when(has("E5", "E6", "E7"), F.when(says("roof"), "OTHER").when(says("riser"), "RISER").otherwise("SCHEDULE"))
        .when(has("E8"), "DETAIL")
    )


def cleaned(text: Column) -> Column:
    """Without references to other sheets and without notes, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, _ci(R.CROSS_REFERENCE, "is"), ""), _ci(R.GENERAL_NOTE, "is"), ""))


def content_scores(text: Column) -> Column:
    """array<struct<score, order, type>> of all types; a type found by a pattern alone comes after the others."""
    clean = cleaned(text)

    def scores(low: Column) -> Column:
        rows = []
        for k, (words, t) in enumerate(R.CONTENT_RULES):
            hits = reduce(Column.__add__, [occurrences(low, w) for w in words])
            extra = [F.when(text.rlike(_ci(p)), 1).otherwise(0) for p, own in R.CONTENT_PATTERNS if own == t]
            total = reduce(Column.__add__, extra, hits)
            rows.append(F.struct(total.alias("score"), F.when(hits > 0, -k).otherwise(-99).alias("order"), F.lit(t).alias("type")))
        return F.array(*rows)

    return F.element_at(F.transform(F.array(clean), scores), 1)  # the cleaned text is made once


def content_type(text: Column) -> Column:
    best = F.array_max(content_scores(F.coalesce(text, F.lit(""))))
    return F.when(best["score"] > 0, best["type"]).otherwise("OTHER")


def luminaire_schedule(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    other = reduce(Column.__add__, [occurrences(low, w) for w in R.OTHER_SCHEDULE_WORDS])
    own = reduce(Column.__add__, [occurrences(low, w) for w in R.LUMINAIRE_WORDS])
    return F.when(own > 0, other <= own * 3).otherwise(F.contains(low, F.lit("schedule")) & any_of(low, R.SECONDARY_WORDS))


def relevant(page_type: Column, text: Column) -> Column:
    return F.when(page_type == "SCHEDULE", luminaire_schedule(text)).otherwise(page_type.isin(*R.ALWAYS_RELEVANT))


def index_entries(pages: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """document_id, sheet_code, description, index_type: the index of the first candidate page that has
    entries (page 1, then pages with cover words, then page 2); of equal codes the last line. A page without
    entries in its text is asked for its tables, if rows(document_id, table_index, page_number, row_idx, cells) are
    given: first two columns, below the first row."""
    low = F.lower("extracted_text")
    rank = F.when(F.col("page_number") == 1, 0).when(any_of(low, R.COVER_WORDS), F.col("page_number")).when(F.col("page_number") == 2, 1 << 30)
    text, line = F.col("extracted_text"), F.lit(_ci(R.INDEX_LINE, "im"))
    found = F.arrays_zip(F.regexp_extract_all(text, line, F.lit(1)).alias("code"), F.regexp_extract_all(text, line, F.lit(2)).alias("text"))
    ranked = pages.withColumn("rank", rank).filter("rank is not null")
    entries = ranked.select("document_id", F.struct("rank", F.lit(0).alias("source")).alias("page"), F.posexplode(found).alias("place", "e"))
    place = lambda *c: F.struct(*[F.col(x).cast("long").alias(f"p{k}") for k, x in enumerate(c)]).alias("place")
    entries = entries.withColumn("none", F.lit(0)).select("document_id", "page", place("place", "none"), F.upper(strip(F.col("e.code"))).alias("sheet_code"), strip(F.col("e.text")).alias("description"))
    entries = entries.filter("sheet_code <> '' and description <> ''")
    if rows is not None:
        entries = entries.unionByName(table_entries(rows).join(ranked.select("document_id", "page_number", "rank"), ["document_id", "page_number"]).select(
            "document_id", F.struct("rank", F.lit(1).alias("source")).alias("page"), place("table_index", "row_idx"), "sheet_code", "description"))
    first = F.min("page").over(Window.partitionBy("document_id"))
    kept = entries.withColumn("first", first).filter("page = first")
    last = kept.groupBy("document_id", "sheet_code").agg(F.max_by("description", "place").alias("description"))
    return last.withColumn("index_type", description_type(F.col("description")))


def table_entries(rows: DataFrame) -> DataFrame:
    """Index entries of tables: rows below a table's first whose first cell begins with a sheet code and whose second is not blank."""
    first = F.min("row_idx").over(Window.partitionBy("document_id", "table_index"))
    code, text = F.upper(strip(F.col("cells")[0])), strip(F.col("cells")[1])
    rows = rows.withColumn("first", first).filter((F.col("row_idx") > F.col("first")) & (F.size("cells") > 1))
    rows = rows.select("document_id", "table_index", "page_number", "row_idx", code.alias("sheet_code"), text.alias("description"))
    return rows.filter(F.col("sheet_code").rlike("^(?:" + _ci(R.SHEET_CODE) + ")") & (F.col("description") != ""))


def with_errors(pages: DataFrame, failed: Column) -> DataFrame:
    """Classified pages; those that failed are OTHER, not relevant, of source `error`, and keep their code."""
    return pages.withColumns({
        "page_type": F.when(failed, "OTHER").otherwise(F.col("page_type")), "is_relevant": F.when(failed, False).otherwise(F.col("is_relevant")),
        "confidence_source": F.when(failed, "error").otherwise(F.col("confidence_source")), "sheet_code": F.when(failed, F.coalesce("sheet_code", F.lit(""))).otherwise(F.col("sheet_code")),
    })


def schedule_override(pages: DataFrame, schedule_pages: DataFrame) -> DataFrame:
    """Pages on which a fixture schedule was found are relevant, whatever their type, and flagged."""
    found = schedule_pages.select("document_id", "page_number", F.lit(True).alias("_found")).distinct()
    rows = pages.join(found, ["document_id", "page_number"], "left")
    yes = F.coalesce("_found", F.lit(False))
    return rows.withColumns({"is_relevant": F.when(yes, True).otherwise(F.col("is_relevant")), "has_fixture_schedule": yes}).drop("_found")


def best_text(native: Column, ocr: Column, enhanced: Column, enhanced_mode: Column) -> Column:
    """struct<text, ocr_used>: the longest of a page's own text and its recognised text; in enhanced mode a recognised
    text of less than half of the own one gives way to a longer enhanced one."""
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    better = enhanced_mode & (size(ocr) < size(native) * 0.5) & (size(enhanced) > size(ocr))
    found = F.when(better, enhanced).otherwise(ocr)
    used = size(found) > size(native)
    return F.struct(F.when(used, found).otherwise(F.coalesce(native, F.lit(""))).alias("text"), used.alias("ocr_used"))


def classify(pages: DataFrame) -> DataFrame:
    """pages(document_id, page_number, title_block, extracted_text, filename) with sheet_code, page_type,
    confidence_source and is_relevant. The index is joined on document and code."""
    stem = F.regexp_replace(F.element_at(F.split("filename", "/"), -1), r"(?<=[^.])\.[^.]*$", "")
    index = index_entries(pages)
    rows = pages.withColumns({
        "own_code": sheet_code(F.col("title_block")), "title_type": title_type(F.col("title_block")), "name_type": title_type(stem), "name_code": sheet_code(stem),
        "n_pages": F.count(F.lit(1)).over(Window.partitionBy("document_id")),
    })
    rows = rows.join(index.withColumnRenamed("sheet_code", "own_code"), ["document_id", "own_code"], "left")
    by_code = code_type(F.col("own_code"), F.coalesce(F.nullif("description", F.lit("")), "title_block"))
    made = lambda t, source: F.when(t.isNotNull(), F.struct(t.alias("type"), F.lit(source).alias("source")))
    chain = F.coalesce(made(F.col("index_type"), "sheet_index"), made(F.col("title_type"), "title_block"), made(by_code, "sheet_code"), made(content_type(F.col("extracted_text")), "full_text"))
    rows = rows.withColumn("chain", chain)
    by_name = F.col("name_type").isNotNull() & ((F.col("n_pages") == 1) | (F.col("chain.type") == "OTHER"))
    rows = rows.withColumns({
        "page_type": F.when(by_name, F.col("name_type")).otherwise(F.col("chain.type")), "confidence_source": F.when(by_name, "filename").otherwise(F.col("chain.source")),
        "sheet_code": F.coalesce("own_code", "name_code"),
    })
    return rows.withColumn("is_relevant", relevant(F.col("page_type"), F.col("extracted_text"))).select(*pages.columns, "sheet_code", "page_type", "confidence_source", "is_relevant")


def plan_pages(pages: DataFrame, patterns: tuple[str, ...] = R.PLAN_PATTERNS, only_unclassified: bool = False) -> DataFrame:
    """Plan pages by type; in documents without any, by text. With only_unclassified, text is asked only
    in documents that have no types at all."""
    by_type = F.coalesce(F.col("page_type") == "LIGHTING_PLAN", F.lit(False))
    guard = F.col("page_type").isNotNull() if only_unclassified else by_type
    some = F.max(guard.cast("int")).over(Window.partitionBy("document_id")) == 1
    by_text = reduce(Column.__or__, [F.col("extracted_text").rlike(_ci(p)) for p in patterns])
    label = F.when(by_type, F.coalesce(F.nullif("sheet_code", F.lit("")), F.concat(F.lit("Page_"), "page_number"))).otherwise(F.concat(F.lit("Page_"), "page_number"))
    return pages.withColumns({"some": some, "label": label}).filter(F.when(F.col("some"), by_type).otherwise(by_text)).drop("some")


def schedule_pages(pages: DataFrame) -> DataFrame:
    """Pages to search for schedules: by type; if there are any, pages that name one too; else all pages."""
    by_type = F.coalesce(F.col("page_type").isin("SCHEDULE", "LIGHTING_SCHEDULE"), F.lit(False))
    some = F.max(by_type.cast("int")).over(Window.partitionBy("document_id")) == 1
    return pages.withColumn("some", some).filter(~F.col("some") | by_type | F.col("extracted_text").rlike(_ci(R.WIDEN_PATTERN))).drop("some")


def needs_verification() -> Column:
    return (F.length(F.coalesce("extracted_text", F.lit(""))) < 100) | F.col("confidence_source").isin("full_text", "filename") | (F.col("page_type") == "OTHER")


def scanned() -> Column:
    size = F.length(F.coalesce("extracted_text", F.lit("")))
    return (size < 50) | F.coalesce("ocr_used", F.lit(False)) | ((F.coalesce("page_type", F.lit("")) == "SCHEDULE") & (size < 200))


def title_block(words: DataFrame, width: float, height: float) -> DataFrame:
    """Text of the lower right corner of every page, by place."""
    corner = words.filter((F.col("x0") >= 0.55 * width) & (F.col("y0") >= 0.85 * height))
    order = F.struct("y0", "x0", "word")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda w: w["word"]), " ")
    return corner.groupBy("document_id", "page_number").agg(collapse(joined).alias("title_block"))


def ocr_decision(text: Column, width: float, height: float, has_images: Column, garbled: Column) -> Column:
    """struct<threshold, density, scanned>: whether a page's own text is worth keeping."""
    area = (width / R.POINTS_PER_INCH) * (height / R.POINTS_PER_INCH)
    size = F.length(F.coalesce(text, F.lit("")))
    density = size / F.lit(area)
    yes = (density < R.TEXT_DENSITY) | (garbled > R.MOST_GARBLED) | (has_images & (size < R.BASE_LENGTH))
    return F.struct(F.greatest(F.lit(R.BASE_LENGTH), F.lit(int(area * R.TEXT_DENSITY))).alias("threshold"), density.alias("density"), yes.alias("scanned"))
