"""Catalogue of documents, pages and batches: scans, paging, dedup and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.functions.text import safe_filename

ALLOWED = (".pdf", ".zip")


def owned(documents: DataFrame, owner_id: int, document_id: int | None = None) -> DataFrame:
    rows = documents.filter(F.col("owner_id") == owner_id)
    return rows if document_id is None else rows.filter(F.col("document_id") == document_id)


def newest(documents: DataFrame, owner_id: int, skip: int = 0, limit: int = 50) -> DataFrame:
    """A page of an owner's documents, newest first."""
    return owned(documents, owner_id).orderBy(F.desc("upload_time"), F.desc("document_id")).offset(skip).limit(max(1, min(limit, 200)))


def is_irrelevant() -> Column:
    """False or unknown."""
    return ~F.coalesce("is_relevant", F.lit(False))


def page_counts(pages: DataFrame) -> DataFrame:
    """document_id, total, relevant, irrelevant in one pass."""
    yes = F.coalesce("is_relevant", F.lit(False))
    return pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(yes).alias("relevant"), F.count_if(~yes).alias("irrelevant"))


def type_breakdown(pages: DataFrame) -> DataFrame:
    kind = F.coalesce("page_type", F.lit("UNCLASSIFIED")).alias("page_type")
    return pages.groupBy(kind).agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.coalesce("is_relevant", F.lit(False))).alias("relevant_pages"))


def summary(pages: DataFrame) -> DataFrame:
    """Per document: page numbers by relevance, types by relevance, page to sheet code, classified."""
    yes = F.coalesce("is_relevant", F.lit(False))
    number = F.when(F.col("sheet_code") != "", F.struct("page_number", "sheet_code"))
    return pages.groupBy("document_id").agg(
        F.sort_array(F.collect_list(F.when(yes, F.col("page_number")))).alias("relevant_pages"), F.sort_array(F.collect_list(F.when(~yes, F.col("page_number")))).alias("irrelevant_pages"),
        F.sort_array(F.collect_set(F.when(yes, F.col("page_type")))).alias("relevant_types"), F.sort_array(F.collect_set(F.when(~yes, F.col("page_type")))).alias("irrelevant_types"),
        F.map_from_entries(F.sort_array(F.collect_list(number))).alias("codes"), F.bool_and(F.col("page_type").isNotNull()).alias("classified"),
    )


def uploads(rows: DataFrame, most: int = 100 * 1024 * 1024) -> DataFrame:
    """Uploads with name, type, hash and reject: why a row is not taken, null if it is. Of an owner's
    equal contents the first is taken."""
    name = safe_filename(F.col("filename"))
    kind = F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1))
    size = F.octet_length(F.coalesce("content", F.lit("")))
    out = rows.withColumns({"name": name, "kind": kind, "size": size.cast("long"), "hash": F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256)})
    basic = F.when(~F.col("kind").isin(*ALLOWED), "type").when(F.col("size") == 0, "empty").when(F.col("size") > most, "size")
    out = out.withColumn("basic", basic)
    nth = F.row_number().over(Window.partitionBy("owner_id", "hash", F.col("basic").isNull()).orderBy("upload_seq"))
    return out.withColumn("nth", nth).withColumn("reject", F.coalesce("basic", F.when(F.col("nth") > 1, "duplicate"))).drop("basic", "nth")


def batches(documents: DataFrame) -> DataFrame:
    """Per batch: documents in order of arrival, whether all are completed, how many PDFs are not."""
    order = F.sort_array(F.collect_list(F.struct("upload_time", "document_id")))
    return documents.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("documents"), F.transform(order, lambda d: d["document_id"]).alias("document_ids"), F.bool_and(F.col("status") == "completed").alias("all_completed"),
        F.count_if((F.col("file_type") == "pdf") & (F.col("status") != "completed")).alias("pdf_not_done"),
    )


def siblings(documents: DataFrame) -> DataFrame:
    """Pairs (document_id, sibling_id) within batches, the document itself included."""
    right = documents.select("batch_id", F.col("document_id").alias("sibling_id"), F.col("status").alias("sibling_status"))
    return documents.select("batch_id", "document_id").join(right, "batch_id")


def update_pages(pages: DataFrame, changes: DataFrame, columns: tuple[str, ...] = ("page_type", "is_relevant", "sheet_code", "confidence_source")) -> DataFrame:
    """Pages with new values where changes has a row; values that a change leaves null stay."""
    new = changes.select("document_id", "page_number", *[F.col(c).alias(f"new_{c}") for c in columns])
    rows = pages.join(new, ["document_id", "page_number"], "left")
    return rows.withColumns({c: F.coalesce(f"new_{c}", c) for c in columns}).drop(*[f"new_{c}" for c in columns])


def without(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages of documents that are not deleted."""
    return pages.join(documents.select("document_id"), "document_id", "left_anti")


def batch_merge(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages of a batch in one sequence: by arrival of the document, then page."""
    order = Window.partitionBy("batch_id").orderBy("upload_time", "document_id", "page_number")
    rows = pages.join(documents.select("document_id", "batch_id", "upload_time"), "document_id")
    return rows.withColumn("merged_page", F.row_number().over(order))


def lookup(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Requests (document_id, owner_id) with the document that this owner has, or found = false."""
    known = documents.withColumn("found", F.lit(True))
    return requests.join(known, ["document_id", "owner_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def page_list(pages: DataFrame, skip: int = 0, limit: int = 50, relevance: str | None = None) -> DataFrame:
    """Of every document the pages `skip` + 1 to `skip` + `limit` (500 at most) by number, of one relevance or all."""
    rows = pages if relevance is None else pages.filter("is_relevant" if relevance == "relevant" else is_irrelevant())
    nth = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number"))
    return rows.withColumn("nth", nth).filter((F.col("nth") > max(0, skip)) & (F.col("nth") <= max(0, skip) + max(1, min(limit, 500)))).drop("nth")


def page_view(pages: DataFrame) -> DataFrame:
    """Pages as readers get them: with the text's length, and ocr_used under the name vlm_used."""
    return pages.withColumn("text_length", F.length(F.coalesce("extracted_text", F.lit("")))).withColumnRenamed("ocr_used", "vlm_used")


def command_status(command: Column, status: Column, classified: Column) -> Column:
    """409 for work on a document that is being processed, 400 for what needs a finished classification, else 200."""
    busy = command.isin("reprocess", "reclassify", "rerun") & (status == "processing")
    return F.when(busy, 409).when(command.isin("takeoff", "tables") & ~F.coalesce(classified, F.lit(False)), 400).otherwise(200)


def keynotes(notes: DataFrame, pages: DataFrame, relevance: str = "relevant") -> DataFrame:
    """notes(document_id, page_number, number, text, section) of lighting plans, relevant ones or all: document_id,
    page_number, sheet_code, page_type, notes in order; pages without notes are left out."""
    plans = pages.filter("page_type = 'LIGHTING_PLAN'")
    plans = plans if relevance == "all" else plans.filter("is_relevant")
    by_page = notes.groupBy("document_id", "page_number").agg(F.sort_array(F.collect_list(F.struct("number", "text", "section"))).alias("notes"))
    return plans.join(by_page, ["document_id", "page_number"]).select("document_id", "page_number", F.nullif("sheet_code", F.lit("")).alias("sheet_code"), "page_type", "notes")


def fixture_report(pages: DataFrame, records: DataFrame) -> DataFrame:
    """Per document: fixtures by code (blank codes each), schedule and plan pages, sheet codes of the schedule pages."""
    schedule = F.coalesce((F.col("page_type") == "SCHEDULE") & F.col("is_relevant"), F.lit(False))
    scanned = pages.groupBy("document_id").agg(
        F.count_if(schedule).alias("schedule_pages"), F.count_if(F.col("page_type") == "LIGHTING_PLAN").alias("plan_pages"),
        F.sort_array(F.collect_set(F.when(schedule, F.nullif("sheet_code", F.lit(""))))).alias("sheet_codes"),
    )
    code = F.lower(F.trim("code"))
    found = records.groupBy("document_id").agg((F.count_distinct(F.nullif(code, F.lit(""))) + F.count_if(code == "")).alias("fixtures"))
    return scanned.join(found, "document_id", "left").withColumn("fixtures", F.coalesce("fixtures", F.lit(0)))


def render_info(documents: DataFrame) -> DataFrame:
    """Per archive: the PDF documents of its batch in order of arrival, whether there are any and whether all are completed."""
    pdf = documents.filter("file_type = 'pdf'").groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("upload_time", "document_id"))).alias("d"), F.bool_and(F.col("status") == "completed").alias("done"))
    rows = documents.filter("file_type = 'zip'").select("document_id", "batch_id").join(pdf, "batch_id", "left")
    return rows.select("document_id", "batch_id", F.col("d").isNotNull().alias("extraction_done"), F.coalesce("done", F.lit(True)).alias("processing_completed"), F.coalesce(F.transform("d", lambda x: x["document_id"]), F.array().cast("array<bigint>")).alias("pdfs"))


def artifacts(files: DataFrame) -> DataFrame:
    """files(document_id, path) of a pipeline's output folder -> per document: images, whether there is a text, a table index, a
    schedule, and by which engine it was made."""
    # The paths of an output folder and the names of the two engines.
    has = lambda name: F.bool_or(F.col("path") == name)
    return files.groupBy("document_id").agg(
        F.count_if(F.col("path").like("images/%.png")).alias("images"), has("text/full_text.txt").alias("has_text"), has("tables_all.json").alias("has_tables"),
        has("lighting_schedule.csv").alias("schedule_found"), F.when(has("tables_all.json"), "docling").otherwise("legacy").alias("engine"),
    )


def verdicts(checks: DataFrame) -> DataFrame:
    """Tallies of a report's checks(name, verdict)."""
    return checks.agg(*[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("PASS", "FAIL", "WARN")])
