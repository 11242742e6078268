"""Registered queries on pages, documents and replies, and their SQL, written apart from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.functions.text import garbled_ratio, safe_filename
from planweave.operators import catalog, classify, verify
from planweave.operators import rules as R
from planweave.plans.fixtures import view, with_views

WIDTH, HEIGHT = 800.0, 640.0


# ---- SQL builders for the other side ----


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_any(col: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def sql_hits(col: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"(length({col}) - length(replace({col}, {q(w)}, ''))) // {len(w)}" for w in words) + ")"


def sql_first(col: str, rules, patterns=()) -> str:
    parts = [f"WHEN {sql_any(f'lower({col})', words)} THEN '{t}'" for words, t in rules]
    parts += [f"WHEN regexp_matches({col}, {q(p)}, 'i') THEN '{t}'" for p, t in patterns]
    return "CASE " + " ".join(parts) + " END"


def sql_code(col: str) -> str:
    codes = f"list_transform(regexp_extract_all({col}, {q(R.SHEET_CODE)}, 1, 'i'), lambda c: upper(c))"
    return f"coalesce(list_filter({codes}, lambda c: starts_with(c, 'E') OR c = 'CS')[1], ({codes})[1])"


def sql_code_type(code: str, title: str) -> str:
    t = f"lower(coalesce({title}, ''))"
    demo = f"(contains({t}, 'demolition plan') OR contains({t}, 'demo plan') OR starts_with({t}, 'demo'))"
    return f"""CASE WHEN {code} = 'CS' THEN 'COVER'
      WHEN {code} LIKE 'E0%' THEN 'SYMBOLS_LEGEND'
      WHEN {code} LIKE 'E1%' THEN CASE WHEN {demo} THEN 'DEMOLITION_PLAN' ELSE 'LIGHTING_PLAN' END
      WHEN {code} LIKE 'E2%' THEN CASE WHEN contains({t}, 'power') THEN 'POWER_PLAN' WHEN contains({t}, 'signal') THEN 'OTHER' WHEN {demo} THEN 'DEMOLITION_PLAN' ELSE 'LIGHTING_PLAN' END
      WHEN {code} LIKE 'E3%' THEN CASE WHEN contains({t}, 'lighting') THEN 'LIGHTING_PLAN' ELSE 'POWER_PLAN' END
      WHEN {code} LIKE 'E4%' THEN 'POWER_PLAN'
      WHEN regexp_matches({code}, '^E[567]') THEN CASE WHEN contains({t}, 'roof') THEN 'OTHER' WHEN contains({t}, 'riser') THEN 'RISER' ELSE 'SCHEDULE' END
      WHEN {code} LIKE 'E8%' THEN 'DETAIL' END"""


def sql_content_ctes(source: str, key: str, text: str) -> str:
    """content(key, content_type) over source."""
    rows = []
    for k, (words, t) in enumerate(R.CONTENT_RULES):
        extra = "".join(f" + CASE WHEN regexp_matches(raw, {q(p)}, 'i') THEN 1 ELSE 0 END" for p, own in R.CONTENT_PATTERNS if own == t)
        rows.append(f"SELECT {key}, {k} AS ord, '{t}' AS type, {sql_hits('low', words)} AS hits, {sql_hits('low', words)}{extra} AS score FROM clean")
    return f"""clean AS (
      SELECT {key}, {text} AS raw, lower(regexp_replace(regexp_replace({text}, {q(R.CROSS_REFERENCE)}, '', 'gis'), {q(R.GENERAL_NOTE)}, '', 'gis')) AS low FROM {source}),
    scored AS ({" UNION ALL ".join(rows)}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, CASE WHEN hits > 0 THEN ord ELSE 99 END) AS place FROM scored),
    content AS (SELECT {key}, CASE WHEN score > 0 THEN type ELSE 'OTHER' END AS content_type, score FROM ranked WHERE place = 1)"""


def sql_luminaire(text: str) -> str:
    t = f"lower({text})"
    own, other = sql_hits(t, R.LUMINAIRE_WORDS), sql_hits(t, R.OTHER_SCHEDULE_WORDS)
    return f"CASE WHEN {own} > 0 THEN {other} <= 3 * {own} ELSE contains({t}, 'schedule') AND {sql_any(t, R.SECONDARY_WORDS)} END"


INDEX_CTES = f"""
ranked_pages AS (
  SELECT *, CASE WHEN page_number = 1 THEN 0 WHEN {sql_any("lower(extracted_text)", R.COVER_WORDS)} THEN page_number WHEN page_number = 2 THEN 1073741824 END AS rank FROM fx_sheets),
index_lines AS (
  SELECT document_id, rank, unnest(regexp_extract_all(extracted_text, {q('(?im)' + R.INDEX_LINE)}, 1)) AS code, unnest(regexp_extract_all(extracted_text, {q('(?im)' + R.INDEX_LINE)}, 2)) AS label,
         generate_subscripts(regexp_extract_all(extracted_text, {q('(?im)' + R.INDEX_LINE)}, 1), 1) AS place FROM ranked_pages WHERE rank IS NOT NULL),
index_first AS (SELECT *, min(rank) OVER (PARTITION BY document_id) AS first FROM (SELECT document_id, rank, place, upper(trim(code)) AS sheet_code, trim(label) AS description FROM index_lines) WHERE sheet_code <> '' AND description <> ''),
sheet_index AS (
  SELECT document_id, sheet_code, description, {sql_first("description", R.DESCRIPTION_RULES)} AS index_type
  FROM (SELECT *, row_number() OVER (PARTITION BY document_id, sheet_code ORDER BY place DESC) AS n FROM index_first WHERE rank = first) WHERE n = 1)"""
CLASSIFY_CTES = f"""
{INDEX_CTES},
{sql_content_ctes("fx_sheets", "doc_id", "extracted_text")},
told AS (
  SELECT p.*, {sql_code("p.title_block")} AS own_code, {sql_first("p.title_block", R.TITLE_RULES, R.TITLE_PATTERNS)} AS title_type,
         {sql_first("regexp_replace(p.filename, '[.][^.]*$', '')", R.TITLE_RULES, R.TITLE_PATTERNS)} AS name_type, {sql_code("regexp_replace(p.filename, '[.][^.]*$', '')")} AS name_code,
         count(*) OVER (PARTITION BY document_id) AS n_pages FROM fx_sheets p),
chained AS (
  SELECT t.*, i.index_type, c.content_type, {sql_code_type("t.own_code", "coalesce(nullif(i.description, ''), t.title_block)")} AS code_type
  FROM told t LEFT JOIN sheet_index i ON i.document_id = t.document_id AND i.sheet_code = t.own_code JOIN content c ON c.doc_id = t.doc_id),
levelled AS (
  SELECT *, coalesce(index_type, title_type, code_type, content_type) AS chain_type,
         CASE WHEN index_type IS NOT NULL THEN 'sheet_index' WHEN title_type IS NOT NULL THEN 'title_block' WHEN code_type IS NOT NULL THEN 'sheet_code' ELSE 'full_text' END AS chain_source FROM chained),
typed AS (
  SELECT document_id, page_number, doc_id, extracted_text, ocr_used, coalesce(own_code, name_code) AS sheet_code,
         CASE WHEN name_type IS NOT NULL AND (n_pages = 1 OR chain_type = 'OTHER') THEN name_type ELSE chain_type END AS page_type,
         CASE WHEN name_type IS NOT NULL AND (n_pages = 1 OR chain_type = 'OTHER') THEN 'filename' ELSE chain_source END AS confidence_source FROM levelled),
classified AS (
  SELECT *, CASE WHEN page_type = 'SCHEDULE' THEN {sql_luminaire("extracted_text")} ELSE page_type IN ('LIGHTING_PLAN', 'SYMBOLS_LEGEND', 'COVER') END AS is_relevant FROM typed)"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(view(spark, sf_dir, "fx_sheets"))


QUERIES, SQL = {}, {}


def add(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def over_classified(select: str) -> str:
    return f"{with_views('fx_sheets')}, {CLASSIFY_CTES} {select}"


# ---- classification ----


@add("classify_pages", over_classified("SELECT document_id, page_number, doc_id, sheet_code, page_type, confidence_source, is_relevant FROM classified"))
def _(s, d):
    return classified(s, d).select("document_id", "page_number", "doc_id", "sheet_code", "page_type", "confidence_source", "is_relevant")


@add("classification_summary", over_classified("SELECT page_type, count(*) AS pages, count(*) FILTER (WHERE is_relevant) AS relevant_pages FROM classified GROUP BY page_type"))
def _(s, d):
    return catalog.type_breakdown(classified(s, d))


@add("document_summary", over_classified("""
SELECT document_id, list_sort(list(page_number) FILTER (WHERE is_relevant)) AS relevant_pages, coalesce(list_sort(list(page_number) FILTER (WHERE NOT is_relevant)), []) AS irrelevant_pages,
       list_sort(list(DISTINCT page_type) FILTER (WHERE is_relevant)) AS relevant_types, list_sort(list(DISTINCT page_type) FILTER (WHERE NOT is_relevant)) AS irrelevant_types FROM classified GROUP BY document_id"""))
def _(s, d):
    rows = catalog.summary(classified(s, d))
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    return rows.select("document_id", some("relevant_pages"), "irrelevant_pages", some("relevant_types"), some("irrelevant_types"))


@add("document_codes", over_classified("SELECT document_id, page_number, sheet_code FROM classified WHERE sheet_code <> ''"))
def _(s, d):
    return catalog.summary(classified(s, d)).select("document_id", F.explode("codes").alias("page_number", "sheet_code"))


@add("page_counts", over_classified("SELECT document_id, count(*) AS total, count(*) FILTER (WHERE is_relevant) AS relevant, count(*) FILTER (WHERE NOT coalesce(is_relevant, FALSE)) AS irrelevant FROM classified GROUP BY document_id"))
def _(s, d):
    return catalog.page_counts(classified(s, d))


@add("verify_candidates", over_classified("SELECT doc_id, page_type FROM classified WHERE length(extracted_text) < 100 OR confidence_source IN ('full_text', 'filename') OR page_type = 'OTHER'"))
def _(s, d):
    return classified(s, d).filter(classify.needs_verification()).select("doc_id", "page_type")


@add("scanned_pages", over_classified("SELECT doc_id FROM classified WHERE length(extracted_text) < 50 OR ocr_used OR (page_type = 'SCHEDULE' AND length(extracted_text) < 200)"))
def _(s, d):
    return classified(s, d).filter(classify.scanned()).select("doc_id")


_PLAN_TEXT = " OR ".join(f"regexp_matches(extracted_text, {q(p)}, 'i')" for p in R.PLAN_PATTERNS)


@add("plan_page_select", over_classified(f"""
SELECT doc_id, CASE WHEN page_type = 'LIGHTING_PLAN' AND sheet_code <> '' THEN sheet_code ELSE concat('Page_', page_number) END AS label
FROM (SELECT *, bool_or(page_type = 'LIGHTING_PLAN') OVER (PARTITION BY document_id) AS has_any FROM classified) WHERE CASE WHEN has_any THEN page_type = 'LIGHTING_PLAN' ELSE {_PLAN_TEXT} END"""))
def _(s, d):
    return classify.plan_pages(classified(s, d)).select("doc_id", "label")


@add("schedule_page_select", over_classified(f"""
SELECT doc_id FROM (SELECT *, bool_or(page_type IN ('SCHEDULE', 'LIGHTING_SCHEDULE')) OVER (PARTITION BY document_id) AS has_any FROM classified)
WHERE NOT has_any OR page_type IN ('SCHEDULE', 'LIGHTING_SCHEDULE') OR regexp_matches(extracted_text, {q(R.WIDEN_PATTERN)}, 'i')"""))
def _(s, d):
    return classify.schedule_pages(classified(s, d)).select("doc_id")


_BATCH_TEXT = " OR ".join(f"regexp_matches(extracted_text, {q(p)}, 'i')" for p in R.BATCH_PLAN_PATTERNS)


@add("batch_plan_pages", over_classified(f"""
SELECT doc_id FROM (SELECT *, bool_or(page_type IS NOT NULL) OVER (PARTITION BY document_id) AS has_any FROM
  (SELECT doc_id, document_id, extracted_text, CASE WHEN document_id % 3 = 0 THEN NULL ELSE page_type END AS page_type FROM classified))
WHERE CASE WHEN has_any THEN coalesce(page_type = 'LIGHTING_PLAN', FALSE) ELSE {_BATCH_TEXT} END"""))
def _(s, d):
    rows = classified(s, d).withColumn("page_type", F.when(F.col("document_id") % 3 != 0, F.col("page_type")))
    return classify.plan_pages(rows, R.BATCH_PLAN_PATTERNS, only_unclassified=True).select("doc_id")


@add("pages_irrelevant_null", over_classified("SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE is_relevant END AS r FROM classified) WHERE r IS NULL OR NOT r"))
def _(s, d):
    rows = classified(s, d).withColumn("is_relevant", F.when(F.col("doc_id") % 7 != 0, F.col("is_relevant")))
    return rows.filter(catalog.is_irrelevant()).select("doc_id")


@add("pages_relevant", over_classified("SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE is_relevant END AS r FROM classified) WHERE r"))
def _(s, d):
    return classified(s, d).withColumn("is_relevant", F.when(F.col("doc_id") % 7 != 0, F.col("is_relevant"))).filter("is_relevant").select("doc_id")


@add("sheet_index", f"{with_views('fx_sheets')}, {INDEX_CTES} SELECT * FROM sheet_index")
def _(s, d):
    return classify.index_entries(view(s, d, "fx_sheets"))


_TITLE = with_views("fx_pages")


@add("title_first", f"{_TITLE} SELECT doc_id, {sql_first('title_block', R.TITLE_RULES, R.TITLE_PATTERNS)} AS page_type FROM fx_pages")
def _(s, d):
    return view(s, d, "fx_pages").select("doc_id", classify.title_type(F.col("title_block")).alias("page_type"))


def _last_sql() -> str:
    rows, k = [], 0
    for words, t in R.TITLE_RULES:
        for w in words:
            rows.append(f"SELECT doc_id, {k} AS ord, '{t}' AS type, CASE WHEN contains(low, {q(w)}) THEN length(low) - length(list_last(string_split(low, {q(w)}))) - {len(w)} ELSE -1 END AS place FROM t")
            k += 1
    for p, t in R.TITLE_PATTERNS:
        rows.append(f"SELECT doc_id, {k}, '{t}', CASE WHEN regexp_matches(raw, {q(p)}, 'i') THEN strpos(raw, regexp_extract(raw, {q(p)}, 0, 'i')) - 1 ELSE -1 END FROM t")
        k += 1
    return f"{_TITLE}, t AS (SELECT doc_id, title_block AS raw, lower(title_block) AS low FROM fx_pages), p AS ({' UNION ALL '.join(rows)}), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place DESC, ord) AS r FROM p) SELECT doc_id, CASE WHEN place >= 0 THEN type END AS page_type FROM n WHERE r = 1"


@add("title_last", _last_sql())
def _(s, d):
    return view(s, d, "fx_pages").select("doc_id", classify.title_type_last(F.col("title_block")).alias("page_type"))


@add("desc_type", f"{_TITLE} SELECT doc_id, {sql_first('title_block', R.DESCRIPTION_RULES)} AS page_type FROM fx_pages")
def _(s, d):
    return view(s, d, "fx_pages").select("doc_id", classify.description_type(F.col("title_block")).alias("page_type"))


@add("sheet_code_extract", f"{_TITLE} SELECT doc_id, {sql_code('title_block')} AS sheet_code FROM fx_pages")
def _(s, d):
    return view(s, d, "fx_pages").select("doc_id", classify.sheet_code(F.col("title_block")).alias("sheet_code"))


@add("code_prefix_type", f"{_TITLE} SELECT doc_id, {sql_code_type('raw_code', 'title_block')} AS page_type FROM fx_pages")
def _(s, d):
    return view(s, d, "fx_pages").select("doc_id", classify.code_type(F.col("raw_code"), F.col("title_block")).alias("page_type"))


@add("content_scan", f"{_TITLE}, {sql_content_ctes('fx_pages', 'doc_id', 'extracted_text')} SELECT doc_id, content_type FROM content")
def _(s, d):
    return view(s, d, "fx_pages").select("doc_id", classify.content_type(F.col("extracted_text")).alias("content_type"))


@add("luminaire_test", f"{_TITLE} SELECT doc_id, {sql_luminaire('extracted_text')} AS luminaire FROM fx_pages")
def _(s, d):
    return view(s, d, "fx_pages").select("doc_id", classify.luminaire_schedule(F.col("extracted_text")).alias("luminaire"))


@add("filename_rules", f"{with_views('fx_sheets')} SELECT DISTINCT document_id, {sql_first('filename', R.TITLE_RULES, R.TITLE_PATTERNS)} AS name_type, {sql_code('filename')} AS name_code FROM fx_sheets")
def _(s, d):
    return view(s, d, "fx_sheets").select("document_id", classify.title_type(F.col("filename")).alias("name_type"), classify.sheet_code(F.col("filename")).alias("name_code")).distinct()


@add("title_block_crop", f"{with_views('fx_words')} SELECT document_id, page_number, string_agg(word, ' ' ORDER BY y0, x0, word) AS title_block FROM fx_words WHERE x0 >= CAST(0.55 AS DOUBLE) * 800 AND y0 >= CAST(0.85 AS DOUBLE) * 640 GROUP BY ALL")
def _(s, d):
    return classify.title_block(view(s, d, "fx_words"), WIDTH, HEIGHT)


@add("title_block_tail", "SELECT doc_id, trim(regexp_replace(array_to_string(list_slice(w, len(w) - greatest(1, len(w) // 5) + 1, len(w)), ' '), '\\s+', ' ', 'g')) AS tail FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents)")
def _(s, d):
    lines = F.split("text", "\n")
    n = F.greatest(F.lit(1), F.floor(F.size(lines) / 5).cast("int"))
    tail = F.array_join(F.slice(lines, -n, n), " ")
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.trim(F.regexp_replace(tail, r"\s+", " ")).alias("tail"))


# ---- text quality ----

_G = [r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{FF}]+", r"""[^\pL\pN_\s\.,!?;:()\[\]{}"''\-]+""", r"\b[a-zA-Z]{1}\s[a-zA-Z]{1}\s", r"[0-9]{4,}"]
_GARBLED = "least(1.0, (" + " + ".join(f"coalesce(list_sum(list_transform(regexp_extract_all(text, '{p}'), lambda x: length(x))), 0)" for p in _G).replace("text, '\\b", "regexp_replace(text, '[À-ɏ]', '_', 'g'), '\\b") + ") / length(text))"


@add("garbled_ratio", f"SELECT doc_id, CASE WHEN text = '' THEN 1.0 ELSE {_GARBLED} END AS garbled FROM documents")
def _(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", garbled_ratio(F.col("text")).alias("garbled"))


@add("ocr_decision", f"""
SELECT doc_id, 187 AS threshold, round(length(text) / 93.5, 6) AS density, length(text) / 93.5 < 2.0 OR {_GARBLED} > 0.3 OR (doc_id % 3 = 0 AND length(text) < 30) AS scanned FROM documents""")
def _(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").withColumn("garbled", garbled_ratio(F.col("text")))
    found = classify.ocr_decision(F.col("text"), 8.5 * 72, 11 * 72, F.col("doc_id") % 3 == 0, F.col("garbled"))
    return docs.select("doc_id", found.alias("o")).select("doc_id", "o.threshold", F.round("o.density", 6).alias("density"), "o.scanned")


# ---- catalogue ----

_UP = with_views("fx_uploads")
_NAME = "list_last(string_split(filename, '/'))"
_SAFE = f"substr(coalesce(nullif(trim(regexp_replace(regexp_replace({_NAME}, '[.][^.]*$', ''), '[^\\pL\\pN_\\-. ]', '_', 'g')), ''), 'file'), 1, 100) || regexp_extract({_NAME}, '[.][^.]*$')"
_UPLOADS = f"""{_UP}, basic AS (
  SELECT *, {_SAFE} AS name, lower(regexp_extract(filename, '[.][^.]*$')) AS kind, strlen(content) AS size, sha256(content) AS hash FROM fx_uploads),
judged AS (SELECT *, CASE WHEN kind NOT IN ('.pdf', '.zip') THEN 'type' WHEN size = 0 THEN 'empty' WHEN size > 104857600 THEN 'size' END AS basic FROM basic),
nth AS (SELECT *, row_number() OVER (PARTITION BY owner_id, hash, basic IS NULL ORDER BY upload_seq) AS nth FROM judged),
uploads AS (SELECT *, coalesce(basic, CASE WHEN nth > 1 THEN 'duplicate' END) AS reject FROM nth)"""


@add("upload_dedup", f"{_UPLOADS} SELECT upload_seq, owner_id, name, kind, hash FROM uploads WHERE reject IS NULL")
def _(s, d):
    return catalog.uploads(view(s, d, "fx_uploads")).filter("reject is null").select("upload_seq", "owner_id", "name", "kind", "hash")


@add("upload_validation", f"{_UPLOADS} SELECT owner_id, coalesce(reject, 'taken') AS verdict, count(*) AS uploads, CAST(sum(size) AS BIGINT) AS bytes FROM uploads GROUP BY ALL")
def _(s, d):
    rows = catalog.uploads(view(s, d, "fx_uploads"))
    return rows.groupBy("owner_id", F.coalesce("reject", F.lit("taken")).alias("verdict")).agg(F.count(F.lit(1)).alias("uploads"), F.sum("size").alias("bytes"))


_ODD = "concat(CASE doc_id % 5 WHEN 0 THEN '../../' WHEN 1 THEN 'a/b/' ELSE '' END, substr(text, 1, CAST(doc_id % 130 AS INT)), '.pdf')"


@add("filename_sanitize", f"SELECT doc_id, {_SAFE.replace('[.][^.]*$', '[.]pdf$')} AS name FROM (SELECT doc_id, replace({_ODD}, '.', CASE WHEN doc_id % 2 = 0 THEN '.' ELSE '_' END) || '.pdf' AS filename FROM documents)")
def _(s, d):
    name = F.expr(f"concat(replace({_ODD}, '.', CASE WHEN doc_id % 2 = 0 THEN '.' ELSE '_' END), '.pdf')")
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", safe_filename(name).alias("name"))


_B = with_views("fx_batch_docs")


@add("list_documents_page", f"{_B} SELECT document_id, upload_time, status FROM fx_batch_docs WHERE owner_id = 3 ORDER BY upload_time DESC, document_id DESC LIMIT 50 OFFSET 20")
def _(s, d):
    return catalog.newest(view(s, d, "fx_batch_docs"), 3, skip=20, limit=50).select("document_id", "upload_time", "status")


@add("batch_all_completed", f"{_B} SELECT batch_id, count(*) AS documents, bool_and(status = 'completed') AS all_completed, count(*) FILTER (WHERE file_type = 'pdf' AND status <> 'completed') AS pdf_not_done FROM fx_batch_docs GROUP BY batch_id")
def _(s, d):
    return catalog.batches(view(s, d, "fx_batch_docs")).drop("document_ids")


@add("batch_documents", f"{_B} SELECT batch_id, list(document_id ORDER BY upload_time, document_id) AS document_ids FROM fx_batch_docs GROUP BY batch_id")
def _(s, d):
    return catalog.batches(view(s, d, "fx_batch_docs")).select("batch_id", "document_ids")


@add("batch_siblings", f"{_B} SELECT a.batch_id, a.document_id, b.document_id AS sibling_id, b.status AS sibling_status FROM fx_batch_docs a JOIN fx_batch_docs b USING (batch_id)")
def _(s, d):
    return catalog.siblings(view(s, d, "fx_batch_docs"))


@add("owner_roll_up", "SELECT n.n_name, c.c_mktsegment, count(*) AS documents, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY ROLLUP (n.n_name, c.c_mktsegment)")
def _(s, d):
    t = lambda n: s.read.parquet(f"{d}/{n}.parquet")
    rows = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.rollup("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("documents"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_PAGES_BATCH = with_views("fx_pages", "fx_batch_docs")


@add("batch_page_merge", f"{_PAGES_BATCH} SELECT p.doc_id, b.batch_id, row_number() OVER (PARTITION BY b.batch_id ORDER BY b.upload_time, p.document_id, p.page_number) AS merged_page FROM fx_pages p JOIN fx_batch_docs b ON b.document_id = p.document_id")
def _(s, d):
    return catalog.batch_merge(view(s, d, "fx_pages"), view(s, d, "fx_batch_docs")).select("doc_id", "batch_id", "merged_page")


@add("pages_kept_after_delete", f"{_PAGES_BATCH} SELECT doc_id FROM fx_pages p WHERE NOT EXISTS (SELECT 1 FROM fx_batch_docs b WHERE b.document_id = p.document_id AND b.status = 'failed')")
def _(s, d):
    return catalog.without(view(s, d, "fx_pages"), view(s, d, "fx_batch_docs").filter("status = 'failed'")).select("doc_id")


@add("page_update", f"{with_views('fx_sheets')}, {CLASSIFY_CTES} SELECT c.doc_id, CASE WHEN c.doc_id % 4 = 0 THEN 'DETAIL' ELSE c.page_type END AS page_type, CASE WHEN c.doc_id % 4 = 0 THEN FALSE ELSE c.is_relevant END AS is_relevant, c.sheet_code, c.confidence_source FROM classified c")
def _(s, d):
    pages = classified(s, d).select("doc_id", "document_id", "page_number", "page_type", "is_relevant", "sheet_code", "confidence_source")
    none = F.lit(None).cast("string")
    changes = view(s, d, "fx_sheets").filter("doc_id % 4 = 0").select("document_id", "page_number", F.lit("DETAIL").alias("page_type"), F.lit(False).alias("is_relevant"), none.alias("sheet_code"), none.alias("confidence_source"))
    return catalog.update_pages(pages, changes).select("doc_id", "page_type", "is_relevant", "sheet_code", "confidence_source")


# ---- replies ----

#: A reply that is one object is read as JSON; of others the last string given for a key.
_SCRAPE = lambda k: f"""CASE WHEN json_valid(reply_text) THEN json_extract_string(reply_text, '$.{k}') ELSE regexp_extract_all(reply_text, '"{k}"\\s*:\\s*"([^"]*)"', 1)[-1] END"""
_TYPES = ", ".join(q(t) for t in R.PAGE_TYPES)
_REPLIES = f"""replies AS (
  SELECT document_id, page_number, CASE WHEN NOT contains(reply_text, '{{') THEN NULL WHEN kind IN ({_TYPES}) THEN kind ELSE 'OTHER' END AS vlm_page_type,
         CASE WHEN NOT contains(reply_text, '{{') THEN NULL WHEN sure IN ('high', 'medium', 'low') THEN sure ELSE 'low' END AS vlm_confidence
  FROM (SELECT document_id, page_number, reply_text, upper(trim({_SCRAPE("page_type")})) AS kind, lower(trim(coalesce({_SCRAPE("confidence")}, 'low'))) AS sure FROM fx_replies))"""


@add("reply_parse", f"{with_views('fx_replies')}, {_REPLIES} SELECT * FROM replies")
def _(s, d):
    r = verify.parse(F.col("reply_text"))
    return view(s, d, "fx_replies").select("document_id", "page_number", r.alias("r")).select("document_id", "page_number", F.col("r.page_type").alias("vlm_page_type"), F.col("r.confidence").alias("vlm_confidence"))


_MERGED = f"""{with_views("fx_sheets", "fx_replies")}, {CLASSIFY_CTES}, {_REPLIES},
verified AS (
  SELECT c.document_id, c.page_number, c.doc_id, r.vlm_page_type, r.vlm_confidence, r.vlm_page_type = c.page_type AS vlm_agrees,
         CASE WHEN r.vlm_page_type <> c.page_type AND r.vlm_confidence = 'high' THEN r.vlm_page_type ELSE c.page_type END AS page_type,
         CASE WHEN r.vlm_page_type <> c.page_type AND r.vlm_confidence = 'high' THEN r.vlm_page_type IN ('LIGHTING_PLAN', 'SYMBOLS_LEGEND', 'COVER', 'SCHEDULE')
              WHEN r.vlm_page_type = c.page_type AND c.page_type = 'SCHEDULE' THEN TRUE ELSE c.is_relevant END AS is_relevant,
         CASE WHEN r.vlm_page_type <> c.page_type AND r.vlm_confidence = 'high' THEN 'vlm_override' ELSE c.confidence_source END AS confidence_source
  FROM classified c LEFT JOIN replies r USING (document_id, page_number))"""


def _verified(s, d):
    return verify.merge(classified(s, d), view(s, d, "fx_replies"))


@add("verify_merge", f"{_MERGED} SELECT doc_id, page_type, is_relevant, confidence_source, vlm_page_type, vlm_confidence, vlm_agrees FROM verified")
def _(s, d):
    return _verified(s, d).select("doc_id", "page_type", "is_relevant", "confidence_source", "vlm_page_type", "vlm_confidence", "vlm_agrees")


@add("verify_tallies", f"{_MERGED} SELECT document_id, count(*) FILTER (WHERE vlm_agrees) AS agree, count(*) FILTER (WHERE NOT vlm_agrees) AS disagree, count(*) FILTER (WHERE vlm_agrees IS NULL) AS skipped, count(*) FILTER (WHERE confidence_source = 'vlm_override') AS overridden FROM verified GROUP BY document_id")
def _(s, d):
    return verify.tallies(_verified(s, d))


@add("table_verify_merge", f"""{with_views("fx_pages", "fx_replies")}, {_REPLIES}
SELECT f.document_id, f.page_number, r.vlm_page_type AS answer, coalesce(r.vlm_page_type = 'SCHEDULE', TRUE) AS kept
FROM (SELECT document_id, min(page_number) AS page_number FROM fx_pages WHERE contains(title_block, 'SCHEDULE') GROUP BY document_id) f LEFT JOIN replies r USING (document_id, page_number)""")
def _(s, d):
    pages = view(s, d, "fx_pages").filter(F.contains("title_block", F.lit("SCHEDULE")))
    return verify.table_verdict(pages, view(s, d, "fx_replies"))
