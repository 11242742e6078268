"""Registered queries on listings, reports, combined text and replies with lists, and their SQL, written apart from the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from planweave.functions import text as T
from planweave.operators import catalog, classify, grid, sections, verify
from planweave.operators import rules as R
from planweave.plans.fixtures import view, with_views
from planweave.plans.pages import INDEX_CTES, classified, over_classified, q, sql_first
from planweave.plans.tables import _CLASSIFY, _ON_PAGES, _PARSED, _TABLES_L, ROWS, rows
from planweave.sources import files

QUERIES, SQL = {}, {}


def add(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


# ---- pages ----


@add("page_list", over_classified("""SELECT document_id, page_number, page_type FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS n FROM classified WHERE NOT coalesce(is_relevant, FALSE)) WHERE n BETWEEN 2 AND 4"""))
def _(s, d):
    return catalog.page_list(classified(s, d), skip=1, limit=3, relevance="irrelevant").select("document_id", "page_number", "page_type")


@add("page_view", f"{with_views('fx_sheets')} SELECT doc_id, ocr_used AS vlm_used, length(extracted_text) AS text_length FROM fx_sheets")
def _(s, d):
    return catalog.page_view(view(s, d, "fx_sheets")).select("doc_id", "vlm_used", "text_length")


@add("classify_errors", over_classified("""SELECT doc_id, coalesce(sheet_code, CASE WHEN doc_id % 9 = 0 THEN '' END) AS sheet_code, CASE WHEN doc_id % 9 = 0 THEN 'OTHER' ELSE page_type END AS page_type,
  is_relevant AND doc_id % 9 <> 0 AS is_relevant, CASE WHEN doc_id % 9 = 0 THEN 'error' ELSE confidence_source END AS confidence_source FROM classified"""))
def _(s, d):
    return classify.with_errors(classified(s, d), F.col("doc_id") % 9 == 0).select("doc_id", "sheet_code", "page_type", "is_relevant", "confidence_source")


@add("schedule_override", f"""{_ON_PAGES} SELECT c.doc_id, c.is_relevant OR t.document_id IS NOT NULL AS is_relevant, t.document_id IS NOT NULL AS has_fixture_schedule
FROM classified c LEFT JOIN (SELECT DISTINCT document_id, page_number FROM tables_t WHERE is_fixture_schedule) t ON t.document_id = c.document_id AND t.page_number = c.page_number""")
def _(s, d):
    found = grid.classify_tables(rows(s, d)).filter("is_fixture_schedule")
    return classify.schedule_override(classified(s, d), found).select("doc_id", "is_relevant", "has_fixture_schedule")


_TEXTS = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS native, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN concat(text, 'x') ELSE lang END AS ocr, CASE WHEN doc_id % 5 < 3 THEN concat(text, source) ELSE '' END AS enhanced, doc_id % 2 = 0 AS mode FROM documents"


@add("best_text", f"""SELECT doc_id, md5(CASE WHEN length(o) > length(native) THEN o ELSE native END) AS digest, length(o) > length(native) AS ocr_used
FROM (SELECT *, CASE WHEN mode AND 2 * length(ocr) < length(native) AND length(enhanced) > length(ocr) THEN enhanced ELSE ocr END AS o FROM ({_TEXTS}))""")
def _(s, d):
    s.read.parquet(f"{d}/documents.parquet").createOrReplaceTempView("documents")
    df = s.sql(_TEXTS)
    best = classify.best_text(F.col("native"), F.col("ocr"), F.col("enhanced"), F.col("mode"))
    return df.select("doc_id", best.alias("b")).select("doc_id", F.md5(F.col("b.text").cast("binary")).alias("digest"), "b.ocr_used")


_INDEX_2 = INDEX_CTES.replace("fx_sheets", "fx_pages").replace("index_first AS (", "text_first AS (").split("sheet_index AS (")[0].rstrip().rstrip(",")


@add("sheet_index_tables", f"""{ROWS.replace('WITH RECURSIVE ', with_views('fx_pages') + ', ', 1)}, {_INDEX_2},
table_first AS (
  SELECT r.document_id, p.rank, upper(trim(cells[1])) AS sheet_code, trim(cells[2]) AS description, row_number() OVER (PARTITION BY r.document_id ORDER BY r.table_index, r.row_idx) AS place
  FROM rows_t r JOIN ranked_pages p ON p.document_id = r.document_id AND p.page_number = r.page_number
  WHERE p.rank IS NOT NULL AND r.row_idx > 0 AND regexp_matches(upper(trim(cells[1])), '^(CS|[A-Z]{{1,2}}\\d{{1,4}}([.\\-]\\d{{1,3}})?[A-Z]?)\\b') AND trim(cells[2]) <> ''),
both_sources AS (SELECT document_id, rank, 0 AS source, place, sheet_code, description FROM text_first UNION ALL SELECT document_id, rank, 1, place, sheet_code, description FROM table_first),
picked AS (SELECT *, min(CAST(rank AS BIGINT) * 2 + source) OVER (PARTITION BY document_id) = CAST(rank AS BIGINT) * 2 + source AS chosen FROM both_sources)
SELECT document_id, sheet_code, description, {sql_first("description", R.DESCRIPTION_RULES)} AS index_type
FROM (SELECT *, row_number() OVER (PARTITION BY document_id, sheet_code ORDER BY place DESC) AS n FROM picked WHERE chosen) WHERE n = 1""")
def _(s, d):
    return classify.index_entries(view(s, d, "fx_pages"), rows(s, d))


@add("page_range", over_classified("SELECT document_id, list_sort(list(page_number) FILTER (WHERE is_relevant AND page_number BETWEEN 2 AND 5)) AS pages FROM classified GROUP BY document_id HAVING count(*) FILTER (WHERE is_relevant AND page_number BETWEEN 2 AND 5) > 0"))
def _(s, d):
    found = catalog.summary(classified(s, d)).select("document_id", F.array_intersect("relevant_pages", F.sequence(F.lit(2), F.lit(5))).alias("pages"))
    return found.filter(F.size("pages") > 0)


# ---- documents ----

_B = with_views("fx_batch_docs")
_COMMAND = "CASE document_id % 5 WHEN 0 THEN 'takeoff' WHEN 1 THEN 'reprocess' WHEN 2 THEN 'rerun' WHEN 3 THEN 'tables' ELSE 'list' END"


@add("document_lookup", f"{_B} SELECT r.document_id, r.owner_id, d.status, d.document_id IS NOT NULL AS found FROM (SELECT document_id, document_id % 10 AS owner_id FROM fx_batch_docs) r LEFT JOIN fx_batch_docs d ON d.document_id = r.document_id AND d.owner_id = r.owner_id")
def _(s, d):
    docs = view(s, d, "fx_batch_docs")
    return catalog.lookup(docs.select("document_id", (F.col("document_id") % 10).alias("owner_id")), docs).select("document_id", "owner_id", "status", "found")


@add("command_status", f"""{_B} SELECT document_id, CASE WHEN c IN ('reprocess', 'rerun') AND status = 'processing' THEN 409 WHEN c IN ('takeoff', 'tables') AND status <> 'completed' THEN 400 ELSE 200 END AS code
FROM (SELECT document_id, status, {_COMMAND} AS c FROM fx_batch_docs)""")
def _(s, d):
    df = view(s, d, "fx_batch_docs").withColumn("command", F.expr(_COMMAND))
    return df.select("document_id", catalog.command_status(F.col("command"), F.col("status"), F.col("status") == "completed").alias("code"))


@add("render_info", f"""{_B}, pdf AS (SELECT batch_id, list(document_id ORDER BY upload_time, document_id) AS pdfs, bool_and(status = 'completed') AS done FROM fx_batch_docs WHERE file_type = 'pdf' GROUP BY batch_id)
SELECT z.document_id, z.batch_id, p.batch_id IS NOT NULL AS extraction_done, coalesce(p.done, TRUE) AS processing_completed, coalesce(p.pdfs, []) AS pdfs FROM fx_batch_docs z LEFT JOIN pdf p USING (batch_id) WHERE z.file_type = 'zip'""")
def _(s, d):
    return catalog.render_info(view(s, d, "fx_batch_docs"))


@add("artifacts", f"""{with_views('fx_files')} SELECT document_id, count(*) FILTER (WHERE regexp_matches(path, '^images/.*[.]png$')) AS images, bool_or(path = 'text/full_text.txt') AS has_text, bool_or(path = 'tables_all.json') AS has_tables,
  bool_or(path = 'lighting_schedule.csv') AS schedule_found, CASE WHEN bool_or(path = 'tables_all.json') THEN 'docling' ELSE 'legacy' END AS engine FROM fx_files GROUP BY document_id""")
def _(s, d):
    return catalog.artifacts(view(s, d, "fx_files"))


@add("verdict_tallies", f"{_B} SELECT count(*) FILTER (WHERE status = 'completed') AS pass, count(*) FILTER (WHERE status = 'failed') AS fail, count(*) FILTER (WHERE status = 'processing') AS warn FROM fx_batch_docs")
def _(s, d):
    verdict = F.when(F.col("status") == "completed", "PASS").when(F.col("status") == "failed", "FAIL").otherwise("WARN")
    return catalog.verdicts(view(s, d, "fx_batch_docs").select(verdict.alias("verdict")))


_PATH = "concat('/data//', CAST(o_custkey AS STRING), CASE o_orderkey % 5 WHEN 0 THEN '/a/../b.png' WHEN 1 THEN '/../../etc/passwd' WHEN 2 THEN '/./x/y/../../z.png' WHEN 3 THEN '/../7/k.png' ELSE '/p.png' END)"


def _sql_normal(c: str) -> str:
    c = f"replace(replace({c}, '//', '/'), '/./', '/')"
    for _ in range(3):  # enough for these paths
        c = f"regexp_replace({c}, '(/[^/.]+)?/[.][.](/|$)', '\\2')"
    return c


@add("path_inside", f"SELECT o_orderkey, {_sql_normal(_PATH)} AS path, starts_with({_sql_normal(_PATH)}, concat('/data/', CAST(o_custkey AS STRING), '/')) AS inside FROM orders")
def _(s, d):
    df = s.read.parquet(f"{d}/orders.parquet").withColumn("path", F.expr(_PATH))
    root = F.concat(F.lit("/data/"), F.col("o_custkey").cast("string"))
    return df.select("o_orderkey", T.normal_path(F.col("path")).alias("path"), T.inside(F.col("path"), root).alias("inside"))


_USER = "concat(CASE c_custkey % 3 WHEN 0 THEN ' ' ELSE c_name END, CASE c_custkey % 2 WHEN 0 THEN '@ex.org' ELSE '@ex' END)"
_PASS = "concat(CASE c_custkey % 4 WHEN 0 THEN 'Ab1' WHEN 1 THEN 'ab' ELSE 'XY' END, c_mktsegment, CAST(c_custkey % 7 AS STRING), CASE WHEN c_custkey % 5 = 0 THEN 'z' ELSE '' END)"


@add("user_validation", f"""SELECT c_custkey, length(trim(c_name)) >= 2 AS name_ok, length(p) >= 8 AND regexp_matches(p, '[A-Z]') AND regexp_matches(p, '[a-z]') AND regexp_matches(p, '[0-9]') AS password_ok,
  regexp_matches(u, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{{2,}}$') AS email_ok FROM (SELECT *, {_USER} AS u, {_PASS} AS p FROM customer)""")
def _(s, d):
    df = s.read.parquet(f"{d}/customer.parquet").withColumns({"u": F.expr(_USER), "p": F.expr(_PASS)})
    return df.select("c_custkey", T.valid_name(F.col("c_name")).alias("name_ok"), T.valid_password(F.col("p")).alias("password_ok"), T.valid_email(F.col("u")).alias("email_ok"))


@add("file_names", """SELECT o_orderkey, printf('page_%04d.png', o_orderkey) AS image, printf('table_%03d.csv', o_orderkey) AS table_file,
  concat(h[1:8], '-', h[9:12], '-4', h[14:16], '-a', h[18:20], '-', h[21:32]) AS stable_id FROM (SELECT o_orderkey, md5('{"p0":' || o_orderkey || ',"p1":"' || o_orderstatus || '"}') AS h FROM orders)""")
def _(s, d):
    key = F.col("o_orderkey")
    return s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", T.numbered("page", key, 4, ".png").alias("image"), T.numbered("table", key, 3, ".csv").alias("table_file"), T.stable_uuid(key, F.col("o_orderstatus")).alias("stable_id"))


# ---- reports over tables ----


@add("keynotes", f"""{with_views('fx_sheets', 'fx_notes')}, {over_classified('')[len(with_views('fx_sheets')) + 2:].rstrip()},
noted AS (SELECT document_id, page_number, list({{'number': number, 'text': text, 'section': section}} ORDER BY number, text, section) AS notes FROM fx_notes GROUP BY ALL)
SELECT c.document_id, c.page_number, nullif(c.sheet_code, '') AS sheet_code, c.page_type, list_transform(n.notes, lambda x: concat(x.number, '|', x.text, '|', x.section)) AS notes
FROM classified c JOIN noted n ON n.document_id = c.document_id AND n.page_number = c.page_number WHERE c.page_type = 'LIGHTING_PLAN' AND c.is_relevant""")
def _(s, d):
    found = catalog.keynotes(view(s, d, "fx_notes"), classified(s, d))
    return found.withColumn("notes", F.transform("notes", lambda x: F.concat_ws("|", x["number"], x["text"], x["section"])))


_NOT_REFUSED = "NOT EXISTS (SELECT 1 FROM refused x WHERE x.document_id = r.document_id AND x.table_index = r.table_index)"
_OF_SCHEDULES = "EXISTS (SELECT 1 FROM tables_t x WHERE x.is_fixture_schedule AND x.document_id = r.document_id AND x.table_index = r.table_index)"
assert _NOT_REFUSED in _PARSED
_SHEETS_TOO = _ON_PAGES[: _ON_PAGES.index("rows_t AS")]


def _on_pages(ctes: str) -> str:
    """Statements over the tables with the classified pages before them."""
    return _ON_PAGES + ctes[len(_CLASSIFY) :]


@add("fixture_report", f"""{_on_pages(_PARSED.replace(_NOT_REFUSED, _OF_SCHEDULES))},
scanned AS (
  SELECT document_id, count(*) FILTER (WHERE page_type = 'SCHEDULE' AND is_relevant) AS schedule_pages, count(*) FILTER (WHERE page_type = 'LIGHTING_PLAN') AS plan_pages,
         coalesce(list_sort(list(DISTINCT sheet_code) FILTER (WHERE page_type = 'SCHEDULE' AND is_relevant AND sheet_code <> '')), []) AS sheet_codes FROM classified GROUP BY document_id),
of_code AS (SELECT document_id, count(DISTINCT lower(trim(code))) AS fixtures FROM fixtures_t GROUP BY document_id)
SELECT s.*, coalesce(o.fixtures, 0) AS fixtures FROM scanned s LEFT JOIN of_code o USING (document_id)""")
def _(s, d):
    cells = rows(s, d)
    own = grid.classify_tables(cells).filter("is_fixture_schedule").select(*grid.KEY)
    records = grid.fixtures(cells.join(own, grid.KEY, "left_semi"), filtered=False)
    return catalog.fixture_report(classified(s, d), records)


_FX = ["document_id", "table_index", "page_number", "row_idx", *R.FIELDS]


@add("fixtures_extract", f"""{_on_pages(_PARSED)},
typed_fx AS (SELECT f.*, c.page_type, max(CASE WHEN c.page_type = 'SCHEDULE' THEN 1 ELSE 0 END) OVER (PARTITION BY f.document_id) AS own FROM fixtures_t f LEFT JOIN classified c ON c.document_id = f.document_id AND c.page_number = f.page_number),
scheduled AS (SELECT * FROM typed_fx WHERE own = 0 OR page_type = 'SCHEDULE'),
planned AS (SELECT * FROM typed_fx p WHERE own = 1 AND page_type = 'LIGHTING_PLAN' AND NOT EXISTS (SELECT 1 FROM scheduled s WHERE s.document_id = p.document_id AND lower(trim(s.code)) = lower(trim(p.code)))),
united AS (SELECT * FROM scheduled UNION ALL SELECT * FROM planned)
SELECT {", ".join(_FX)} FROM (SELECT *, row_number() OVER (PARTITION BY document_id, lower(trim(code)) ORDER BY page_number, table_index, row_idx) AS n FROM united) WHERE n = 1 OR trim(code) = ''""")
def _(s, d):
    return grid.extract(grid.fixtures(rows(s, d)).drop("raw_data"), classified(s, d)).select(*_FX)


def _model_records(s, d):
    """Records of every fourth table, told of a page further on."""
    return grid.fixtures(rows(s, d)).drop("raw_data").filter("table_index = 3").withColumn("page_number", F.col("page_number") + 2)


@add("model_tables", f"""{_on_pages(_PARSED)},
model AS (SELECT DISTINCT document_id, page_number + 2 AS page_number, 1 AS more FROM fixtures_t WHERE table_index = 3),
counted AS (SELECT document_id, page_number, count(*) AS tables, count(*) FILTER (WHERE is_fixture_schedule) AS fixture_tables FROM tables_t GROUP BY ALL),
both_t AS (SELECT coalesce(c.document_id, m.document_id) AS document_id, coalesce(c.page_number, m.page_number) AS page_number, coalesce(tables, 0) + coalesce(more, 0) AS tables, coalesce(fixture_tables, 0) + coalesce(more, 0) AS fixture_tables
           FROM counted c FULL JOIN model m ON m.document_id = c.document_id AND m.page_number = c.page_number)
SELECT b.*, coalesce(p.page_type, '') AS page_type, coalesce(p.sheet_code, '') AS sheet_code FROM both_t b LEFT JOIN classified p ON p.document_id = b.document_id AND p.page_number = b.page_number""")
def _(s, d):
    return grid.with_model_tables(grid.classify_tables(rows(s, d)), _model_records(s, d), classified(s, d))


_MODEL = ("code", "description", "fixture_style", "voltage", "mounting", "lumens", "cct", "dimming", "max_va")


@add("synthetic_grid", f"""{_PARSED}, model AS (SELECT *, page_number + 2 AS page FROM fixtures_t WHERE table_index = 3)
SELECT DISTINCT document_id, -1 AS table_index, page AS page_number, 0 AS row_idx, [{", ".join(map(q, _MODEL))}] AS cells FROM model UNION ALL
SELECT document_id, -1, page, row_number() OVER (PARTITION BY document_id, page ORDER BY row_idx), [{", ".join(_MODEL)}] FROM model""")
def _(s, d):
    return grid.synthetic_grid(_model_records(s, d))


@add("kept_grids", f"""{ROWS} SELECT document_id, table_index, row_idx FROM (SELECT *, count(*) OVER w AS n, max(len(list_filter(cells, lambda c: trim(c) <> ''))) OVER w AS filled FROM rows_t WINDOW w AS (PARTITION BY document_id, table_index)) WHERE n >= 2 AND filled > 0""")
def _(s, d):
    return grid.kept_grids(rows(s, d)).select("document_id", "table_index", "row_idx")


_HEADS = "p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'FIXTURE TABLE.NOTES.' WHEN 1 THEN 'FIX.' WHEN 2 THEN 'FIXTURE TABLE NOTES ' ELSE 'FIXTURE TABLE.' END AS prefix, [p_brand, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_type END, concat('Z', p_name)] AS own"


@add("column_prefix", f"""SELECT p_partkey, CASE WHEN p_partkey % 4 IN (1, 2) THEN list_transform(own, lambda x: prefix || x) ELSE list_transform([1, 2, 3], lambda i: CASE WHEN trim(own[i]) = '' THEN 'Column_' || (i - 1) ELSE own[i] END) END AS names
FROM (SELECT {_HEADS} FROM part)""")
def _(s, d):
    heads = _HEADS.replace("[p_brand", "array(p_brand").replace("p_name)]", "p_name))")
    df = s.read.parquet(f"{d}/part.parquet").selectExpr(*heads.split(", CASE p", 1)[:1], "CASE p" + heads.split(", CASE p", 1)[1].split(", array(", 1)[0], "array(" + heads.split(", array(", 1)[1])
    names = F.transform("own", lambda x: F.concat("prefix", x))
    return df.select("p_partkey", grid.prefix_stripped(names).alias("names"))


# ---- combined text ----


def _combined(own_text: bool) -> str:
    page = "page_number" if own_text else "1"
    blank = "every" if own_text else "(SELECT * FROM every WHERE page = 1)"
    fence = "repeat('=', 60)"
    return f"""{ROWS.replace('WITH RECURSIVE ', with_views('fx_pages') + ', ', 1)},
every AS (SELECT document_id, unnest(range(1, max(page_number) + 1)) AS page FROM fx_pages GROUP BY document_id),
sized AS (SELECT document_id, table_index, page_number AS page, count(*) AS n FROM rows_t GROUP BY ALL),
titled AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page, table_index) AS nth FROM sized SEMI JOIN every USING (document_id, page)),
parts AS (
  SELECT document_id, page, 0 AS part, 0 AS sub, k, CASE k WHEN 2 THEN concat('=== PAGE ', page, ' ===') WHEN 1 THEN {fence} WHEN 3 THEN {fence} ELSE '' END AS line FROM every, range(5) AS r(k)
  UNION ALL SELECT document_id, {page}, 1, page_number, generate_subscripts(string_split(extracted_text, chr(10)), 1), unnest(string_split(extracted_text, chr(10))) FROM fx_pages
  UNION ALL SELECT document_id, page, 2, 0, 0, '' FROM {blank}
  UNION ALL SELECT document_id, page, 3, nth, k, CASE k WHEN 0 THEN '' WHEN 1 THEN concat('TABLE ', nth, ' (', n, ' rows)') WHEN 2 THEN {fence} WHEN 1000000 THEN {fence} ELSE '' END FROM titled, (VALUES (0), (1), (2), (1000000), (1000001)) AS r(k)
  UNION ALL SELECT r.document_id, t.page, 3, t.nth, 3 + r.row_idx, array_to_string(list_transform(cells, lambda c: CASE WHEN regexp_matches(c, '[",\\n]') THEN concat('"', replace(c, '"', '""'), '"') ELSE c END), ',')
    FROM rows_t r JOIN titled t ON t.document_id = r.document_id AND t.table_index = r.table_index
  UNION ALL SELECT document_id, page, 4, 0, k, CASE k WHEN 0 THEN '' ELSE repeat('─', 40) END FROM every, range(2) AS r(k))
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY page, part, sub, k) AS line_no, line FROM parts"""


@add("combined_text", _combined(False))
def _(s, d):
    return files.combined_lines(view(s, d, "fx_pages"), rows(s, d))


@add("combined_text_pages", _combined(True))
def _(s, d):
    return files.combined_lines(view(s, d, "fx_pages"), rows(s, d), text_per_page=True)


@add("schedule_csv", f"""{_TABLES_L}, tiered AS (SELECT *, CASE WHEN is_fixture AND NOT is_index THEN 3 WHEN NOT is_index THEN 2 ELSE 1 END AS tier FROM candidates),
pages_t AS (SELECT document_id, coalesce(list(page ORDER BY seg) FILTER (WHERE tier = 3 AND page > 0), []) AS p3, coalesce(list(page ORDER BY seg) FILTER (WHERE NOT is_index AND page > 0), []) AS p2 FROM tiered GROUP BY document_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY tier DESC, n_lines DESC, seg) AS n FROM tiered) WHERE n = 1)
SELECT document_id, body AS csv, CASE tier WHEN 3 THEN p3 WHEN 2 THEN p2 ELSE CASE WHEN page > 0 THEN [page] ELSE [] END END AS pages FROM top JOIN pages_t USING (document_id)""")
def _(s, d):
    return sections.schedule_csv(view(s, d, "fx_lines"))


# ---- replies with lists ----


@add("reply_fixtures", f"""{with_views('fx_lists')} SELECT reply_id, nth, CASE nth WHEN 0 THEN code ELSE 'B1' END AS code, CASE nth WHEN 0 THEN concat(told, ' {{x}}') ELSE '' END AS description, CASE nth WHEN 0 THEN '' ELSE '277V' END AS voltage
FROM fx_lists, (VALUES (0), (1)) AS n(nth)""")
def _(s, d):
    df = view(s, d, "fx_lists").select("reply_id", F.posexplode(verify.fixture_records(F.col("reply_text"))).alias("nth", "r"))
    return df.select("reply_id", "nth", "r.code", "r.description", "r.voltage")


@add("reply_array", f"{with_views('fx_lists')} SELECT reply_id, CASE WHEN reply_id % 3 = 0 THEN NULL ELSE reply_text[strpos(reply_text, '['):length(reply_text) - 6] END AS items FROM fx_lists")
def _(s, d):
    return view(s, d, "fx_lists").select("reply_id", verify.json_array(F.col("reply_text")).alias("items"))
