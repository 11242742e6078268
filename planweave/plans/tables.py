"""Registered queries on grids, line streams and takeoff, and their SQL, written apart from the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from planweave.operators import grid, sections, takeoff
from planweave.operators import rules as R
from planweave.plans.fixtures import view, with_views
from planweave.plans.pages import CLASSIFY_CTES, HEIGHT, WIDTH, classified, q, sql_any

#: Codes that the takeoff looks for, longest first and then in order.
CODES = ("AA1", "A1", "B0", "B1", "B2", "B3")

QUERIES, SQL = {}, {}


def add(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def rows(s, d):
    return grid.rows_of(view(s, d, "fx_cells"))


# ---- SQL for the header score: nine statements, one per field ----


def sql_fit(cell: str, aliases) -> str:
    return "(" + " OR ".join(f"{cell} = {q(a)}" if exact else f"contains({cell}, {q(a)})" for a, exact in aliases) + ")"


def sql_scored(name: str, source: str) -> str:
    """name over source(document_id, table_index, row_idx, cells, ...): c_<field> (from 0), score, n_fields."""
    out = f"{name}_0 AS (SELECT *, list_transform(cells, lambda c: lower(trim(regexp_replace(c, '\\s+', ' ', 'g')))) AS low, CAST([] AS INTEGER[]) AS used FROM {source})"
    for k, (field, aliases) in enumerate(R.ALIASES):
        pick = f"list_filter(CAST(range(1, len(low) + 1) AS INTEGER[]), lambda i: low[i] <> '' AND NOT list_contains(used, i) AND {sql_fit('low[i]', aliases)})[1]"
        out += f",\n{name}_{k + 1} AS (SELECT * EXCLUDE (used, hit), hit - 1 AS c_{field}, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END AS used FROM (SELECT *, {pick} AS hit FROM {name}_{k}))"
    worth = " + ".join(f"CASE WHEN c_{f} IS NULL THEN 0 ELSE {3 if f in R.STRONG_FIELDS else 1} END" for f in R.FIELDS)
    n = " + ".join(f"CASE WHEN c_{f} IS NULL THEN 0 ELSE 1 END" for f in R.FIELDS)
    return out + f",\n{name} AS (SELECT * EXCLUDE (used, low), {worth} AS score, {n} AS n_fields FROM {name}_9)"


ROWS = f"{with_views('fx_cells')}, rows_t AS (SELECT document_id, table_index, page_number, row_idx, list(coalesce(text, '') ORDER BY col_idx) AS cells FROM fx_cells GROUP BY ALL)"


def sql_header(source: str) -> str:
    """header over source: best of the first ten rows and their pairs."""
    return f"""h_num AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, table_index ORDER BY row_idx) AS k FROM {source}) WHERE k <= 10),
h_pair AS (SELECT *, lead(cells) OVER (PARTITION BY document_id, table_index ORDER BY row_idx) AS nxt FROM h_num),
h_try AS (
  SELECT document_id, table_index, row_idx, cells, FALSE AS merged FROM h_num UNION ALL
  SELECT document_id, table_index, row_idx, list_transform(CAST(range(1, greatest(len(cells), len(nxt)) + 1) AS INTEGER[]), lambda i: trim(concat(trim(coalesce(cells[i], '')), CASE WHEN trim(coalesce(cells[i], '')) <> '' AND trim(coalesce(nxt[i], '')) <> '' THEN ' ' ELSE '' END, trim(coalesce(nxt[i], '')))))  AS cells, TRUE FROM h_pair WHERE nxt IS NOT NULL),
{sql_scored("h_score", "h_try")},
header AS (SELECT * EXCLUDE (row_idx, cells, n), row_idx AS header_idx, cells AS header FROM (SELECT *, row_number() OVER (PARTITION BY document_id, table_index ORDER BY score DESC, merged, row_idx) AS n FROM h_score WHERE score > 0) WHERE n = 1 AND c_code IS NOT NULL)"""


@add("header_score", f"{ROWS}, {sql_scored('scored', 'rows_t')} SELECT document_id, table_index, row_idx, score, n_fields, c_code, c_description, c_voltage, c_lumens, c_max_va FROM scored")
def _(s, d):
    return grid.score_rows(rows(s, d)).select("document_id", "table_index", "row_idx", "score", "n_fields", "c_code", "c_description", "c_voltage", "c_lumens", "c_max_va")


@add("header_find", f"{ROWS}, {sql_header('rows_t')} SELECT document_id, table_index, header_idx, merged, score, n_fields, c_code FROM header")
def _(s, d):
    return grid.find_header(rows(s, d)).select("document_id", "table_index", "header_idx", "merged", "score", "n_fields", "c_code")


_CLASSIFY = f"""{ROWS}, five AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, table_index ORDER BY row_idx) AS k FROM rows_t) WHERE k <= 5),
{sql_scored("five_score", "five")},
best5 AS (SELECT document_id, table_index, score AS s5, n_fields AS n5 FROM (SELECT *, row_number() OVER (PARTITION BY document_id, table_index ORDER BY score DESC, k) AS n FROM five_score) WHERE n = 1),
best3 AS (SELECT document_id, table_index, score AS s3, n_fields AS n3, c_voltage IS NOT NULL OR c_lumens IS NOT NULL OR c_cct IS NOT NULL OR c_dimming IS NOT NULL OR c_max_va IS NOT NULL AS electrical
          FROM (SELECT *, row_number() OVER (PARTITION BY document_id, table_index ORDER BY score DESC, k) AS n FROM five_score WHERE k <= 3) WHERE n = 1),
grids AS (SELECT document_id, table_index, page_number, list(cells ORDER BY row_idx) AS g FROM rows_t GROUP BY ALL),
texts AS (SELECT *, lower(trim(regexp_replace(array_to_string(list_transform(g[1:3], lambda r: array_to_string(r, ' ')), ' '), '\\s+', ' ', 'g'))) AS t,
          list_filter(list_transform(flatten(g[1:3]), lambda c: regexp_extract(c, {q(R.LABEL)}, 1, 'i')), lambda x: x <> '')[1] AS raw_label FROM grids),
labelled AS (SELECT *, coalesce(array_to_string(list_transform(string_split(lower(raw_label), ' '), lambda w: upper(w[1]) || w[2:]), ' '), '') AS label FROM texts),
gated AS (SELECT *, {sql_any("lower(label || ' ' || substr(t, 1, 200))", R.TITLE_GATE)} AS gate FROM labelled JOIN best5 USING (document_id, table_index) JOIN best3 USING (document_id, table_index)),
verdicts AS (
  SELECT *, CASE WHEN {sql_any("t", R.POSITIVE_WORDS)} AND gate THEN 1
    WHEN {sql_any("t", R.NEGATIVE_WORDS)} THEN CASE WHEN s5 >= 8 AND n5 >= 4 AND gate THEN 1 ELSE 2 END
    WHEN contains(t, 'fixture schedule') THEN CASE WHEN s5 >= 3 AND gate THEN 3 ELSE 4 END
    WHEN regexp_matches(t, {q(R.PANEL_LABEL)}, 'i') THEN 2
    WHEN {sql_any("t", R.BROAD_NEGATIVE_WORDS)} THEN 5
    WHEN s3 >= 3 AND n3 >= 2 AND electrical AND gate THEN 3 ELSE 5 END AS v FROM gated),
tables_t AS (
  SELECT document_id, table_index, page_number, len(g) AS n_rows, CASE v WHEN 1 THEN 'LIGHT_FIXTURE_SCHEDULE' WHEN 3 THEN 'LIGHT_FIXTURE_SCHEDULE' WHEN 2 THEN 'PANEL_SCHEDULE' ELSE 'OTHER' END AS classification,
         coalesce(nullif(label, ''), CASE v WHEN 1 THEN 'Light Fixture Schedule' WHEN 2 THEN 'Panel Schedule' WHEN 5 THEN 'Other' ELSE 'Fixture Schedule' END) AS header_label, v IN (1, 3) AS is_fixture_schedule FROM verdicts)"""


@add("table_classify", f"{_CLASSIFY} SELECT * FROM tables_t")
def _(s, d):
    return grid.classify_tables(rows(s, d))


@add("table_filter", f"""{_CLASSIFY} SELECT document_id, table_index, CASE WHEN {sql_any("t", R.POSITIVE_WORDS)} THEN 'positive' WHEN {sql_any("t", R.NEGATIVE_WORDS)} THEN 'negative'
  WHEN contains(t, 'fixture schedule') THEN CASE WHEN s5 >= 3 THEN 'positive' ELSE 'negative' END WHEN regexp_matches(t, {q(R.PANEL_LABEL)}, 'i') THEN 'negative' ELSE 'ambiguous' END AS verdict FROM gated""")
def _(s, d):
    return grid.filter_verdict(rows(s, d))


@add("best_schedule", f"""{_CLASSIFY}, fixture_tables AS (SELECT * FROM tables_t WHERE is_fixture_schedule AND n_rows >= 2)
SELECT t.document_id, t.table_index, t.page_number, t.n_rows, p.pages FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n_rows DESC, table_index) AS n FROM fixture_tables) t
JOIN (SELECT document_id, list_sort(list(DISTINCT page_number)) AS pages FROM fixture_tables GROUP BY document_id) p USING (document_id) WHERE n = 1""")
def _(s, d):
    return grid.best_schedule(grid.classify_tables(rows(s, d)))


@add("tables_by_label", f"""{_CLASSIFY}, placed AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY table_index) - 1 AS place FROM tables_t)
SELECT document_id, header_label, count(*) AS tables, list(table_index ORDER BY page_number, place) AS table_indexes FROM placed GROUP BY document_id, header_label""")
def _(s, d):
    return grid.by_label(grid.classify_tables(rows(s, d)))


@add("page_table_counts", f"{_CLASSIFY} SELECT document_id, page_number, count(*) AS tables, count(*) FILTER (WHERE is_fixture_schedule) AS fixture_tables FROM tables_t GROUP BY ALL")
def _(s, d):
    return grid.page_counts(grid.classify_tables(rows(s, d)))


#: Tables and classified pages in one statement.
_ON_PAGES = f"{_CLASSIFY}, {CLASSIFY_CTES.strip()}".replace("WITH RECURSIVE ", with_views("fx_sheets") + ",\n", 1)


@add("relevant_tables", f"""{_ON_PAGES}, pages_p AS (SELECT DISTINCT document_id, page_number FROM classified WHERE is_relevant)
SELECT t.document_id, t.table_index FROM tables_t t WHERE n_rows >= 2 AND ((t.document_id, t.page_number) IN (SELECT (document_id, page_number) FROM pages_p) OR t.document_id NOT IN (SELECT document_id FROM pages_p))""")
def _(s, d):
    return grid.relevant_tables(grid.classify_tables(rows(s, d)), classified(s, d).filter("is_relevant")).select("document_id", "table_index")


@add("tables_with_pages", f"""{_ON_PAGES} SELECT t.document_id, t.table_index, t.page_number, t.header_label, c.page_type, nullif(c.sheet_code, '') AS sheet_code
FROM tables_t t LEFT JOIN classified c ON c.document_id = t.document_id AND c.page_number = t.page_number""")
def _(s, d):
    return grid.with_pages(grid.classify_tables(rows(s, d)), classified(s, d)).select("document_id", "table_index", "page_number", "header_label", "page_type", "sheet_code")


_HW = ", ".join(q(w) for w in R.HEADER_WORDS)
_NOTECELL = lambda c: f"(trim({c}) <> '' AND (regexp_matches({c}, {q(R.NOTE)}, 'i') OR (length(trim({c})) > 80 AND len(regexp_extract_all({c}, '[.!?]')) > 1)))"
_STRIP = f"""{ROWS},
sized AS (SELECT *, count(*) OVER (PARTITION BY document_id, table_index) AS size, len(list_filter(cells, lambda c: trim(c) <> '' AND NOT {_NOTECELL("c")})) = 0 AS noise FROM rows_t),
led AS (SELECT *, min(CASE WHEN NOT noise THEN row_idx END) OVER (PARTITION BY document_id, table_index) AS lead_idx FROM sized),
kept1 AS (SELECT document_id, table_index, page_number, row_idx, size, CASE WHEN row_idx = lead_idx AND len(list_filter(cells, lambda c: NOT {_NOTECELL("c")})) > 0 THEN list_filter(cells, lambda c: NOT {_NOTECELL("c")}) ELSE cells END AS cells FROM led WHERE size >= 2 AND row_idx >= lead_idx),
{sql_header("kept1")},
kept2 AS (SELECT k.*, row_number() OVER w AS pos, count(*) OVER (PARTITION BY document_id, table_index) AS remaining FROM kept1 k LEFT JOIN (SELECT document_id, table_index, header_idx FROM header) h USING (document_id, table_index) WHERE header_idx IS NULL OR row_idx >= header_idx WINDOW w AS (PARTITION BY document_id, table_index ORDER BY row_idx)),
idle AS (SELECT *, len(list_filter(cells, lambda c: trim(c) <> '')) = 0 OR (trim(cells[1]) <> '' AND regexp_matches(trim(cells[1]), {q(R.NOTE)}, 'i')) OR lower(trim(cells[1])) IN ({_HW}) AS idle FROM kept2),
lasted AS (SELECT *, max(CASE WHEN pos = 1 OR NOT idle THEN pos END) OVER (PARTITION BY document_id, table_index) AS last_pos FROM idle)
SELECT document_id, table_index, page_number, row_idx, cells FROM lasted WHERE remaining < 3 OR pos <= last_pos UNION ALL SELECT document_id, table_index, page_number, row_idx, cells FROM sized WHERE size < 2"""


@add("strip_rows", _STRIP)
def _(s, d):
    return grid.strip_rows(rows(s, d))


_DATA = lambda c: f"({c} <> '' AND lower({c}) NOT IN ({_HW}) AND (length({c}) <= 3 OR regexp_matches({c}, '\\d')))"


@add("data_rows", f"{ROWS} SELECT document_id, table_index, row_idx FROM rows_t WHERE {_DATA('trim(cells[1])')}")
def _(s, d):
    return rows(s, d).filter(grid.data_row(F.get("cells", F.lit(0)))).select("document_id", "table_index", "row_idx")


_CLEAN = f"""CASE WHEN NOT last_is_code AND lastv <> '' AND length(lastv) <= 6 AND regexp_matches(lastv, {q(R.SHORT_CODE)}) AND lower(lastv) NOT IN ({_HW}) AND length(code) > length(lastv) THEN lastv
  WHEN length(code) > 6 AND regexp_extract(code, {q(R.LEADING_CODE)}, 1) <> '' THEN regexp_extract(code, {q(R.LEADING_CODE)}, 1) ELSE code END"""


@add("code_clean", f"{ROWS} SELECT document_id, table_index, row_idx, {_CLEAN} AS code FROM (SELECT document_id, table_index, row_idx, trim(cells[1]) AS code, trim(cells[len(cells)]) AS lastv, FALSE AS last_is_code FROM rows_t) WHERE code <> ''")
def _(s, d):
    code, last = F.trim(F.get("cells", F.lit(0))), F.trim(F.element_at("cells", -1))
    return rows(s, d).filter(code != "").select("document_id", "table_index", "row_idx", grid.clean_code(code, last, F.lit(False)).alias("code"))


def _embed_sql() -> str:
    out, prev = "", "embed_0"
    for k, (field, aliases) in enumerate(R.ALIASES):
        cell = f"coalesce(header[c_{field} + 1], '')"
        low = f"lower(trim(regexp_replace({cell}, '\\s+', ' ', 'g')))"
        whens = " ".join(f"WHEN {low} = {q(a)} THEN ''" if exact else f"WHEN contains({low}, {q(a)}) THEN trim(regexp_extract({cell}, {q('(?i)^' + chr(92) + 's*' + a.replace('/', '[/]') + chr(92) + 's+(.+)$')}, 1))" for a, exact in aliases)
        out += f", embed_{k + 1} AS (SELECT *, CASE WHEN c_{field} IS NULL THEN '' ELSE CASE {whens} ELSE '' END END AS e_{field} FROM {prev})"
        prev = f"embed_{k + 1}"
    return out


_FIELD = lambda f, cells="cells": f"coalesce(trim({cells}[c_{f} + 1]), '')"
_REFUSED = f"""{sql_any("t", R.NEGATIVE_WORDS)} OR (contains(t, 'fixture schedule') AND s5 < 3) OR (NOT contains(t, 'fixture schedule') AND regexp_matches(t, {q(R.PANEL_LABEL)}, 'i'))"""
_PARSED = f"""{_CLASSIFY}, refused AS (SELECT document_id, table_index FROM gated WHERE NOT {sql_any("t", R.POSITIVE_WORDS)} AND ({_REFUSED})),
rows_ok AS (SELECT r.* FROM rows_t r WHERE NOT EXISTS (SELECT 1 FROM refused x WHERE x.document_id = r.document_id AND x.table_index = r.table_index)), {sql_header("rows_ok")},
embed_0 AS (SELECT h.*, r.page_number FROM header h JOIN (SELECT DISTINCT document_id, table_index, page_number FROM rows_ok) r USING (document_id, table_index)){_embed_sql()},
synthetic AS (SELECT document_id, table_index, page_number, -1 AS row_idx, list_transform(CAST(range(0, len(header)) AS INTEGER[]), lambda i: CASE {' '.join(f"WHEN i = c_{f} AND e_{f} <> '' THEN e_{f}" for f in R.FIELDS)} ELSE '' END) AS cells FROM embed_9),
body AS (
  SELECT r.document_id, r.table_index, r.page_number, r.row_idx, r.cells FROM rows_ok r JOIN header h USING (document_id, table_index) WHERE r.row_idx > h.header_idx + CAST(h.merged AS INTEGER)
  UNION ALL SELECT * FROM synthetic WHERE len(list_filter(cells, lambda c: c <> '')) > 0),
records AS (
  SELECT b.document_id, b.table_index, page_number, row_idx, {_FIELD("code")} AS code, trim(cells[len(cells)]) AS lastv, len(cells) - 1 = c_code AS last_is_code, cells, header, {", ".join(f"{_FIELD(f)} AS {f}" for f in R.FIELDS if f != "code")}
  FROM body b JOIN header h USING (document_id, table_index)),
coded AS (SELECT * EXCLUDE (code), {_CLEAN} AS code FROM records WHERE {_DATA("code")}),
judged AS (SELECT *, count(*) OVER (PARTITION BY document_id, table_index) > 5 AND avg(CASE WHEN regexp_matches(code, '^[0-9]+$') THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY document_id, table_index) > 0.6 AS panel FROM coded),
fixtures_t AS (SELECT * FROM judged WHERE NOT panel)"""
_FX = "document_id, table_index, page_number, row_idx, code, description, mounting, fixture_style, voltage, lumens, cct, dimming, max_va"


@add("parse_fixtures", f"{_PARSED} SELECT {_FX} FROM fixtures_t")
def _(s, d):
    return grid.fixtures(rows(s, d)).drop("raw_data")


@add("fixture_raw_data", f"""{_PARSED}, cells_x AS (SELECT document_id, table_index, row_idx, unnest(cells) AS v, generate_subscripts(cells, 1) AS i, header FROM fixtures_t),
named AS (SELECT document_id, table_index, row_idx, i, trim(v) AS value, coalesce(nullif(trim(header[i]), ''), concat('Column_', i)) AS name FROM cells_x)
SELECT document_id, table_index, row_idx, name, value FROM (SELECT *, row_number() OVER (PARTITION BY document_id, table_index, row_idx, name ORDER BY i DESC) AS n FROM named) WHERE n = 1""")
def _(s, d):
    return grid.fixtures(rows(s, d)).select("document_id", "table_index", "row_idx", F.explode("raw_data").alias("name", "value"))


@add("panel_reject", f"{_PARSED} SELECT document_id, table_index, count(*) AS records FROM judged WHERE NOT panel GROUP BY document_id, table_index")
def _(s, d):
    return grid.fixtures(rows(s, d)).groupBy("document_id", "table_index").agg(F.count(F.lit(1)).alias("records"))


@add("fixtures_dedup", f"""{_PARSED} SELECT {_FX} FROM fixtures_t WHERE trim(code) = '' UNION ALL
SELECT {_FX} FROM (SELECT *, row_number() OVER (PARTITION BY document_id, lower(trim(code)) ORDER BY page_number, table_index, row_idx) AS n FROM fixtures_t WHERE trim(code) <> '') WHERE n = 1""")
def _(s, d):
    return grid.first_of_code(grid.fixtures(rows(s, d)).drop("raw_data"))


@add("fixtures_not_known", f"{_PARSED} SELECT {_FX} FROM fixtures_t f WHERE f.page_number > 1 AND NOT EXISTS (SELECT 1 FROM fixtures_t o WHERE o.document_id = f.document_id AND o.page_number = 1 AND lower(trim(o.code)) = lower(trim(f.code)))")
def _(s, d):
    found = grid.fixtures(rows(s, d)).drop("raw_data")
    return grid.only_new(found.filter("page_number > 1"), found.filter("page_number = 1"))


_BLOCKS = f"""{with_views("fx_blocks")},
b_cell AS (SELECT id, parent AS table_id, row_index AS r, col_index AS c, row_span, col_span FROM fx_blocks WHERE kind = 'CELL'),
b_word AS (SELECT parent AS id, string_agg(CASE WHEN kind = 'SELECTION' THEN 'X' ELSE text END, ' ' ORDER BY id) AS text FROM fx_blocks WHERE kind IN ('WORD', 'SELECTION') GROUP BY parent),
b_fill AS (SELECT table_id, r, c, unnest(range(r, r + row_span)) AS rr, coalesce(text, '') AS text, col_span FROM b_cell LEFT JOIN b_word USING (id)),
b_all AS (SELECT *, unnest(range(c, c + col_span)) AS cc FROM b_fill),
b_last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_id, rr, cc ORDER BY r DESC, c DESC) AS n FROM b_all) WHERE n = 1),
b_size AS (SELECT table_id, max(rr) AS mr, max(cc) AS mc FROM b_last GROUP BY table_id),
b_row AS (SELECT table_id, mc, unnest(range(0, mr + 1)) AS row_idx FROM b_size),
b_place AS (SELECT table_id, row_idx, unnest(range(0, mc + 1)) AS col_idx FROM b_row)
SELECT p.table_id, CAST(p.row_idx AS INTEGER) AS row_idx, CAST(p.col_idx AS INTEGER) AS col_idx, coalesce(l.text, '') AS text FROM b_place p LEFT JOIN b_last l ON l.table_id = p.table_id AND l.rr = p.row_idx AND l.cc = p.col_idx"""


@add("blocks_to_grid", _BLOCKS)
def _(s, d):
    return grid.blocks_to_rows(view(s, d, "fx_blocks"))


@add("tables_csv_lines", f"""{ROWS}, csv AS (
  SELECT document_id, table_index, 0 AS part, -1 AS row_idx, concat('Table ', table_index + 1, ' (page ', page_number, ')') AS line FROM (SELECT DISTINCT document_id, table_index, page_number FROM rows_t)
  UNION ALL SELECT document_id, table_index, 1, row_idx, array_to_string(list_transform(cells, lambda c: CASE WHEN regexp_matches(c, '[",\\n]') THEN concat('"', replace(c, '"', '""'), '"') ELSE c END), ',') FROM rows_t
  UNION ALL SELECT DISTINCT document_id, table_index, 2, -1, '' FROM rows_t)
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY table_index, part, row_idx) AS ord, line FROM csv""")
def _(s, d):
    from planweave.sources.files import csv_lines

    return csv_lines(rows(s, d))


# ---- line streams ----

_LINES = f"""{with_views("fx_lines")},
marked AS (SELECT document_id, line_no, trim(line) AS text, TRY_CAST(nullif(regexp_extract(trim(line), '===\\s*PAGE\\s+(\\d+)\\s*===', 1, 'i'), '') AS INTEGER) AS own FROM fx_lines),
paged AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS page FROM marked),
walk AS (
  SELECT document_id, CAST(0 AS INTEGER) AS line_no, 'text' AS state, 'text' AS now, 0 AS seg, 0 AS own_seg FROM paged GROUP BY document_id
  UNION ALL
  SELECT p.document_id, p.line_no,
         CASE WHEN p.own IS NOT NULL THEN w.state WHEN w.state = 'text' AND starts_with(p.text, 'TABLE ') AND contains(lower(p.text), 'rows') THEN 'wait'
              WHEN w.state = 'wait' AND starts_with(p.text, '=======') THEN 'table' WHEN w.state = 'table' AND starts_with(p.text, '=======') THEN 'text' ELSE w.state END,
         CASE WHEN p.own IS NOT NULL THEN 'mark' WHEN w.state = 'text' AND starts_with(p.text, 'TABLE ') AND contains(lower(p.text), 'rows') THEN 'turn'
              WHEN w.state <> 'text' AND starts_with(p.text, '=======') THEN 'turn' ELSE w.state END,
         w.seg + CASE WHEN p.own IS NULL AND w.state = 'table' AND starts_with(p.text, '=======') THEN 1 ELSE 0 END, w.seg
  FROM walk w JOIN paged p ON p.document_id = w.document_id AND p.line_no = w.line_no + 1),
states AS (SELECT w.document_id, w.line_no, p.text, p.page, w.now AS state, w.own_seg AS seg, w.seg > w.own_seg AS closes FROM walk w JOIN paged p USING (document_id, line_no))"""
_TABLES_L = f"""{_LINES},
context AS (SELECT document_id, seg, string_agg(text, ' ' ORDER BY line_no) AS context FROM (SELECT *, row_number() OVER (PARTITION BY document_id, seg ORDER BY line_no DESC) AS n FROM states
  WHERE state = 'text' AND text <> '' AND NOT starts_with(text, '==') AND NOT starts_with(text, '--') AND NOT starts_with(text, '──')) WHERE n <= 15 GROUP BY ALL),
bodies AS (SELECT document_id, seg, string_agg(text, chr(10) ORDER BY line_no) AS body, count(*) AS n_lines FROM states WHERE state = 'table' GROUP BY ALL),
found AS (SELECT document_id, seg, max(page) FILTER (WHERE state = 'turn' AND starts_with(text, 'TABLE ')) AS page FROM states GROUP BY ALL HAVING bool_or(closes)),
sections AS (SELECT f.document_id, f.seg, f.page, coalesce(b.n_lines, 0) AS n_lines, coalesce(c.context, '') AS context, coalesce(b.body, '') AS body FROM found f LEFT JOIN bodies b USING (document_id, seg) LEFT JOIN context c USING (document_id, seg)),
searched AS (SELECT *, regexp_replace(concat(context, ' ', chr(10), ' ', substr(body, 1, 500)), '(LIGHT(?:ING)?\\s)CONTROL', '\\1#CONTROL', 'gi') AS area FROM sections),
candidates AS (
  SELECT document_id, seg, page, n_lines, context, body,
         NOT {sql_any("lower(substr(body, 1, 1000))", R.CONTROL_WORDS)} AND ({" + ".join(f"CAST(contains(lower(substr(body, 1, 1000)), {q(w)}) AS INTEGER)" for w in R.SECTION_WORDS)}) >= 2 AND {sql_any("lower(substr(body, 1, 1000))", R.STRONG_SECTION_WORDS)} AS is_fixture,
         {sql_any("lower(substr(body, 1, 500))", R.INDEX_SECTION_WORDS)} AS is_index
  FROM searched WHERE regexp_matches(area, 'LIGHT(?:ING)?\\s+[\\s\\w]*SCHEDULE', 'i'))"""


@add("line_sections", f"{_LINES} SELECT document_id, line_no, page, state, seg FROM states")
def _(s, d):
    return sections.sectioned(view(s, d, "fx_lines")).select("document_id", "line_no", "page", "state", "seg")


@add("section_context", f"{_TABLES_L} SELECT document_id, seg, page, n_lines, context FROM sections")
def _(s, d):
    return sections.tables(view(s, d, "fx_lines")).select("document_id", "seg", "page", "n_lines", "context")


@add("schedule_candidates", f"{_TABLES_L} SELECT document_id, seg, page, n_lines, is_fixture, is_index FROM candidates")
def _(s, d):
    return sections.candidates(view(s, d, "fx_lines")).select("document_id", "seg", "page", "n_lines", "is_fixture", "is_index")


@add("best_candidate", f"""{_TABLES_L}, tiered AS (SELECT *, CASE WHEN is_fixture AND NOT is_index THEN 3 WHEN NOT is_index THEN 2 ELSE 1 END AS tier FROM candidates),
pages_t AS (SELECT document_id, coalesce(list(page ORDER BY seg) FILTER (WHERE tier = 3 AND page > 0), []) AS p3, coalesce(list(page ORDER BY seg) FILTER (WHERE NOT is_index AND page > 0), []) AS p2 FROM tiered GROUP BY document_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY tier DESC, n_lines DESC, seg) AS n FROM tiered) WHERE n = 1)
SELECT document_id, seg, n_lines, tier, CASE tier WHEN 3 THEN p3 WHEN 2 THEN p2 ELSE CASE WHEN page > 0 THEN [page] ELSE [] END END AS pages FROM top JOIN pages_t USING (document_id)""")
def _(s, d):
    return sections.best_candidate(view(s, d, "fx_lines"))


# ---- takeoff ----

_CH = lambda c: sql_any(f"lower({c})", R.CSV_HEADER_WORDS)
_STOP = ", ".join(q(w) for w in R.CSV_STOP_WORDS)
_QUOTE = "'^[''\"]+|[''\"]+$'"
_CODES = f"""{with_views("fx_cells")},
used AS (SELECT document_id, table_index, row_idx, col_idx, trim(coalesce(text, '')) AS text, max(trim(coalesce(text, '')) <> '') OVER (PARTITION BY document_id, table_index, col_idx) AS used FROM fx_cells),
srows AS (SELECT document_id, table_index, row_idx, list(text ORDER BY col_idx) AS cells FROM used WHERE used GROUP BY ALL),
shead AS (SELECT document_id, table_index, row_idx AS header_idx, cells FROM (SELECT *, row_number() OVER (PARTITION BY document_id, table_index ORDER BY len(list_filter(cells, lambda c: {_CH("c")})) DESC, k) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY document_id, table_index ORDER BY row_idx) AS k FROM srows) WHERE k <= 5) WHERE n = 1),
snames AS (SELECT document_id, table_index, header_idx, list_transform(CAST(range(1, len(cells) + 1) AS INTEGER[]), lambda i: CASE WHEN cells[i] = '' OR lower(cells[i]) = 'nan' THEN concat('Column_', i) ELSE cells[i] END) AS raw FROM shead),
suniq AS (SELECT document_id, table_index, header_idx, list_transform(CAST(range(1, len(raw) + 1) AS INTEGER[]), lambda i: CASE WHEN len(list_filter(raw[1:i], lambda x: x = raw[i])) = 1 THEN raw[i] ELSE concat(raw[i], '_', len(list_filter(raw[1:i], lambda x: x = raw[i]))) END) AS names FROM snames),
scols AS (SELECT *, coalesce(list_filter(CAST(range(1, len(names) + 1) AS INTEGER[]), lambda i: {sql_any("lower(names[i])", R.CSV_CODE_WORDS)})[1], 1) AS cc, coalesce(list_filter(CAST(range(1, len(names) + 1) AS INTEGER[]), lambda i: contains(lower(names[i]), 'desc'))[1], 2) AS dc FROM suniq),
sdata AS (
  SELECT document_id, table_index, row_idx, coalesce(cells[cc], '') AS c, CASE WHEN cells[len(cells)] <> '' AND lower(cells[len(cells)]) <> 'nan' THEN cells[len(cells)] ELSE coalesce(cells[len(cells) - 1], '') END AS alt,
         CASE WHEN dc <= len(cells) THEN regexp_replace(cells[dc], {_QUOTE}, '', 'g') ELSE '{takeoff.NONE}' END AS d FROM srows JOIN scols USING (document_id, table_index) WHERE row_idx > header_idx),
sfix AS (SELECT document_id, table_index, row_idx, regexp_replace(CASE WHEN alt <> '' AND length(alt) <= 6 AND NOT contains(alt, ' ') AND (length(c) > 6 OR contains(c, ' ')) THEN alt ELSE c END, {_QUOTE}, '', 'g') AS code, coalesce(nullif(d, ''), '{takeoff.NONE}') AS description FROM sdata),
sgood AS (SELECT * FROM sfix WHERE code <> '' AND lower(code) NOT IN ({_STOP}) AND length(code) <= 15),
sonce AS (SELECT document_id, table_index, code, min(row_idx) AS ord, arg_max(description, row_idx) AS description FROM sgood GROUP BY ALL),
sparts AS (SELECT document_id, table_index, ord, description, code AS sgiven, CASE WHEN contains(code, ' ') AND length(code) <= 12 THEN list_filter(string_split_regex(code, '\\s+'), lambda x: x <> '') ELSE [code] END AS parts FROM sonce),
ssplit AS (SELECT document_id, table_index, ord, description, sgiven, unnest(parts) AS code, generate_subscripts(parts, 1) - 1 AS part FROM sparts),
codes_t AS (SELECT document_id, table_index, code, min(ord * 1000 + part) AS place, arg_max(description, ord * 1000 + part) AS description FROM ssplit GROUP BY ALL)"""


@add("fixture_codes_from_csv", f"{_CODES} SELECT document_id, table_index, code, description, row_number() OVER (PARTITION BY document_id, table_index ORDER BY place) AS ord FROM codes_t")
def _(s, d):
    from pyspark.sql import Window

    return takeoff.codes(view(s, d, "fx_cells")).select("document_id", "table_index", "code", "description", F.row_number().over(Window.partitionBy("document_id", "table_index").orderBy("place")).alias("ord"))


@add("csv_headers", f"{_CODES} SELECT document_id, table_index, header_idx, names, cc - 1 AS code_col, dc - 1 AS desc_col FROM scols")
def _(s, d):
    return takeoff.schedule_header(takeoff.schedule_rows(view(s, d, "fx_cells")))


@add("merged_code_split", f"{_CODES} SELECT document_id, table_index, sgiven AS given, CAST(part AS INTEGER) AS part, code FROM ssplit WHERE contains(sgiven, ' ')")
def _(s, d):
    return takeoff.split_codes(takeoff.given_codes(view(s, d, "fx_cells"))).filter("given like '% %'").select("document_id", "table_index", "given", "part", "code")


@add("base_codes", f"""{_CODES}, based AS (SELECT *, regexp_replace(code, '{R.CODE_SUFFIX}', '', 'i') AS base FROM codes_t)
SELECT document_id, table_index, code, description, NULL AS base_of FROM codes_t UNION ALL
SELECT document_id, table_index, base, arg_min(description, place), arg_min(code, place) FROM based b WHERE base <> '' AND base <> code AND NOT EXISTS (SELECT 1 FROM codes_t c WHERE c.document_id = b.document_id AND c.table_index = b.table_index AND c.code = b.base) GROUP BY document_id, table_index, base""")
def _(s, d):
    return takeoff.with_bases(takeoff.codes(view(s, d, "fx_cells")))


_KNOWN = ", ".join(f"({k}, {q(c)})" for k, c in enumerate(CODES))
_SHEET = f"""{with_views("fx_words")},
tokens AS (SELECT document_id, page_number, x0, y0, regexp_replace(trim(word), '^[.,;:!]+|[.,;:!]+$', '', 'g') AS token FROM fx_words),
fit AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY NOT regexp_matches(token, {q(R.PRIORITY_SHEET)}, 'i'), (800 - x0) * (800 - x0) + (640 - y0) * (640 - y0), token) AS n
  FROM tokens WHERE regexp_matches(token, {q(R.SHEET_TOKEN)}, 'i') AND token NOT IN ({", ".join(map(q, CODES))})),
sheets AS (SELECT p.document_id, p.page_number, coalesce(upper(f.token), concat('Page_', p.page_number)) AS sheet FROM (SELECT DISTINCT document_id, page_number FROM fx_words) p LEFT JOIN fit f ON f.n = 1 AND f.document_id = p.document_id AND f.page_number = p.page_number)"""
_MATCH = f"""{_SHEET},
hits AS (SELECT document_id, page_number, x0, y0, x1, y1, word, code, code_ord, count(*) AS copies FROM fx_words, (VALUES {_KNOWN}) AS k(code_ord, code) WHERE contains(upper(word), upper(code)) GROUP BY ALL),
near AS (
  SELECT h.*, w.y0 AS wy, string_agg(w.word, '' ORDER BY w.x0, w.word) AS line FROM hits h JOIN fx_words w ON w.document_id = h.document_id AND w.page_number = h.page_number
   AND w.x1 >= h.x0 - 2 AND w.x0 <= h.x1 + 30 AND w.y1 >= h.y0 - 2 AND w.y0 <= h.y1 + 2 GROUP BY ALL),
around AS (SELECT document_id, page_number, x0, y0, x1, y1, word, code, code_ord, copies, replace(string_agg(line, chr(10) ORDER BY wy, line), ' ', '') AS around FROM near GROUP BY ALL),
matched AS (SELECT * EXCLUDE (around, copies), unnest(range(copies)) AS copy FROM around WHERE regexp_matches(around, '(?:^|[^a-zA-Z0-9])' || code || '(?:[^a-zA-Z0-9]|$)'))"""


@add("sheet_id_pick", f"{_SHEET} SELECT * FROM sheets")
def _(s, d):
    return takeoff.sheet_ids(view(s, d, "fx_words"), CODES, WIDTH, HEIGHT)


@add("boundary_match", f"{_MATCH} SELECT document_id, page_number, code, x0, y0, word, count(*) AS hits FROM matched GROUP BY ALL")
def _(s, d):
    return takeoff.matches(view(s, d, "fx_words"), CODES).groupBy("document_id", "page_number", "code", "x0", "y0", "word").agg(F.count(F.lit(1)).alias("hits"))


_ACCEPT = f"""{_MATCH},
queue AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY length(code) DESC, code_ord, y0, x0, word, x1, y1, code) AS n FROM matched),
fold AS (
  SELECT document_id, page_number, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(code VARCHAR, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[]) AS kept FROM queue GROUP BY ALL
  UNION ALL
  SELECT f.document_id, f.page_number, q.n, CASE WHEN len(list_filter(f.kept, lambda k: NOT (k.x1 + 2 < q.x0 OR q.x1 + 2 < k.x0 OR k.y1 + 2 < q.y0 OR q.y1 + 2 < k.y0))) > 0 THEN f.kept
    ELSE list_append(f.kept, {{'code': q.code, 'x0': q.x0, 'y0': q.y0, 'x1': q.x1, 'y1': q.y1}}) END
  FROM fold f JOIN queue q ON q.document_id = f.document_id AND q.page_number = f.page_number AND q.n = f.n + 1),
ended AS (SELECT document_id, page_number, arg_max(kept, n) AS kept FROM fold GROUP BY ALL),
accepted AS (SELECT document_id, page_number, unnest(kept) AS k, generate_subscripts(kept, 1) - 1 AS nth FROM ended)"""


def _accepted(s, d):
    return takeoff.suppress(takeoff.matches(view(s, d, "fx_words"), CODES))


def _sheets(s, d):
    return takeoff.sheet_ids(view(s, d, "fx_words"), CODES, WIDTH, HEIGHT)


@add("overlap_suppress", f"{_ACCEPT} SELECT document_id, page_number, k.code AS code, k.x0 AS x0, k.y0 AS y0, nth FROM accepted")
def _(s, d):
    return _accepted(s, d).select("document_id", "page_number", "code", "x0", "y0", "nth")


@add("takeoff_instances", f"{_ACCEPT} SELECT document_id, page_number, sheet, concat_ws('_', sheet, k.code, nth) AS id, k.code AS code, round(k.x0, 2) AS x0, round(k.y0, 2) AS y0, round(k.x1, 2) AS x1, round(k.y1, 2) AS y1 FROM accepted JOIN sheets USING (document_id, page_number)")
def _(s, d):
    return takeoff.instances(_accepted(s, d), _sheets(s, d))


_COUNTS = f"""{_ACCEPT}, counted AS (
  SELECT e.document_id, e.sheet, e.code, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT document_id, sheet, code FROM sheets, (VALUES {_KNOWN}) AS k(code_ord, code)) e
  LEFT JOIN (SELECT document_id, sheet, k.code AS code, count(*) AS n FROM accepted JOIN sheets USING (document_id, page_number) GROUP BY ALL) c ON c.document_id = e.document_id AND c.sheet = e.sheet AND c.code = e.code)"""


@add("count_matrix_long", f"{_COUNTS} SELECT * FROM counted")
def _(s, d):
    return takeoff.counts(_accepted(s, d), _sheets(s, d), CODES)


@add("count_matrix_pivot", f"""{_COUNTS}, first_seen AS (SELECT document_id, sheet, min(page_number) AS first_page FROM sheets GROUP BY ALL)
SELECT c.document_id, c.code, concat('Fixture ', c.code) AS description, list(c.sheet ORDER BY f.first_page) AS sheets, list(CAST(c.n AS BIGINT) ORDER BY f.first_page) AS counts, CAST(sum(c.n) AS BIGINT) AS total
FROM counted c JOIN first_seen f ON f.document_id = c.document_id AND f.sheet = c.sheet GROUP BY c.document_id, c.code""")
def _(s, d):
    sheets = _sheets(s, d)
    return takeoff.matrix(takeoff.counts(_accepted(s, d), sheets, CODES), sheets, {c: f"Fixture {c}" for c in CODES})


@add("takeoff_totals", f"{_ACCEPT} SELECT p.document_id, count(k) AS total FROM (SELECT DISTINCT document_id FROM sheets) p LEFT JOIN accepted a USING (document_id) GROUP BY p.document_id")
def _(s, d):
    sheets = _sheets(s, d)
    nested = takeoff.count_maps(takeoff.counts(_accepted(s, d), sheets, CODES))
    return nested.select("document_id", takeoff.grand_total(F.col("counts")).alias("total"))


@add("fallback_codes", f"{with_views('fx_pages')}, found AS (SELECT DISTINCT document_id, unnest(regexp_extract_all(extracted_text, {q(R.PLAN_CODE)}, 1)) AS code FROM fx_pages) SELECT document_id, list(code ORDER BY code) AS codes FROM found WHERE code NOT IN ({', '.join(map(q, R.NOT_CODES))}) GROUP BY document_id")
def _(s, d):
    return takeoff.plan_codes(view(s, d, "fx_pages"))


_FLAGS = "document_id % 13 = 0 AS running, status = 'completed' AS has_counts, document_id % 3 = 0 AS has_schedule, document_id % 5 = 0 AS has_plans, document_id % 2 = 0 AS has_files"


@add("takeoff_status", f"{with_views('fx_batch_docs')} SELECT document_id, CASE WHEN running THEN 'running' WHEN has_counts THEN 'completed' WHEN has_schedule OR has_plans THEN 'partial' WHEN has_files THEN 'failed' ELSE 'not_run' END AS pipeline_status FROM (SELECT document_id, {_FLAGS} FROM fx_batch_docs)")
def _(s, d):
    df = view(s, d, "fx_batch_docs").selectExpr("document_id", *_FLAGS.split(", "))
    return df.select("document_id", takeoff.status(*[F.col(c) for c in ("running", "has_counts", "has_schedule", "has_plans", "has_files")]).alias("pipeline_status"))


@add("takeoff_result_or_batch", f"""{with_views('fx_batch_docs')} SELECT document_id, batch_id, CASE WHEN document_id % 3 = 0 THEN 'document' WHEN batch_id % 2 = 0 THEN 'batch' ELSE 'none' END AS origin,
  CASE WHEN document_id % 3 = 0 THEN document_id % 7 + 1 WHEN batch_id % 2 = 0 THEN batch_id % 11 + 1 ELSE 0 END AS total FROM fx_batch_docs""")
def _(s, d):
    docs = view(s, d, "fx_batch_docs")
    own = docs.filter("document_id % 3 = 0").selectExpr("document_id", "batch_id", "document_id % 7 + 1 AS total")
    shared = docs.filter("batch_id % 2 = 0").selectExpr("CAST(NULL AS BIGINT) AS document_id", "batch_id", "batch_id % 11 + 1 AS total").distinct()
    return takeoff.result_or_batch(docs.select("document_id", "batch_id"), own.unionByName(shared))
