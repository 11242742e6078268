"""Derived input views. Each statement runs unchanged in Spark SQL and in DuckDB, so both sides of a
comparison read the same input; the operators' logic is never shared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("customer", "documents", "events", "lineitem", "nation", "orders", "part", "region", "supplier")

VIEWS: dict[str, str] = {}

VIEWS["fx_titles"] = """
SELECT * FROM (VALUES
 (0,'E001','ELECTRICAL SYMBOLS AND ABBREVIATIONS E001'),
 (1,'E101','FIRST FLOOR LIGHTING PLAN E101'),
 (2,'E102','LEVEL 2 PLAN - LIGHTING AREA A E102'),
 (3,'E201','POWER PLAN LEVEL 1 E201'),
 (4,'E601','LUMINAIRE SCHEDULE E601'),
 (5,'E602','PANEL SCHEDULE E602'),
 (6,'ED101','DEMOLITION PLAN LEVEL 1 ED101'),
 (7,'E010','ELECTRICAL SITE PLAN E010'),
 (8,'FA101','FIRE ALARM LEVEL 1 FA101'),
 (9,'E701','RISER DIAGRAM E701'),
 (10,'E801','DETAIL SHEET E801'),
 (11,'CS','COVER SHEET CS'),
 (12,'E103','UPPER LEVEL EAST E103'),
 (13,'E301','LEVEL 3 EAST E301'),
 (14,'E502','ROOF EAST E502'),
 (15,'M101','MECHANICAL LEVEL 1 M101'),
 (16,'','DETAIL AND ELECTRICAL SITE PLAN'),
 (17,'','UPPER LEVEL - LIGHTING'),
 (18,'',''),
 (19,'E2.01','SIGNAL EAST E2.01'),
 (20,'T100','TECHNOLOGY PLAN T100'),
 (21,'E900','ENLARGED ELECTRICAL ROOM E900'),
 (22,'','GENERAL'),
 (23,'E405','LEVEL 4 EAST E405')
) AS t(title_id, raw_code, title_block)
"""

VIEWS["fx_phrases"] = """
SELECT * FROM (VALUES
 (0,'SEE SHEET E601 FOR LUMINAIRE SCHEDULE'),
 (1,'LUMINAIRE SCHEDULE'),
 (2,'LIGHT FIXTURE SCHEDULE PANEL SCHEDULE PANEL SCHEDULE PANEL SCHEDULE PANEL SCHEDULE'),
 (3,'LIGHTING PLAN LIGHTING PLAN POWER PLAN'),
 (4,'POWER PLAN LIGHTING PLAN'),
 (5,'PROVIDE CONDUIT TO FIRE ALARM'),
 (6,'FIRE ALARM FIRE ALARM DETAIL'),
 (7,'EQUIPMENT SCHEDULE WITH LED LAMP'),
 (8,'G1/5 H2-3A CD1/2 A3/1 EX1/4'),
 (9,'LIGHTING CONTROL SCHEDULE'),
 (10,'LIGHTING  CONTROL SCHEDULE'),
 (11,'')
) AS t(phrase_id, phrase)
"""

VIEWS["fx_pages"] = """
SELECT CAST(floor(d.doc_id / 8) AS BIGINT) AS document_id,
       CAST(d.doc_id % 8 + 1 AS INT) AS page_number,
       t.title_block, t.raw_code,
       concat(p.phrase, chr(10), d.text) AS extracted_text,
       CASE WHEN d.doc_id % 5 = 0 THEN TRUE ELSE FALSE END AS ocr_used,
       d.doc_id
FROM documents d
JOIN fx_titles t ON t.title_id = (d.doc_id * 7 + CAST(floor(d.doc_id / 8) AS BIGINT)) % 24
JOIN fx_phrases p ON p.phrase_id = (d.doc_id * 5 + CAST(floor(d.doc_id / 12) AS BIGINT)) % 12
"""

VIEWS["fx_uploads"] = """
SELECT doc_id AS upload_seq, CAST(replace(source, 'src', '') AS INT) % 4 AS owner_id,
       concat('doc ', CAST(doc_id AS STRING), CASE WHEN doc_id % 9 = 0 THEN '.txt' WHEN doc_id % 7 = 0 THEN '.zip' ELSE '.PDF' END) AS filename,
       n_chars AS file_size, text AS content
FROM documents
"""

VIEWS["fx_batch_docs"] = """
SELECT CAST(floor(o_orderkey / 4) AS BIGINT) AS batch_id, o_orderkey AS document_id,
       CAST(floor(o_orderkey / 4) AS BIGINT) % 10 AS owner_id, o_orderdate AS upload_time,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status,
       CASE WHEN o_orderkey % 11 = 0 THEN 'zip' ELSE 'pdf' END AS file_type
FROM orders
"""

VIEWS["fx_headers"] = """
SELECT * FROM (VALUES
 (0,'LIGHT FIXTURE SCHEDULE','TYPE','DESCRIPTION','VOLTAGE','LUMENS','MAX VA'),
 (1,'LUMINAIRE SCHEDULE','MARK','FIXTURE DESCRIPTION','VOLTS','RATED LUMEN','WATTS'),
 (2,'FIXTURE SCHEDULE','FIXTURE ID','DESC','V','LAMPS','WATTAGE'),
 (3,'FIXTURE SCHEDULE','ITEM','REMARK','BOX','SIZE','QTY'),
 (4,'PANEL SCHEDULE LP1','CKT','CIRCUIT DESCRIPTION','POLE','AMP','LOAD'),
 (5,'PANEL A','NO','LOAD','A','B','C'),
 (6,'SHEET INDEX','SHEET','SHEET NAME','REV','DATE','BY'),
 (7,'GENERAL NOTES: ALL FIXTURES LED','SYMBOL','DESCRIPTION','VOLTAGE','CCT','DIMMING')
) AS t(variant, title, h0, h1, h2, h3, h4)
"""

VIEWS["fx_cells"] = """
WITH base AS (
  SELECT CAST(floor(p_partkey / 12) AS BIGINT) AS t, CAST(p_partkey % 12 AS INT) AS r,
         CASE WHEN p_partkey % 12 = 11 THEN 'NOTE: SEE SPEC'
              WHEN CAST(floor(p_partkey / 12) AS BIGINT) % 13 = 5 THEN CAST(p_size AS STRING)
              WHEN p_partkey % 10 = 3 THEN concat(substring(p_type, 1, 1), CAST(p_size % 9 AS STRING), '-EM')
              WHEN p_partkey % 10 = 4 THEN concat(substring(p_type, 1, 1), '1 ', substring(p_type, 1, 1), '2')
              WHEN p_partkey % 10 = 5 THEN concat(substring(p_type, 1, 1), CAST(p_size % 9 AS STRING), ' 2X4 LED TROFFER')
              WHEN p_partkey % 10 = 6 THEN ''
              ELSE concat(substring(p_type, 1, 1), CAST(p_size % 9 AS STRING)) END AS code,
         p_name AS descr, CASE WHEN p_size % 2 = 0 THEN '120V' ELSE '277V' END AS volt,
         CAST(p_size * 100 AS STRING) AS lum, concat(CAST(p_size AS STRING), CASE WHEN p_partkey % 20 = 4 THEN ' WATTS MAX' ELSE 'W' END) AS va
  FROM part),
tabs AS (SELECT DISTINCT b.t, h.* FROM base b JOIN fx_headers h ON h.variant = b.t % 8),
placed AS (
SELECT t, 0 AS row_idx, c.col_idx, CASE WHEN c.col_idx = 0 THEN title ELSE '' END AS text
FROM tabs CROSS JOIN (VALUES (0),(1),(2),(3),(4)) AS c(col_idx)
UNION ALL
SELECT t, 1, c.col_idx, CASE c.col_idx WHEN 0 THEN h0 WHEN 1 THEN h1 WHEN 2 THEN h2 WHEN 3 THEN h3 ELSE h4 END
FROM tabs CROSS JOIN (VALUES (0),(1),(2),(3),(4)) AS c(col_idx)
UNION ALL
SELECT t, r + 2, c.col_idx, CASE c.col_idx WHEN 0 THEN code WHEN 1 THEN descr WHEN 2 THEN volt WHEN 3 THEN lum ELSE va END
FROM base CROSS JOIN (VALUES (0),(1),(2),(3),(4)) AS c(col_idx))
SELECT CAST(floor(t / 4) AS BIGINT) AS document_id, t % 4 AS table_index, CAST(t % 3 + 1 AS INT) AS page_number, row_idx, col_idx, text FROM placed
"""

VIEWS["fx_words"] = """
SELECT CAST(floor(l_orderkey / 400) AS BIGINT) AS document_id, CAST(l_orderkey % 10 + 1 AS INT) AS page_number,
       CAST((l_partkey * 13) % 90 * 8 AS DOUBLE) AS x0, CAST((l_suppkey * 17 + l_linenumber * 5) % 60 * 10 AS DOUBLE) AS y0,
       CAST((l_partkey * 13) % 90 * 8 AS DOUBLE) + 12.0 AS x1, CAST((l_suppkey * 17 + l_linenumber * 5) % 60 * 10 AS DOUBLE) + 8.0 AS y1,
       CASE l_linenumber WHEN 1 THEN 'A1' WHEN 2 THEN 'A1/2' WHEN 3 THEN 'AA1' WHEN 4 THEN 'A1X' WHEN 5 THEN 'a1'
            WHEN 6 THEN concat('E', CAST(100 + l_partkey % 7 AS STRING)) ELSE concat('B', CAST(l_partkey % 4 AS STRING)) END AS word,
       l_orderkey, l_partkey, l_suppkey, l_linenumber
FROM lineitem
"""

VIEWS["fx_replies"] = """
SELECT CAST(floor(event_id / 8) AS BIGINT) AS document_id, CAST(event_id % 8 + 1 AS INT) AS page_number,
       CASE CAST(event_id % 9 AS INT)
         WHEN 0 THEN '{"page_type": "LIGHTING_PLAN", "confidence": "high", "reasoning": "x"}'
         WHEN 1 THEN concat('```json', chr(10), '{"page_type": "SCHEDULE", "confidence": "HIGH"}', chr(10), '```')
         WHEN 2 THEN 'Sure. {"page_type": "power_plan", "confidence": "medium",} done'
         WHEN 3 THEN '{"page_type": "BANANA", "confidence": "certain"}'
         WHEN 4 THEN '{"page_type": "COVER", "confidence": "low", "reasoning": "trunc'
         WHEN 5 THEN '{"meta": {"page_type": "COVER", "note": "a } b"}, "page_type": "detail", "confidence": "High"}'
         WHEN 6 THEN 'As asked: {"meta": {"k": [1, 2]}, "page_type": "RISER", "confidence": "medium"} and more'
         WHEN 7 THEN '{"other": 1}'
         ELSE 'no json here' END AS reply_text
FROM events
"""

VIEWS["fx_notes"] = """
SELECT CAST(floor(event_id / 24) AS BIGINT) AS document_id, CAST(event_id % 8 + 1 AS INT) AS page_number, CAST(floor(event_id / 8) AS BIGINT) % 3 + 1 AS number,
       concat('NOTE ', upper(event_type)) AS text, CASE WHEN event_id % 2 = 0 THEN 'GENERAL' ELSE 'KEYED' END AS section
FROM events
"""

# Replies that list fixtures; every third is cut off inside its last object.
VIEWS["fx_lists"] = """
SELECT p_partkey AS reply_id, p_name AS told, concat('A', CAST(p_size AS STRING)) AS code,
       concat('Found: {"table_type": "light_fixture_schedule", "fixtures": [{"code": "A', CAST(p_size AS STRING), '", "description": "', p_name, ' {x}"}, {"code": "B1", "voltage": "277V",}',
              CASE WHEN p_partkey % 3 = 0 THEN ', {"code": "C' ELSE ']} end.' END) AS reply_text
FROM part
"""

VIEWS["fx_files"] = """
SELECT CAST(floor(o_orderkey / 6) AS BIGINT) AS document_id,
       CASE o_orderkey % 6 WHEN 0 THEN 'images/page_0001.png' WHEN 1 THEN 'images/page_0002.png' WHEN 2 THEN 'text/full_text.txt' WHEN 3 THEN concat('tables_all.', CASE WHEN o_custkey % 2 = 0 THEN 'json' ELSE 'txt' END)
         WHEN 4 THEN concat('lighting_schedule.', CASE WHEN o_custkey % 3 = 0 THEN 'csv' ELSE 'tmp' END) ELSE 'images/readme.md' END AS path
FROM orders
"""

VIEWS["fx_lines"] = """
WITH t AS (SELECT document_id, table_index, row_idx, concat_ws(',', max(CASE WHEN col_idx=0 THEN text END), max(CASE WHEN col_idx=1 THEN text END), max(CASE WHEN col_idx=2 THEN text END), max(CASE WHEN col_idx=3 THEN text END), max(CASE WHEN col_idx=4 THEN text END)) AS line
           FROM fx_cells GROUP BY document_id, table_index, row_idx),
n AS (SELECT document_id, table_index, document_id * 4 + table_index AS g, count(*) AS n_rows FROM t GROUP BY document_id, table_index),
u AS (
 SELECT document_id, table_index, 0 AS k, 0 AS j, concat('=== PAGE ', CAST(table_index + 1 AS STRING), ' ===') AS line FROM n
 UNION ALL SELECT document_id, table_index, 1, 0, '============================================================' FROM n
 UNION ALL SELECT n.document_id, n.table_index, 2, CAST(x.j AS INT), concat('context line ', CAST(x.j AS STRING)) FROM n CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11),(12),(13),(14),(15),(16)) AS x(j) WHERE n.table_index % 2 = 0
 UNION ALL SELECT document_id, table_index, 3, 0, CASE WHEN g % 3 = 0 THEN 'LIGHTING FIXTURE SCHEDULE' ELSE '-- rule' END FROM n
 UNION ALL SELECT document_id, table_index, 4, 0, concat('TABLE ', CAST(g + 1 AS STRING), ' (', CAST(n_rows AS STRING), ' rows)') FROM n
 UNION ALL SELECT document_id, table_index, 5, 0, '============================================================' FROM n
 UNION ALL SELECT document_id, table_index, 6, row_idx, line FROM t
 UNION ALL SELECT document_id, table_index, 7, 0, '============================================================' FROM n)
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY table_index, k, j) AS INT) AS line_no, line FROM u
"""

# Pages with an index line each, a file name, and some documents of one page.
VIEWS["fx_sheets"] = """
SELECT CASE WHEN p.doc_id % 40 = 7 THEN 1000000 + p.doc_id ELSE p.document_id END AS document_id,
       CASE WHEN p.doc_id % 40 = 7 THEN 1 ELSE p.page_number END AS page_number,
       p.title_block, p.ocr_used, p.doc_id,
       CASE WHEN p.doc_id % 3 = 0 THEN concat('SHEET INDEX', chr(10), p.raw_code, '   ', p.title_block, chr(10), 'E101  LIGHTING PLAN ', CAST(p.doc_id % 5 AS STRING), chr(10), p.extracted_text) ELSE p.extracted_text END AS extracted_text,
       concat(CAST(p.document_id % 97 AS STRING), '---', CASE WHEN p.doc_id % 40 = 7 THEN 'E2A UPPER LEVEL PLAN - LIGHTING AREA A' WHEN p.document_id % 4 = 1 THEN 'POWER PLAN' ELSE 'SET' END, '.pdf') AS filename
FROM fx_pages p
"""

# A block graph made from the grids: tables, cells (1-based, some spanning) and words.
VIEWS["fx_blocks"] = """
SELECT concat('t', CAST(document_id AS STRING), '_', CAST(table_index AS STRING)) AS id, 'TABLE' AS kind, '' AS text, 0 AS row_index, 0 AS col_index, 1 AS row_span, 1 AS col_span, '' AS parent FROM fx_cells WHERE row_idx = 0 AND col_idx = 0
UNION ALL
SELECT concat('c', CAST(document_id AS STRING), '_', CAST(table_index AS STRING), '_', CAST(row_idx AS STRING), '_', CAST(col_idx AS STRING)), 'CELL', '', row_idx + 1, col_idx + 1, 1, CASE WHEN row_idx = 0 AND col_idx = 0 THEN 3 ELSE 1 END, concat('t', CAST(document_id AS STRING), '_', CAST(table_index AS STRING)) FROM fx_cells WHERE row_idx > 0 OR col_idx = 0 OR col_idx > 2
UNION ALL
SELECT concat('w', CAST(document_id AS STRING), '_', CAST(table_index AS STRING), '_', CAST(row_idx AS STRING), '_', CAST(col_idx AS STRING)), CASE WHEN table_index % 5 = 3 AND col_idx = 4 THEN 'SELECTION' ELSE 'WORD' END, text, 0, 0, 1, 1, concat('c', CAST(document_id AS STRING), '_', CAST(table_index AS STRING), '_', CAST(row_idx AS STRING), '_', CAST(col_idx AS STRING)) FROM fx_cells WHERE text <> ''
"""

NEEDS = {
    "fx_pages": ("fx_titles", "fx_phrases"), "fx_sheets": ("fx_pages",), "fx_cells": ("fx_headers",), "fx_lines": ("fx_cells",), "fx_blocks": ("fx_cells",),
}


def order(name: str) -> list[str]:
    """The views that name needs, itself last."""
    out: list[str] = []
    for n in NEEDS.get(name, ()):
        out += [x for x in order(n) if x not in out]
    return [*out, name]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables in sf_dir. Plans are resolved at once, so later calls do not disturb it."""
    for t in TABLES:
        if any(f" {t}" in VIEWS[v] for v in order(name)):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for v in order(name):
        spark.sql(VIEWS[v]).createOrReplaceTempView(v)
    return spark.table(name)


def with_views(*names: str) -> str:
    """The start of a SQL statement that defines the views."""
    seen: list[str] = []
    for n in names:
        seen += [x for x in order(n) if x not in seen]
    return "WITH RECURSIVE " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in seen)
