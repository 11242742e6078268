"""Hand cases, properties, plans and streams of the document operators."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from planweave.functions import text
from planweave.operators import catalog, classify, grid, takeoff, verify
from planweave.plans import registry
from planweave.plans.fixtures import view
from planweave.streaming import ingest

SF = "/root/testdata/sf0.001"
KEYS = "document_id long, table_index long"


def value(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} string" for k in given)) if given else spark.range(1)
    return row.select(column.alias("v")).first().v


def each(spark, function, cases):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string")
    got = {r.i: r.v for r in df.select("i", function(F.col("x")).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_types(spark):
    each(spark, classify.description_type, [("Electrical Plan", "LIGHTING_PLAN"), ("Cover Sheet Details", "DETAIL"), ("Signal Plan", "OTHER"), ("Mezzanine", None)])
    each(spark, classify.title_type, [("ELECTRICAL PLAN", "POWER_PLAN"), ("PANEL SCHEDULE AND LEGEND", "SYMBOLS_LEGEND"), ("UPPER LEVEL LIGHTING", "LIGHTING_PLAN"), ("SITE PLAN DETAIL", "SITE_PLAN")])
    each(spark, classify.title_type_last, [("SITE PLAN DETAIL", "DETAIL"), ("DETAIL AND ELECTRICAL SITE PLAN", "SITE_PLAN"), ("", None)])
    each(spark, classify.sheet_code, [("A101 E101", "E101"), ("M101 A2", "M101"), ("rev cs", "CS"), ("B12345", None)])
    each(spark, classify.content_type, [("SEE SHEET E601 FOR LUMINAIRE SCHEDULE", "OTHER"), ("POWER PLAN LIGHTING PLAN", "LIGHTING_PLAN"), ("LIGHT FIXTURE SCHEDULE", "SCHEDULE"), (None, "OTHER")])
    each(spark, classify.luminaire_schedule, [("LIGHT FIXTURE SCHEDULE" + " PANEL SCHEDULE" * 4, True), ("LIGHT FIXTURE SCHEDULE" + " PANEL SCHEDULE" * 7, False), ("PANEL SCHEDULED LOADS", True)])


def test_code_prefixes(spark):
    cases = [("E101", "", "LIGHTING_PLAN"), ("E101", "DEMO", "DEMOLITION_PLAN"), ("E201", "SIGNAL", "OTHER"), ("E301", "", "POWER_PLAN"), ("E501", "ROOF", "OTHER"), ("E901", "", None), ("ED101", "", None), ("M101", "", None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {r.i: r.v for r in df.select("i", classify.code_type(F.col("a"), F.col("b")).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_text(spark):
    each(spark, text.safe_filename, [("../../etc/pass wd?.pdf", "pass wd_.pdf"), ("  .pdf", "file.pdf")])
    each(spark, text.garbled_ratio, [("", 1.0), ("abc", 0.0), ("12345", 1.0), ("café", 0.25), ("a b c", 0.8)])
    each(spark, grid.data_row, [(x, True) for x in ("EX", "A1", "AB12")] + [(x, False) for x in ("ABCD", "TYPE", "V", "ID", "")])


def test_records(spark):
    code = lambda c, last: value(spark, grid.clean_code(F.col("c"), F.col("last"), F.lit(False)), c=c, last=last)
    assert code("A1 2X4 LED TROFFER", "9W") == "A1" and code("A1", "B") == "B"
    cells = [["SYMBOL A", "DESCRIPTION", "VOLTAGE", "LUMENS"], ["B1", "second", "120V", "900"]]
    rows = spark.createDataFrame([(7, 0, 1, i, c) for i, c in enumerate(cells)], f"{KEYS}, page_number int, row_idx int, cells array<string>")
    got = {r.code: r for r in grid.fixtures(rows).collect()}
    assert set(got) == {"A", "B1"} and got["B1"].lumens == "900" and got["B1"].raw_data["SYMBOL A"] == "B1"
    one = rows.withColumn("code", F.element_at("cells", 1))
    assert grid.first_of_code(one.unionByName(one)).count() == 2


def test_documents_are_apart(spark):
    """Two documents with the same table numbers, pages and codes."""
    head, rows = ["LIGHT FIXTURE SCHEDULE", "", "", ""], []
    for doc in (1, 2):
        for t, n in ((0, 2 + doc), (1, 4)):
            cells = [head, ["MARK", "DESCRIPTION", "VOLTAGE", "LUMENS"], *[[f"A{k}", f"{doc}{t}{k}", "120V", "900"] for k in range(n)]]
            rows += [(doc, t, t + 1, i, c) for i, c in enumerate(cells)]
    rows = spark.createDataFrame(rows, f"{KEYS}, page_number int, row_idx int, cells array<string>")
    tables, found = grid.classify_tables(rows), grid.fixtures(rows).drop("raw_data")
    assert {tuple(r) for r in grid.best_schedule(tables).select("document_id", "table_index", "n_rows").collect()} == {(1, 1, 6), (2, 0, 6)}
    assert {(r.document_id, r.code, r.description) for r in grid.first_of_code(found).collect()} == {(1, "A0", "100"), (1, "A1", "101"), (1, "A2", "102"), (1, "A3", "113"), *((2, f"A{k}", f"20{k}") for k in range(4))}
    assert {(r.document_id, r.code) for r in grid.only_new(found.filter("page_number = 2"), found.filter("page_number = 1")).collect()} == {(1, "A3")}
    assert all(r.tables == 1 for r in grid.page_counts(tables).collect()) and grid.page_counts(tables).count() == 4
    pages = spark.createDataFrame([(1, 2, "SCHEDULE", "E601")], "document_id long, page_number int, page_type string, sheet_code string")
    assert {(r.document_id, r.table_index) for r in grid.relevant_tables(tables, pages).collect()} == {(1, 1), (2, 0), (2, 1)}
    assert {(r.document_id, r.sheet_code) for r in grid.with_pages(tables, pages).collect()} == {(1, "E601"), (1, None), (2, None)}


def test_filter_comes_before_the_header(spark):
    cells = [["PANEL SCHEDULE", "", "", ""], ["MARK", "DESCRIPTION", "VOLTAGE", "LUMENS"], ["A1", "x", "120V", "900"]]
    rows = spark.createDataFrame([(1, 0, 1, i, c) for i, c in enumerate(cells)], f"{KEYS}, page_number int, row_idx int, cells array<string>")
    assert grid.fixtures(rows).count() == 0 and grid.fixtures(rows, filtered=False).count() == 1


def test_column_prefix(spark):
    strip = lambda *names: spark.range(1).select(grid.prefix_stripped(F.array(*map(F.lit, names))).alias("v")).first().v
    assert strip("TABLE CAPTION.MARK", "TABLE CAPTION.VOLTS", "TABLE CAPTION.") == ["MARK", "VOLTS", "Column_2"]
    assert strip("CAP.MARK", "CAP.VOLTS") == ["CAP.MARK", "CAP.VOLTS"] and strip("TABLE CAPTION.A") == ["TABLE CAPTION.A"]
    assert strip("TABLE CAPTION A", "TABLE CAPTION B") == ["TABLE CAPTION A", "TABLE CAPTION B"]


def test_matrix_has_every_sheet(spark):
    """Sheets come from the data, in the order of their pages; the total is that of the long form."""
    from planweave.plans import tables as q

    counted, sheets = takeoff.counts(q._accepted(spark, SF), q._sheets(spark, SF), q.CODES).cache(), q._sheets(spark, SF)
    wide = takeoff.matrix(counted, sheets, {"A1": "Troffer"}).cache()
    assert wide.agg(F.sum("total")).first()[0] == counted.agg(F.sum("n")).first()[0] > 0
    one = takeoff.matrix_of(0, wide)
    assert one.columns[:2] == ["TYPE", "DESCRIPTION"] and one.columns[-1] == "TOTAL" and set(one.columns[2:-1]) == {r.sheet for r in sheets.filter("document_id = 0").collect()}
    assert {r.TYPE: r.DESCRIPTION for r in one.collect()}["A1"] == "Troffer"
    assert takeoff.matrix_of(-5, wide).count() == 0
    maps = takeoff.count_maps(counted)
    assert maps.select(F.sum(takeoff.grand_total(F.col("counts")))).first()[0] == wide.agg(F.sum("total")).first()[0]
    assert spark.range(1).select(takeoff.grand_total(F.expr("map('a', 2L, 'b', 3L)"), nested=False)).first()[0] == 5


def test_replies(spark):
    each(spark, lambda c: verify.parse(c)["page_type"], [('{"page_type": "cover ", "confidence": "x"}', "COVER"), ("none", None), ('```json\n{"page_type": "NOPE",}\n```', "OTHER"), ('{"page_type": "COVER", "conf', "COVER")])


def test_replies_with_nested_objects(spark):
    each(spark, lambda c: verify.parse(c)["page_type"], [
        ('{"a": {"page_type": "COVER"}, "page_type": "detail"}', "DETAIL"), ('x {"s": "} {", "page_type": "RISER",} y', "RISER"), ('{"a": 1}', "OTHER"), ("{}", "OTHER"), ("", None), (None, None),
        ('{"page_type": "COVER", "page_type2": {"x', "COVER"),
    ])
    each(spark, verify.balanced, [('a {"b": {"c": "\\"}"}} d }', '{"b": {"c": "\\"}"}}'), ("{ {", None), ("none", None)])
    each(spark, verify.json_array, [("see [1, [2]] and ]", "[1, [2]] and ]"), ("no", None)])
    each(spark, lambda c: F.transform(verify.fixture_records(c), lambda r: r["code"]), [('{"fixtures": [{"code": "A"}, {"code": "B", "voltage": "1', ["A"]), ('{"fixtures": []}', []), ("none", []), ('```json\n{"fixtures": [{"code": "A{"}]}\n```', ["A{"])])


def test_paths_and_users(spark):
    each(spark, text.normal_path, [("/a/./b//../c", "/a/c"), ("/../..", "/"), ("/a/b/", "/a/b")])
    each(spark, lambda c: text.inside(c, F.lit("/store/7")), [("/store/7/a.png", True), ("/store/77/a.png", False), ("/store/7/../8/a", False), ("/store/7", False)])
    each(spark, text.valid_password, [("Abcdefg1", True), ("abcdefg1", False), ("Ab1", False), (None, False), ("ÀBcdefg1", True)])
    each(spark, text.valid_email, [("a.b+c@d-e.org", True), ("a@b", False), ("a b@c.de", False), (None, False)])
    each(spark, text.valid_name, [(" Al ", True), (" A ", False), (None, False)])
    each(spark, lambda c: text.numbered("page", F.length(c), 4, ".png"), [("abc", "page_0003.png")])


def test_best_text(spark):
    best = lambda native, ocr, more, mode: tuple(spark.range(1).select(classify.best_text(F.lit(native), F.lit(ocr), F.lit(more), F.lit(mode)).alias("b")).first().b)
    assert best("abcdef", "ab", "abcdefg", True) == ("abcdefg", True) and best("abcdef", "ab", "abcdefg", False) == ("abcdef", False)
    assert best("abc", "abc", "abcdefg", True) == ("abc", False) and best(None, "x", None, True) == ("x", True) and best(None, None, None, False) == ("", False)


def test_index_from_tables(spark):
    pages = spark.createDataFrame([(1, 1, "no index"), (1, 2, "E900   TEXT DETAIL"), (2, 1, "E101   LIGHTING PLAN")], "document_id long, page_number int, extracted_text string")
    cells = [["SHEET", "NAME"], ["e101", " Lighting Plan "], ["E102 x", "POWER PLAN"], ["E101", "ROOF DETAIL"], ["none", "x"], ["E103", ""]]
    rows = spark.createDataFrame([(d, 0, 1, i, c) for d in (1, 2) for i, c in enumerate(cells)], f"{KEYS}, page_number int, row_idx int, cells array<string>")
    got = {(r.document_id, r.sheet_code): r.description for r in classify.index_entries(pages, rows).collect()}
    assert got == {(1, "E101"): "ROOF DETAIL", (1, "E102 X"): "POWER PLAN", (2, "E101"): "LIGHTING PLAN"}
    assert classify.index_entries(pages).filter("document_id = 1").first().sheet_code == "E900"


def test_combined_text_reads_back(spark, tmp_path):
    """What the writer writes, the line operators find again."""
    from planweave.operators import sections
    from planweave.sources import files

    pages = spark.createDataFrame([(1, 1, "first\nLIGHTING FIXTURE SCHEDULE"), (1, 2, "second"), (2, 3, None)], "document_id long, page_number int, extracted_text string")
    cells = [["TYPE", "DESCRIPTION", "VOLTAGE"], ["A1", "LED, 2x4", "120V"]]
    rows = spark.createDataFrame([(1, t, t + 1, i, c) for t in (0, 1) for i, c in enumerate(cells)], f"{KEYS}, page_number int, row_idx int, cells array<string>")
    lines = files.combined_lines(pages, rows)
    found = {(r.seg, r.page): r.body for r in sections.tables(lines).filter("document_id = 1").collect()}
    assert found == {(0, 1): 'TYPE,DESCRIPTION,VOLTAGE\nA1,"LED, 2x4",120V', (1, 2): 'TYPE,DESCRIPTION,VOLTAGE\nA1,"LED, 2x4",120V'}
    assert lines.filter("document_id = 2 and line like '=== PAGE%'").count() == 3
    assert sections.schedule_csv(lines).first().csv.startswith("TYPE")
    files.write_combined(lines, str(tmp_path / "out"))
    back = files.read_lines(spark, str(tmp_path / "out" / "document_id=1"))
    assert [r.line for r in back.orderBy("line_no").collect()][: lines.filter("document_id = 1").count()] == [r.line for r in lines.filter("document_id = 1").orderBy("line_no").collect()]


def test_files(spark, tmp_path):
    """Uploads, archives, grids and indexes that are written are read again."""
    import zipfile

    from planweave.sources import files

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("one.pdf", "in/two.PDF", "../out.pdf", "/abs.pdf", "note.txt"):
            z.writestr(name, name)
    (tmp_path / "b.zip").write_bytes(b"no archive")
    (tmp_path / "c.pdf").write_bytes(b"pdf")
    uploads = files.read_uploads(spark, str(tmp_path))
    assert uploads.count() == 3
    assert {r.member: bytes(r.content).decode() for r in files.zip_members(uploads.filter("path like '%.zip'")).collect()} == {"one.pdf": "one.pdf", "in/two.PDF": "in/two.PDF"}
    rows = spark.createDataFrame([(1, 0, 2, i, c) for i, c in enumerate([["a", 'say "x", y'], ["", "b"]])], f"{KEYS}, page_number int, row_idx int, cells array<string>")
    files.write_table_index(rows, str(tmp_path / "index"))
    got = spark.read.schema(files.TABLE_INDEX).json(str(tmp_path / "index")).first()
    assert (got.document_id, got.row_count, got.rows) == (1, 2, [["a", 'say "x", y'], ["", "b"]])
    files.write_csv(rows.select(F.col("cells")[0].alias("x"), F.col("cells")[1].alias("y")), str(tmp_path / "csv"))
    assert {tuple(r) for r in files.read_grid_csv(spark, str(tmp_path / "csv")).collect()} == {("x", "y"), ("a", 'say "x", y'), ("", "b")}
    counted = spark.createDataFrame([(1, "E1", "A", 2), (1, "E2", "A", 0), (1, "E1", "B", 1)], "document_id long, sheet string, code string, n long")
    assert files.counts_json(counted).first().counts == '{"A":{"E1":2,"E2":0},"B":{"E1":1}}'
    pages = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "document_id long, page_number int, extracted_text string")
    files.write_pages(pages, str(tmp_path / "pages"))
    assert spark.read.parquet(str(tmp_path / "pages")).count() == 3


def test_overlap(spark):
    rows = [(1, 1, c, k, x, 10.0, x + 12, 18.0, c) for c, k, x in (("AA1", 0, 10.0), ("A1", 1, 14.0), ("A1", 1, 80.0))]
    df = spark.createDataFrame(rows, "document_id long, page_number int, code string, code_ord int, x0 double, y0 double, x1 double, y1 double, word string")
    assert sorted((r.code, r.x0) for r in takeoff.suppress(df).collect()) == [("A1", 80.0), ("AA1", 10.0)]


def test_batches_of_nothing(spark):
    none = spark.createDataFrame([], "batch_id long, document_id long, upload_time timestamp, status string, file_type string")
    assert catalog.batches(none).count() == 0


@pytest.mark.parametrize("name", ["classify_pages", "strip_rows", "best_candidate", "overlap_suppress", "parse_fixtures", "upload_dedup", "reply_parse"])
def test_against_sql(spark, name):
    """The same rows as the registered SQL at the smallest size; the whole comparison runs at sf0.01."""
    con = duckdb.connect()
    for t in ("documents", "part", "lineitem", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in got.description]
    want = sorted(str([str(v) for v in r]) for r in got.fetchall())
    rows = registry.queries()[name](spark, SF).select(*names).collect()
    assert sorted(str([str(v) for v in r]) for r in rows) == want and want


def test_pages_hold_whole_texts(spark):
    """A keyword beyond the first 400 characters counts."""
    page = view(spark, SF, "fx_pages").select("doc_id", "extracted_text")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    both = page.join(docs, "doc_id")
    assert both.count() == docs.count() and both.filter("length(text) > 400").count() and not both.filter("not endswith(extracted_text, text)").count()


def test_replies_cover_all_events(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    assert events > 800 and registry.queries()["reply_parse"](spark, SF).count() == events


def test_plan_stays_in_the_jvm(spark):
    plan = registry.queries()["classify_pages"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 3 and df.columns == ["page_type", "pages", "relevant_pages"]
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_stream(spark, tmp_path):
    rows = [(i, i % 2, f"{i}.pdf", i // 4, "completed" if i < 8 or i % 3 else "failed", "pdf", f"text {i % 5}") for i in range(16)]
    df = spark.createDataFrame(rows, "upload_seq long, owner_id int, filename string, batch_id long, status string, file_type string, content string").withColumn("upload_time", F.timestamp_seconds(F.lit(1.7e9) + F.col("upload_seq")))
    for k in range(2):
        df.filter(f"upload_seq div 8 = {k}").select(*ingest.UPLOAD.fieldNames()).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = ingest.start(ingest.distinct_uploads(ingest.read(spark, str(tmp_path / "in"), 1)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    docs = spark.read.parquet(str(tmp_path / "out/documents"))
    assert docs.select("owner_id", "hash").distinct().count() == docs.count() == 10
    want = {r.batch_id for r in ingest.done(spark, str(tmp_path / "out")).collect()}
    ingest.start_complete(spark, str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination()
    assert {r.batch_id for r in spark.read.parquet(str(tmp_path / "out/complete")).collect()} == want and want
