"""Reading and writing: uploads, page text, table indexes, CSV and matrices.

What needs a PDF library, an OCR service or a hosted model stays outside: its results are input tables
(words, blocks, replies). The functions here cover everything that Spark reads and writes itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planweave.operators.takeoff import count_maps

TABLE_INDEX = T.StructType([
    T.StructField("document_id", T.LongType()), T.StructField("table_index", T.LongType()), T.StructField("page_number", T.IntegerType()), T.StructField("csv_file", T.StringType()), T.StructField("row_count", T.IntegerType()),
    T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("caption", T.StringType()),
])


def read_uploads(spark: SparkSession, path: str, pattern: str = "*.{pdf,PDF,zip,ZIP}") -> DataFrame:
    """path, modificationTime, length, content of files of the allowed kinds."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def zip_members(files: DataFrame) -> DataFrame:
    """PDF members of archives: path, member, content. Folders, members outside of the archive and
    archives that cannot be read are left out."""

    def members(batches):
        import io
        import posixpath
        import zipfile

        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for m in archive.infolist():
                            name = posixpath.normpath(m.filename.replace("\\", "/"))
                            if not m.is_dir() and name.lower().endswith(".pdf") and not name.startswith(("../", "/")):
                                yield pd.DataFrame({"path": [path], "member": [name], "content": [archive.read(m)]})
                except zipfile.BadZipFile:
                    continue

    return files.select("path", "content").mapInPandas(members, "path string, member string, content binary")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """document_id (the path), line_no, line; the order of lines is explicit."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("document_id"), "value")
    return texts.select("document_id", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def read_table_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TABLE_INDEX).json(path, multiLine=True)


def read_grid_csv(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text, empty ones kept, no header."""
    df = spark.read.csv(path, header=False, inferSchema=False, quote='"', escape='"', multiLine=True)
    return df.na.fill("")


def write_pages(pages: DataFrame, path: str, mode: str = "append") -> None:
    pages.repartition("document_id").sortWithinPartitions("document_id", "page_number").write.mode(mode).partitionBy("document_id").parquet(path)


def write_table_index(rows: DataFrame, path: str) -> None:
    """rows(document_id, table_index, page_number, row_idx, cells): a JSON line per table."""
    order = F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "cells"))), lambda r: r["cells"])
    tables = rows.groupBy("document_id", "table_index", "page_number").agg(order.alias("rows"))
    tables.withColumn("row_count", F.size("rows")).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def quoted(cell: Column) -> Column:
    return F.when(cell.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def csv_lines(rows: DataFrame) -> DataFrame:
    """document_id, ord, line: every table of a document as a title, its rows and a blank line."""
    tables = rows.select("document_id", "table_index", "page_number").distinct()
    keys = ["document_id", "table_index"]
    title = tables.select(*keys, F.lit(0).alias("part"), F.lit(-1).alias("row_idx"), F.concat(F.lit("Table "), F.col("table_index") + 1, F.lit(" (page "), "page_number", F.lit(")")).alias("line"))
    body = rows.select(*keys, F.lit(1).alias("part"), "row_idx", F.array_join(F.transform("cells", quoted), ",").alias("line"))
    blank = tables.select(*keys, F.lit(2).alias("part"), F.lit(-1).alias("row_idx"), F.lit("").alias("line"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("table_index", "part", "row_idx"))
    return title.unionByName(body).unionByName(blank).select("document_id", place.cast("long").alias("ord"), "line")


def counts_json(counted: DataFrame) -> DataFrame:
    """document_id, counts: {code: {sheet: n}} as JSON text."""
    return count_maps(counted).select("document_id", F.to_json("counts").alias("counts"))


def combined_lines(pages: DataFrame, rows: DataFrame, text_per_page: bool = False) -> DataFrame:
    """document_id, line_no, line: one stream per document with a fence and a mark for each page from 1 to the last, the text (that
    of all pages on the first, or each page's own) and each page's tables with a title, fences and CSV lines; tables are
    numbered through the document. read_lines() and sections read it back. pages(document_id, page_number, extracted_text)."""
    key, fence = ["document_id", "page_number"], "=" * 60
    per = Window.partitionBy("document_id").orderBy("page_number", "table_index")
    sizes = rows.groupBy("document_id", "table_index", "page_number").agg(F.count(F.lit(1)).alias("n"))
    last = F.greatest(F.coalesce(F.max("page_number"), F.lit(1)), F.lit(1))
    every = pages.groupBy("document_id").agg(last.alias("last")).select("document_id", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("page_number"))
    titled = sizes.withColumn("nth", F.row_number().over(per)).join(every, key)
    at = lambda part, sub, row: F.struct(F.lit(part).alias("part"), sub.cast("long").alias("sub"), row.cast("long").alias("row"))
    zero = F.lit(0)

    def fixed(df: DataFrame, part: int, texts: list[Column], sub: Column = zero) -> DataFrame:
        return df.select(*key, F.posexplode(F.array(*texts)).alias("k", "line"), sub.alias("sub")).select(*key, at(part, F.col("sub"), F.col("k")).alias("at"), "line")

    head = fixed(every, 0, [F.lit(""), F.lit(fence), F.concat(F.lit("=== PAGE "), "page_number", F.lit(" ===")), F.lit(fence), F.lit("")])
    own = pages if text_per_page else pages.withColumn("own", F.col("page_number")).withColumn("page_number", F.lit(1))
    texts = own.select(*key, F.col("page_number" if text_per_page else "own").alias("own"), F.posexplode(F.split(F.coalesce("extracted_text", F.lit("")), "\n")).alias("k", "line"))
    body = texts.select(*key, at(1, F.col("own"), F.col("k")).alias("at"), "line")
    body = body.unionByName(fixed(every if text_per_page else every.filter("page_number = 1"), 2, [F.lit("")]))
    title = fixed(titled, 3, [F.lit(""), F.concat(F.lit("TABLE "), "nth", F.lit(" ("), "n", F.lit(" rows)")), F.lit(fence)], F.col("nth"))
    cells = rows.join(titled.select("document_id", "table_index", "nth"), ["document_id", "table_index"])
    cells = cells.select(*key, at(3, F.col("nth"), F.col("row_idx") + 1000).alias("at"), F.array_join(F.transform("cells", quoted), ",").alias("line"))
    end = titled.select(*key, F.posexplode(F.array(F.lit(fence), F.lit(""))).alias("k", "line"), "nth").select(*key, at(3, F.col("nth"), F.col("k") + (1 << 40)).alias("at"), "line")
    foot = fixed(every, 4, [F.lit(""), F.lit("─" * 40)])
    lines = head.unionByName(body).unionByName(title).unionByName(cells).unionByName(end).unionByName(foot)
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "at"))
    return lines.select("document_id", place.alias("line_no"), "line")


def write_combined(lines: DataFrame, path: str) -> None:
    """A text file per document, its lines in order."""
    lines.repartition("document_id").sortWithinPartitions("document_id", "line_no").select("document_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("document_id").text(path)
