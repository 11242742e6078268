"""Incremental arrival: uploads as a file stream, each content once per owner, batches reported when done.

Two streams. The first keeps the set of (owner, hash) within the watermark and adds each micro-batch to the catalogue; a
micro-batch that runs twice writes the same rows to the same place. The second reads what the first adds and keeps two numbers
per batch in the state store, so no micro-batch reads the catalogue again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planweave.operators.catalog import batches

UPLOAD = T.StructType([
    T.StructField("upload_seq", T.LongType()), T.StructField("owner_id", T.IntegerType()), T.StructField("filename", T.StringType()), T.StructField("upload_time", T.TimestampType()),
    T.StructField("batch_id", T.LongType()), T.StructField("status", T.StringType()), T.StructField("file_type", T.StringType()), T.StructField("content", T.StringType()),
])


def read(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(UPLOAD).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def distinct_uploads(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """First arrival of each content of an owner; what is older than the delay is forgotten."""
    hashed = stream.withColumn("hash", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256))
    return hashed.withWatermark("upload_time", delay).dropDuplicatesWithinWatermark(["owner_id", "hash"])


def start(stream: DataFrame, path: str, checkpoint: str):
    """Write the catalogue, a folder for each micro-batch."""

    def add(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/documents/epoch={epoch}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_complete(spark: SparkSession, path: str, checkpoint: str):
    """Write, for each micro-batch of the catalogue's stream, the batches that it changed and that are complete by then."""
    stored = T.StructType([*UPLOAD.fields, T.StructField("hash", T.StringType())])
    docs = spark.readStream.schema(stored).parquet(f"{path}/documents")
    per_batch = docs.groupBy("batch_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status") == "completed").alias("completed"))

    def report(rows: DataFrame, epoch: int) -> None:
        rows.filter("documents = completed").select("batch_id", "documents").write.mode("overwrite").parquet(f"{path}/complete/epoch={epoch}")

    return per_batch.writeStream.outputMode("update").foreachBatch(report).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def done(spark: SparkSession, path: str) -> DataFrame:
    """Batches whose documents are all completed, from the whole catalogue at once."""
    docs = spark.read.parquet(f"{path}/documents").withColumnRenamed("upload_seq", "document_id")
    return batches(docs).filter("all_completed").select("batch_id", "documents")
