"""A training corpus from `documents`: language, line dedup, near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the
columns of docs, and no column of docs is needed but those a stage names. Texts of any length are worked on whole;
an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.llm import langid, line_dedup, mixing, ngram_join, packing
from planweave.llm.common import n_words, row_keys, stored

#: Below this share of the languages' likelihoods, a text is no language for sure.
LEAST_SCORE = 0.35
#: Below this share of its words, what line dedup leaves of a document is scraps of a copy.
LEAST_LEFT = 0.25


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of docs; texts that are null, empty or without letters and those without a likeliest
    language go; ties go to the first language; repeated rows are judged alike. _lid_found is a reserved name."""
    found = langid.identify(docs, langid.sample(docs))
    rows = docs.select(*_columns(docs), found.alias("_lid_found"))
    return rows.filter((F.col("_lid_found.lang") != langid.UNDETERMINED) & (F.col("_lid_found.score") >= LEAST_SCORE)).select(*_columns(docs))


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages. A document that has lost its last word goes, and so does one that keeps less than LEAST_LEFT of
    its words and has none of its repeats from itself: a copy, of which only scraps would stay. One that never had a word
    stays. Rows alike in id and text are one document; a null id comes last. n_chars, if there, follows the text."""
    rows = line_dedup.dedup(docs)
    word = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    scraps = ~F.col("_ld_own") & (n_words(F.col("text")) < LEAST_LEFT * n_words(F.col("_ld_before")))
    rows = rows.filter((F.size("_ld_drop") == 0) | (word & ~scraps))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size("_ld_drop") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return rows.select(*_columns(docs))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every group that links join (of equal ids the one with the smaller
    hash of id and text), once: of rows alike in id and text the first by all its columns. A null id is kept only if
    its whole group has none; texts without words are groups of their own. Names that begin with _nd_ are reserved."""
    found = stored(ngram_join.near_duplicates(docs, k=5, percent=80), "groups")
    keep = found.filter(F.col("row_key") == F.col("first_key")).groupBy("row_key").agg((F.count(F.lit(1)) > 1).alias("_nd_many"))
    keep = stored(keep.select(F.col("row_key.k1").alias("_nd_k1"), F.col("row_key.k2").alias("_nd_k2"), "_nd_many"), "kept")
    k1, k2 = row_keys("doc_id", "text")
    rows = docs.select(*_columns(docs), k1.alias("_nd_1"), k2.alias("_nd_2")).join(keep, F.expr("_nd_1 = _nd_k1 and _nd_2 = _nd_k2"))
    if not keep.filter("_nd_many").limit(1).count():
        return rows.select(*_columns(docs))
    whole = F.struct(*_columns(docs))
    once = rows.filter("_nd_many").groupBy("_nd_1", "_nd_2").agg(F.min_by(whole, F.to_json(whole)).alias("_nd_row")).select("_nd_row.*")
    return rows.filter("not _nd_many").select(*_columns(docs)).unionByName(once)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources (null is one, the last) at weights 5, 2, 1 and 150 % of all words; a row stands as often as it has copies,
    repeated rows each by itself; texts without words have rate 1."""
    return mixing.repeated(mixing.mix(docs, weights=(5, 2, 1), budget=1.5, max_rate=2.0), docs.columns)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens: every row of docs by itself, a null or empty text as its end token alone."""
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), seq_len=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "stream_start")


STAGES = [("language", stage_language), ("lines", stage_lines), ("near_duplicates", stage_near_duplicates), ("mix", stage_mix), ("pack", stage_pack)]

#: Hashes, automata and tokenizers are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
