"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.llm import chat, langid, line_dedup, lm_score, mixing, ngram_join, packing, quality, token_count, topk
from planweave.llm.common import fold


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], turns.schema)
    ex = chat.examples(turns.unionByName(extra))
    ex = ex.select(
        "conv_id", "example", F.length("formatted").cast("long").alias("chars"), F.when(F.col("is_last"), F.col("formatted")).alias("last"),
        chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
    )
    # The rows of a conversation are still together: no second shuffle.
    by = ex.groupBy("conv_id").agg(F.sum("chars").alias("formatted_chars"), F.max("last").alias("last"), F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"))
    by = by.select("conv_id", "formatted_chars", chat.read_turns(F.col("last")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return by.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


OP4_SQL = """
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) AS v(conv_id, turn, role, text)),
numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM turns),
sized AS (
  SELECT *, 12 + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;')) + 1
         + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) + 11 AS chars FROM numbered),
running AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto,
         row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) AS from_end FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR from_end = 1 THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM running GROUP BY conv_id
"""


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), seq_len=4096, end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "stream_start", "continues", "continued")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(_read(spark, sf_dir, "documents"), k=5, percent=80, count_links=True)
    return found.select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


OP7_SQL = """
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM split WHERE len(words) > 0)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS fp FROM shingle GROUP BY doc_id),
class AS (SELECT fp, min(doc_id) AS class_id, any_value(n) AS n, count(*) AS members FROM sets GROUP BY fp),
posted AS (SELECT c.class_id, s.s FROM class c JOIN shingle s ON s.doc_id = c.class_id),
common AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS shared FROM posted a JOIN posted b ON a.s = b.s AND a.class_id < b.class_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN class x ON x.class_id = a JOIN class y ON y.class_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT class_id AS a, class_id AS b FROM class UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
component AS (SELECT a AS class_id, min(b) AS component_id FROM reach GROUP BY a),
linked AS (SELECT e.a AS class_id, sum(c.members) AS n FROM edge e JOIN class c ON c.class_id = e.b GROUP BY e.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(k.component_id, d.doc_id) AS component_id, coalesce(c.class_id, d.doc_id) AS class_id,
       CAST(coalesce(l.n, 0) + coalesce(c.members, 1) - 1 AS BIGINT) AS n_links
FROM documents d LEFT JOIN sets s USING (doc_id) LEFT JOIN class c USING (fp) LEFT JOIN component k USING (class_id) LEFT JOIN linked l USING (class_id)
"""


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_read(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), limit=4096)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"), weights=(5, 2, 1), budget=1.5, max_rate=2.0)
    return mixed.select(
        "doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"),
        (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"), F.col("_mix_rate").alias("rate"), F.col("_mix_copies").alias("copies"),
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = lm_score.score(docs, fold(F.col("doc_id"), 10) != 0)
    return found.select("doc_id", (fold(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("_ld_drop", F.lit(0), lambda a, d: a + d["size"])
    return rows.select("doc_id", removed.cast("long").alias("n_removed"), F.size("_ld_drop").cast("long").alias("n_passages"), "text")


OP3_SQL = """
WITH cut AS (
  SELECT doc_id, text, list_filter(string_split(replace(replace(replace(replace(replace(replace(replace(text, chr(10), chr(10) || chr(1)), '. ', '. ' || chr(1)),
           '! ', '! ' || chr(1)), '? ', '? ' || chr(1)), ', ', ', ' || chr(1)), '; ', '; ' || chr(1)), ': ', ': ' || chr(1)), chr(1)), lambda x: x <> '') AS lines
  FROM documents),
line AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i, len(lines) AS n FROM cut),
bare AS (SELECT *, trim(line) AS b FROM line),
ends AS (
  SELECT *, i = n OR coalesce(md5(b) < lead(md5(b)) OVER w, false) AS ends FROM bare WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM ends),
chunk AS (SELECT doc_id, pos, string_agg(b, chr(10) ORDER BY i) AS t, min(i) AS start, count(*) AS size FROM numbered GROUP BY doc_id, pos HAVING count(*) > 1),
later AS (
  SELECT * FROM (SELECT doc_id, start, start + size - 1 AS last, first_value(doc_id) OVER w AS first_doc, first_value(start) OVER w AS first_start, size
                 FROM chunk WINDOW w AS (PARTITION BY t, size ORDER BY doc_id, start))
  WHERE doc_id <> first_doc OR start <> first_start),
beside AS (SELECT *, coalesce(lag(last) OVER w, 0) AS before, coalesce(lead(start) OVER w, 1 << 30) AS after FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY start)),
grown AS (
  SELECT m.doc_id, m.start, m.last, m.before, m.after, d.side, d.j,
         min(CASE WHEN o.b = f.b THEN 1 ELSE 0 END) OVER (PARTITION BY m.doc_id, m.start, d.side ORDER BY d.j) AS same
  FROM beside m CROSS JOIN (VALUES (-1, 1), (-1, 2), (-1, 3), (1, 1), (1, 2), (1, 3)) AS d(side, j)
  LEFT JOIN bare o ON o.doc_id = m.doc_id AND o.i = CASE d.side WHEN 1 THEN m.last + d.j ELSE m.start - d.j END
  LEFT JOIN bare f ON f.doc_id = m.first_doc AND f.i = CASE d.side WHEN 1 THEN m.first_start + m.size - 1 + d.j ELSE m.first_start - d.j END),
covered AS (
  SELECT doc_id, unnest(range(start, last + 1)) AS i FROM later
  UNION SELECT doc_id, CASE side WHEN 1 THEN last + j ELSE start - j END FROM grown WHERE same = 1 AND CASE side WHEN 1 THEN last + j < after ELSE start - j > before END),
island AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM covered),
sized AS (
  SELECT c.doc_id, c.i, c.k, sum(len(list_filter(string_split_regex(b.line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) OVER (PARTITION BY c.doc_id, c.k) AS words
  FROM island c JOIN bare b USING (doc_id, i)),
gone AS (SELECT * FROM sized WHERE words >= 25),
kept AS (
  SELECT b.doc_id, string_agg(b.line, '' ORDER BY b.i) FILTER (WHERE g.i IS NULL) AS text, count(g.i) AS n_removed, count(DISTINCT g.k) AS n_passages
  FROM bare b LEFT JOIN gone g USING (doc_id, i) GROUP BY b.doc_id)
SELECT c.doc_id, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k.n_passages, 0) AS BIGINT) AS n_passages,
       CASE WHEN c.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM cut c LEFT JOIN kept k USING (doc_id)
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.apply(quality.ledger(_read(spark, sf_dir, "documents")), quality.STANDARD)
    base = quality.fails(quality.BASE).alias("base_failed")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base, "kept", "failures", "n_lines", "n_letters", "n_bullet_lines", "n_ellipsis_lines")


OP6_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
windows AS (
  SELECT row_no, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT row_no, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
twice AS (SELECT row_no, i FROM (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, w) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT row_no, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY row_no),
measures AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(length(regexp_replace(text, '\PL+', '', 'g')) AS BIGINT) AS n_letters,
         CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS BIGINT) AS n_bullet_lines,
         CAST(len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*\z'))) AS BIGINT) AS n_ellipsis_lines
  FROM split LEFT JOIN repeats r USING (row_no)),
rules AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
       + (CASE WHEN 2 * word_chars < 5 * n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars > 14 * n_words THEN 8 ELSE 0 END)
       + (CASE WHEN 10 * n_symbols > n_words THEN 16 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 32 ELSE 0 END)
       + (CASE WHEN 10 * n_letters < 6 * word_chars THEN 64 ELSE 0 END) + (CASE WHEN 10 * n_bullet_lines > 9 * n_lines THEN 128 ELSE 0 END)
       + (CASE WHEN 10 * n_ellipsis_lines > 3 * n_lines THEN 256 ELSE 0 END) AS failures
  FROM measures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept,
       CAST(failures AS BIGINT) AS failures, n_lines, n_letters, n_bullet_lines, n_ellipsis_lines
FROM rules
"""


def ledger_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every rule of the standard policy does to the ledger of op6."""
    return quality.ablate(quality.ledger(_read(spark, sf_dir, "documents")), quality.STANDARD).drop("bit")


ABLATION_SQL = f"""
WITH book AS ({OP6_SQL}), rule AS (SELECT * FROM (VALUES {", ".join(f"('{r}', {quality.BITS[r]})" for r in quality.STANDARD.rules)}) AS r(rule, bit))
SELECT rule, count(*) FILTER (WHERE failures & bit <> 0) AS failed, count(*) FILTER (WHERE failures = bit) AS failed_alone,
       count(*) FILTER (WHERE failures = 0 OR failures = bit) AS kept_without, count(*) FILTER (WHERE failures = 0) AS kept
FROM book, rule GROUP BY rule
"""


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets of op1, a row for each source."""
    sizes = mixing.sized(_read(spark, sf_dir, "documents")).groupBy("source").agg(F.sum("_size").alias("source_size"))
    found = mixing.targets(sizes, (5, 2, 1), 1.5, 2.0)
    return found.select("source", "source_size", F.round("target", 4).alias("target"))


TARGETS_SQL = """
WITH size AS (
  SELECT source, CAST(sum(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS BIGINT) AS source_size FROM documents GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2.0 * source_size AS most FROM size),
ordered AS (
  SELECT *, 1.5 * sum(source_size) OVER () AS total, coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM weighed),
judged AS (SELECT *, most / w <= (total - before) / rest AS full_up FROM ordered),
level AS (SELECT (any_value(total) - coalesce(sum(most) FILTER (WHERE full_up), 0)) / nullif(sum(w) FILTER (WHERE NOT full_up), 0) AS per_weight FROM judged)
SELECT source, source_size, round(CAST(CASE WHEN full_up THEN most ELSE w * per_weight END AS DOUBLE), 4) AS target FROM judged, level
"""


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64.0)


OP9_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT min(row_no) AS row_no, vec_id, e FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id, e),
s AS (
  SELECT q.row_no, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM q JOIN v c ON q.row_no <> c.row_no AND len(q.e) = len(c.e))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    found = langid.identify(docs, langid.sample(docs.filter(~held)))
    return docs.select("doc_id", held.alias("held_out"), found.alias("f")).select("doc_id", "held_out", F.col("f.lang").alias("lang_pred"), F.col("f.score").alias("score"), F.col("f.bits").alias("entropy"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix": op1_mix, "op2_lm_score": op2_lm_score, "op3_line_dedup": op3_line_dedup, "op4_chat_format": op4_chat_format, "op5_pack": op5_pack, "op6_quality": op6_quality, "op7_ngram_join": op7_ngram_join, "op8_token_count": op8_token_count,
        "op9_top_k": op9_top_k, "op10_language": op10_language, "ledger_ablation": ledger_ablation, "mix_targets": mix_targets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op7_ngram_join": OP7_SQL, "ledger_ablation": ABLATION_SQL, "mix_targets": TARGETS_SQL, "op4_chat_format": OP4_SQL, "op6_quality": OP6_SQL, "op9_top_k": OP9_SQL}
