"""Replies of a model, given as a table: tolerant parsing, merging into pages, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweave.operators import rules as R


def _scalar(text: Column, key: str) -> Column:
    """The last string given for a key."""
    return F.element_at(F.when(F.regexp_like(text, F.lit(f'"{key}"\\s*:\\s*"')), F.regexp_extract_all(text, F.lit(f'"{key}"\\s*:\\s*"([^"]*)"'), F.lit(1))), -1)


def balanced(text: Column, opening: str = "{", closing: str = "}") -> Column:
    """The first balanced object of a text (brackets inside strings do not count), null if none ends. A fold over
    the characters from the first brace on."""
    rest = F.substring(text, F.instr(text, opening), F.length(text))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(a: Column, c: Column) -> Column:
        plain = ~a["escaped"] & ~a["quoted"] & (a["end"] == 0)
        depth = a["depth"] + F.when(plain & (c == opening), 1).when(plain & (c == closing), -1).otherwise(0)
        quoted = F.when((c == '"') & ~a["escaped"], ~a["quoted"]).otherwise(a["quoted"])
        end = F.when(plain & (c == closing) & (depth == 0), a["at"] + 1).otherwise(a["end"])
        return F.struct(depth.alias("depth"), quoted.alias("quoted"), (~a["escaped"] & (c == "\\")).alias("escaped"), (a["at"] + 1).alias("at"), end.alias("end"))

    end = F.aggregate(F.split(rest, ""), start, step, lambda a: a["end"])
    return F.when(F.contains(text, F.lit(opening)), _bind(end, lambda e: F.when(e > 0, F.substring(rest, F.lit(1), e))))


def _bind(made: Column, body) -> Column:
    """body(made), with made computed once."""
    return F.element_at(F.transform(F.array(made), body), 1)


def _fixed(text: Column) -> Column:
    """Without commas before a closing bracket."""
    return F.regexp_replace(text, r",\s*([}\]])", "$1")


def unfenced(reply: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(reply, r"```(?:json)?\s*", ""), r"\s*```", ""))


def parse(reply: Column) -> Column:
    """struct<page_type, confidence>, null if the reply holds no object. Steps: drop code fences and parse; else the first balanced
    object; else that without trailing commas; what is cut off is scraped by field. An object without a known type is OTHER."""

    def of(body: Column) -> Column:
        read = lambda x: F.from_json(x, "map<string,string>")
        simple = F.when(body.rlike(r"(?s)^\{.*\}$"), read(body))

        def found(whole: Column) -> Column:
            got = F.coalesce(simple, read(whole), read(_fixed(whole)))
            cut = F.substring(body, F.instr(body, "{"), F.length(body))
            scraped = F.when(F.contains(body, F.lit("{")) & cut.rlike(r'"\w+"\s*:\s*("[^"]*"|(?i:true|false)\b|\d+\s*[,}])'), F.create_map(F.lit("page_type"), _scalar(cut, "page_type"), F.lit("confidence"), _scalar(cut, "confidence")))
            return _bind(F.coalesce(got, scraped), told)

        return _bind(F.when(simple.isNull(), balanced(body)), found)

    def told(m: Column) -> Column:
        kind = F.upper(F.trim(F.coalesce(F.element_at(m, "page_type"), F.lit(""))))
        sure = F.lower(F.trim(F.coalesce(F.element_at(m, "confidence"), F.lit("low"))))
        return F.when(m.isNotNull(), F.struct(F.when(kind.isin(*R.PAGE_TYPES), kind).otherwise("OTHER").alias("page_type"), F.when(sure.isin("high", "medium", "low"), sure).otherwise("low").alias("confidence")))

    return _bind(unfenced(reply), of)


def json_array(reply: Column) -> Column:
    """The text from the first opening to the last closing square bracket, null without them."""
    return F.nullif(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), F.lit(""))


def fixture_records(reply: Column) -> Column:
    """array of the nine fields, from a reply that lists fixtures; of a list that is cut off, the objects that are whole."""
    names = list(R.FIELDS)
    schema = ", ".join(f"{f} string" for f in names)

    def of(body: Column) -> Column:
        valid = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
        whole = _bind(F.coalesce(balanced(body), body), lambda x: F.from_json(F.coalesce(valid(x), valid(_fixed(x))), f"fixtures array<struct<{schema}>>")["fixtures"])
        part = F.regexp_extract(body, r'(?s)"fixtures"\s*:\s*\[(.*)$', 1)
        objects = F.regexp_extract_all(part, F.lit(r"(\{(?:[^{}\"]|\"(?:[^\"\\]|\\.)*\")*\})"), F.lit(1))
        pieces = F.filter(F.transform(objects, lambda o: F.from_json(F.coalesce(valid(o), valid(_fixed(o))), schema)), lambda o: o.isNotNull())
        rows = F.coalesce(whole, F.when(F.size(pieces) > 0, pieces), F.array().cast(f"array<struct<{', '.join(f'{f}:string' for f in names)}>>"))
        return F.transform(rows, lambda r: F.struct(*[F.coalesce(r[f], F.lit("")).alias(f) for f in names]))

    return _bind(unfenced(reply), of)


def merge(pages: DataFrame, replies: DataFrame) -> DataFrame:
    """Pages with vlm_page_type, vlm_confidence, vlm_agrees; a sure disagreement overrides type,
    relevance and source, an agreed schedule becomes relevant."""
    got = replies.select("document_id", "page_number", parse(F.col("reply_text")).alias("r"))
    rows = pages.join(got, ["document_id", "page_number"], "left")
    kind, agrees = F.col("r.page_type"), F.col("r.page_type") == F.coalesce("page_type", F.lit("OTHER"))
    over = F.coalesce(~agrees & (F.col("r.confidence") == "high"), F.lit(False))
    confirmed = F.coalesce(agrees & (kind == "SCHEDULE"), F.lit(False))
    return rows.select(
        *[c for c in pages.columns if c not in ("page_type", "is_relevant", "confidence_source")],
        F.when(over, kind).otherwise(F.col("page_type")).alias("page_type"),
        F.when(over, kind.isin(*R.VERIFY_RELEVANT)).when(confirmed, F.lit(True)).otherwise(F.col("is_relevant")).alias("is_relevant"),
        F.when(over, "vlm_override").otherwise(F.col("confidence_source")).alias("confidence_source"),
        kind.alias("vlm_page_type"), F.col("r.confidence").alias("vlm_confidence"), agrees.alias("vlm_agrees"),
    )


def tallies(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id").agg(
        F.count_if("vlm_agrees").alias("agree"), F.count_if(~F.col("vlm_agrees")).alias("disagree"), F.count_if(F.col("vlm_agrees").isNull()).alias("skipped"),
        F.count_if(F.col("confidence_source") == "vlm_override").alias("overridden"),
    )


def table_verdict(tables: DataFrame, replies: DataFrame) -> DataFrame:
    """Per document only its first schedule page is asked; a negative answer drops the schedule, no
    answer keeps it. tables(document_id, page_number); replies(document_id, page_number, reply_text)."""
    first = tables.groupBy("document_id").agg(F.min("page_number").alias("page_number"))
    rows = first.join(replies, ["document_id", "page_number"], "left").withColumn("kind", parse(F.col("reply_text"))["page_type"])
    return rows.select("document_id", "page_number", F.col("kind").alias("answer"), (F.col("kind").isNull() | (F.col("kind") == "SCHEDULE")).alias("kept"))
