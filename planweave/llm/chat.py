"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, then that reply,
which alone lies under the loss mask. A conversation that does not end with a reply leaves a last
example with an empty mask, so that its output holds every turn. One shuffle, by conversation.

Template: `<|im_start|>role\\ntext<|im_end|>\\n` per turn. Inside roles and texts `&`, `<` and `[` are
written as entities (and, in roles, line feeds), so no control string of this or another template
(`</s>`, `[INST]`, ...) survives in a text; unescape() restores it exactly.

Edge cases: rows are ordered by turn, then role, then text, nulls first; repeated rows stay; a null
role or text counts as empty; rows with a null id form one conversation with a null id; other columns
are ignored; a text of any length is formatted whole; an empty table gives no examples. A conversation is one row, as the sum of
its examples grows with the square of its turns by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escape(text: Column) -> Column:
    for raw, entity in ENTITIES:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for raw, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def examples(conversations: DataFrame, reply_role: str = "assistant") -> DataFrame:
    """conv_id, example (from 1), is_last, formatted, loss_start, loss_end (code points, end excluded)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    convs = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", text("text").alias("text")))).alias("turns"))
    marked = F.transform(
        "turns",
        lambda t: F.struct((t["role"] == reply_role).alias("reply"), F.concat(F.lit(OPEN), _role(F.coalesce(t["role"], F.lit(""))), F.lit("\n")).alias("head"), escape(t["text"]).alias("body")),
    )
    convs = convs.select("conv_id", marked.alias("marked"))
    size = lambda t: F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)
    upto = F.aggregate("marked", F.array().cast("array<int>"), lambda a, t: F.concat(a, F.array(F.coalesce(F.element_at(F.when(F.size(a) > 0, a), -1), F.lit(0)) + size(t))))
    told = F.array_join(F.transform("marked", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    convs = convs.select("conv_id", "marked", upto.alias("upto"), told.alias("told"))
    n = F.size("marked")
    end = lambda i: F.get("upto", i)
    is_reply = lambda t: F.coalesce(t["reply"], F.lit(False))
    span = lambda last, start, stop, total: F.struct(last.alias("is_last"), start.alias("loss_start"), stop.alias("loss_end"), total.alias("total"))
    replies = F.transform("marked", lambda t, i: F.when(is_reply(t), span(i == n - 1, end(i) - len(CLOSE) - F.length(t["body"]), end(i) - len(CLOSE), end(i))))
    rest = F.when(~is_reply(F.element_at("marked", -1)), F.array(span(F.lit(True), end(n - 1), end(n - 1), end(n - 1))))
    spans = F.concat(F.array_compact(replies), F.coalesce(rest, F.array().cast("array<struct<is_last:boolean,loss_start:int,loss_end:int,total:int>>")))
    # An example is a prefix of the conversation; the rows that are made carry its text once and a few numbers.
    rows = convs.select("conv_id", "told", F.posexplode(spans).alias("pos", "s"))
    return rows.select("conv_id", (F.col("pos") + 1).alias("example"), "s.is_last", F.substring(F.col("told"), F.lit(1), F.col("s.total")).alias("formatted"), "s.loss_start", "s.loss_end")


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """The original text under the loss mask."""
    return unescape(F.substring(formatted, start + 1, end - start))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted text holds."""
    parts = F.slice(F.split(formatted, r"<\|im_end\|>\n"), 1, F.size(F.split(formatted, r"<\|im_end\|>\n")) - 1)

    def turn(p: Column) -> Column:
        gap = F.instr(p, "\n")
        role = F.substring(p, F.lit(len(OPEN) + 1), gap - len(OPEN) - 1)
        return F.struct(unescape(F.replace(role, F.lit("&#10;"), F.lit("\n"))).alias("role"), unescape(F.substring(p, gap + 1, F.length(p))).alias("text"))

    return F.transform(parts, turn)
