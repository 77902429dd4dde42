"""Chat formatting: event logs folded into conversations and rendered with a loss mask.

A log row is (conv_id, seq, kind, role, text). ``message`` starts a message, ``delta`` appends to the
message that is open, ``edit`` replaces its text, ``regenerate`` drops its text so that later deltas
write it again. Logs are partitioned by conversation and put in the order of
(seq, kind, role, text), nulls first, so ties give one result. Only DataFrame functions are used.

Template: ``### role: text</turn>`` and a newline for each message. Inside roles and texts a
backslash becomes ``\\b``, ``#`` becomes ``\\h``, ``</turn>`` becomes ``<\\sturn>`` and, in roles, a
colon becomes ``\\c``; so no marker can occur in them and the change can be undone.

A conversation is one row of the result, so its log is sorted and folded by one task: that is the bound on a conversation's size (a
row of 2 GB). Conversations are dealt by id, and no two need to meet.

Edge cases: a very long text is escaped and rendered whole; a null text or role counts as empty; a null conv_id is a conversation of its own; repeated rows are
repeated turns; a delta, edit or regeneration before any message opens a message of its own role;
an unknown or null kind counts as ``message``; an empty log gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BACKSLASH = "\\"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit(BACKSLASH), F.lit(r"\b"))
    out = F.replace(out, F.lit("#"), F.lit(r"\h"))
    out = F.replace(out, F.lit("</turn>"), F.lit(r"<\sturn>"))
    return F.replace(out, F.lit(":"), F.lit(r"\c")) if role else out


def unescape(text: Column) -> Column:
    # every backslash in escaped text is followed by one of b, h, s, c; \b goes last
    for mark, plain in ((r"\c", ":"), (r"\s", "/"), (r"\h", "#"), (r"\b", BACKSLASH)):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def fold(log: DataFrame) -> DataFrame:
    """Final messages: conv_id, messages array<struct<seq, role, text>> in order."""
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    kind = F.when(kind.isin("delta", "edit", "regenerate"), kind).otherwise("message")
    events = log.select("conv_id", "seq", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("seq", "kind", "role", "text")
    events = events.withColumn("at", F.row_number().over(order))
    events = events.withColumn("message", F.sum(F.when(F.col("kind") == "message", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    events = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "role", "text"))).alias("e"))
    # the last event that sets the text as a whole, then the deltas after it
    whole = F.array_max(F.transform("e", lambda x: F.when(x["kind"] != "delta", x["at"])))
    rest = F.filter("e", lambda x: x["at"] >= F.coalesce(F.col("whole"), F.lit(0)))
    text = F.array_join(F.transform(rest, lambda x: F.when(x["kind"] == "regenerate", "").otherwise(x["text"])), "")
    events = events.withColumn("whole", whole).select("conv_id", "message", F.element_at("e", 1)["role"].alias("role"), text.alias("text"))
    return events.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", "role", "text"))).alias("messages"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, segments array<struct<text string, loss boolean>>: in sequence they are the formatted text.

    loss is true for the escaped text of assistant messages and false for everything else.
    """
    parts = F.transform(
        "messages",
        lambda m: F.array(
            F.struct(F.concat(F.lit("### "), escape(m["role"], role=True), F.lit(": ")).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(m["text"]).alias("text"), (m["role"] == "assistant").alias("loss")),
            F.struct(F.lit("</turn>\n").alias("text"), F.lit(False).alias("loss")),
        ),
    )
    return messages.select("conv_id", F.flatten(parts).alias("segments"))


def format_chats(log: DataFrame) -> DataFrame:
    """conv_id, formatted string, segments (see render)."""
    out = render(fold(log))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parse(formatted: Column) -> Column:
    """The turns of a formatted text: array<struct<role, text>>."""
    pieces = F.filter(F.split(formatted, "</turn>\n"), lambda p: p != "")
    def turn(p: Column) -> Column:
        at = F.instr(p, F.lit(": "))
        return F.struct(unescape(F.substring(p, F.lit(5), at - 5)).alias("role"), unescape(F.substring(p, at + 2, F.length(p))).alias("text"))
    return F.transform(pieces, turn)
