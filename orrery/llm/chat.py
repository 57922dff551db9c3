"""Chat formatting: conversations rebuilt from an event log, then rendered, with native expressions only.

An event is (conv_id, seq, kind, turn, role, text). ``message``, ``edit`` and ``regenerate`` (re)start the text of a turn
with their own text, ``delta`` appends to it; a ``regenerate`` also drops the events that came before it for later turns.
Null text is empty; a null kind counts as ``message``. Events of one conversation with the same seq are taken in the
order of turn, role, text; equal ones count each. Rows without a conversation are one conversation, which, like any other, is
rebuilt and rendered whole, in one row. Other columns are dropped, whatever their names; no events give no conversations.

A rendered turn is ``<turn ROLE>\\nTEXT</turn>\\n``. ``&``, ``<`` and ``>`` inside roles and texts become ``&amp;``, ``&lt;``
and ``&gt;``, so no text can hold a control string, and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

OPEN, HEAD, CLOSE = "<turn ", ">\n", "</turn>\n"
RESTARTS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def rows_as_events(conversations: DataFrame) -> DataFrame:
    """Each row (conv_id, turn, role, text) is one whole message; rows go by turn, then role and text. A row with a turn
    that another row has too is a message of its own. Other columns are dropped."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    return conversations.select("conv_id", "turn", "role", "text").select(
        "conv_id", F.row_number().over(order).cast("long").alias("seq"), F.lit("message").alias("kind"), F.row_number().over(order).cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), "text"
    )


def reconstruct(events: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<turn, role, text>>: the final messages of each conversation, in the order of turns."""
    events = events.select("conv_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    later = W.partitionBy("conv_id").orderBy(F.col("seq").desc(), F.col("turn").desc(), F.col("role").desc(), F.col("text").desc()).rowsBetween(W.unboundedPreceding, -1)
    live = events.withColumn("cut", F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later)).where(F.col("cut").isNull() | F.col("turn").isNull() | (F.col("turn") <= F.col("cut")))
    by_turn = W.partitionBy("conv_id", "turn")
    started = F.sum(F.col("kind").isin(*RESTARTS).cast("long")).over(by_turn.orderBy("seq", "role", "text").rowsBetween(W.unboundedPreceding, 0))
    newest = live.withColumn("version", started).withColumn("last", F.max("version").over(by_turn)).where("version = last")
    pieces = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("role", F.lit("")).alias("role"), "text")))
    messages = newest.groupBy("conv_id", "turn").agg(pieces.alias("pieces"), F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"))
    message = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"))
    return messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("turns"))


def render(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss array<struct<turn int, start int, end int>>: the mask gives, by the turn's number from 0,
    the characters start:end of that turn in ``formatted`` that count for the loss."""
    head = lambda m: F.concat(F.lit(OPEN), escape(m["role"]), F.lit(HEAD))
    parts = F.transform("turns", lambda m: F.concat(head(m), escape(m["text"]), F.lit(CLOSE)))
    spans = F.transform(
        "turns",
        lambda m, i: F.struct(
            i.alias("turn"), F.length(head(m)).alias("start"), (F.length(head(m)) + F.length(escape(m["text"]))).alias("end"), m["role"].isin(*loss_roles).alias("counts")
        ),
    )
    spans = F.transform(F.filter(spans, lambda s: s["counts"]), lambda s: F.struct(s["turn"].alias("turn"), s["start"].alias("start"), s["end"].alias("end")))
    return conversations.select("conv_id", F.array_join(parts, "").alias("formatted"), spans.alias("loss"))


def parse(formatted: DataFrame) -> DataFrame:
    """Reads ``render``'s output back: conv_id, formatted, turns array<struct<role, text>>, loss_text."""
    cut = formatted.withColumn("parts", F.split("formatted", CLOSE)).withColumn("parts", F.slice("parts", 1, F.size("parts") - 1))

    def turn(p: Column) -> Column:
        at = F.instr(p, HEAD)
        inner = F.substring(p, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        return F.struct(unescape(inner).alias("role"), unescape(F.substring(p, at + len(HEAD), F.length(p))).alias("text"))

    lost = F.transform("loss", lambda s: unescape(F.substring(F.get("parts", s["turn"]), s["start"] + 1, s["end"] - s["start"])))
    return cut.select("conv_id", "formatted", F.transform("parts", turn).alias("turns"), F.array_join(lost, "").alias("loss_text"))


def format_chats(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """The operator: event log in, rendered conversations with their loss mask out."""
    return render(reconstruct(events), loss_roles)
