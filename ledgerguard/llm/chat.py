"""Conversations as training text with a loss mask, checked by parsing the text again.

Grammar. A conversation is the text of its turns one after another; a turn is three parts::

    ### <role>
    <text>
    </turn>

with a line feed at the end. A line that starts with a control string (``### `` or ``</turn>``) is reserved for
the template, and a backslash in front of a control string is an escape: the parser takes one such backslash
away, wherever it stands. In roles a backslash is written ``\\s`` and a line feed ``\\n``.

``render`` writes a turn as it is, parses what it wrote and compares the turn found with the source. Where they
differ, the conflicting content is escaped, first only what the grammar reads differently, then every control
string, until the parser gives back the source. Texts that hold nothing of the template stay as they are.

Turns go into rows of at most ``SEGMENT_TURNS`` turns, one row for all conversations but very long ones, whose
turns are numbered without meeting in one task. Digests of a conversation need its text in one value, as SHA-256
has no other form; so one conversation's text is limited by Spark's size of a string (2 GB).

Defined cases: null texts and roles are empty; null conversation ids are one conversation; turns are ordered by
(turn, role, text), null turns first, and repeated rows are turns of their own; an empty table gives no rows; other
columns are left alone. Only functions of Spark are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerguard.llm.common import bind
from ledgerguard.plans.ranking import null_safe_join, rank_within

LOSS_ROLE = "assistant"
SEGMENT_TURNS = 256
END = "\n</turn>\n"
CONTROL = "(### |</turn>)"
RESERVED = "(^|\n)" + CONTROL  # a line of the template
CONFLICT = r"(^|[\n\\])" + CONTROL  # what the parser reads otherwise than it was written


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n"))


def _plain_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def _plain_text(body: Column) -> Column:
    return F.regexp_replace(body, r"\\" + CONTROL, "$1")


def _head(role: Column) -> Column:
    return F.concat(F.lit("### "), _escape_role(role), F.lit("\n"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, array<struct<role, text>>; null for a text that the grammar does not have."""
    def turn(piece: Column) -> Column:
        first = F.substring_index(piece, "\n", 1)
        body = F.substr(piece, F.length(first) + 2)
        good = F.startswith(piece, F.lit("### ")) & (F.length(first) < F.length(piece)) & ~F.rlike(body, F.lit(RESERVED))
        return F.when(good, F.struct(_plain_role(F.substr(first, F.lit(5))).alias("role"), _plain_text(body).alias("text")))

    def whole(pieces: Column) -> Column:
        return F.when(F.element_at(pieces, -1) == "", F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn))

    turns = bind(F.split(formatted, END, -1), whole)
    return F.when(~F.exists(turns, lambda t: t.isNull()), turns)


def render(role: Column, text: Column) -> Column:
    """struct<head, body> of a turn: the first way to write it that the parser gives back unchanged."""
    ways = [text, F.regexp_replace(text, CONFLICT, r"$1\\$2"), F.regexp_replace(text, CONTROL, r"\\$1")]

    def same(body: Column) -> Column:
        back = bind(parse(F.concat(_head(role), body, F.lit(END))),
                    lambda t: (F.size(t) == 1) & (t[0]["role"] == role) & (t[0]["text"] == text))
        return F.coalesce(back, F.lit(False))

    body = F.raise_error(F.concat(F.lit("turn without a round trip: "), text))
    for way in reversed(ways):
        body = F.when(same(way), way).otherwise(body)
    return F.struct(_head(role).alias("head"), body.alias("body"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, segment, formatted, loss): the text of each segment of a conversation
    and where its loss mask is set, array<struct<start, length>> in code points from 0."""
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = rows.groupBy("conv_id").count().where(F.col("count") > SEGMENT_TURNS).select("conv_id", F.lit(True).alias("long"))
    rows = null_safe_join(rows, sizes, ["conv_id"], "left")
    short = rows.where("long is null").withColumn("segment", F.lit(0).cast("long"))
    long = rows.where("long").withColumn("row", F.monotonically_increasing_id())
    long = (rank_within(long, ["conv_id"], ["turn", "role", "text", "row"], out="n").drop("row")
            .withColumn("segment", F.floor((F.col("n") - 1) / SEGMENT_TURNS)).drop("n"))
    written = short.unionByName(long).withColumn("turn_text", render(F.col("role"), F.col("text")))
    in_order = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "turn_text")))
    segments = written.groupBy("conv_id", "segment").agg(in_order.alias("turns"))

    def add(state: Column, t: Column) -> Column:
        start, n = state["at"] + F.length(t["turn_text"]["head"]), F.length(t["turn_text"]["body"])
        span = F.struct(start.alias("start"), n.alias("length"))
        return F.struct((start + n + len(END)).alias("at"),
                        F.when(t["role"] == LOSS_ROLE, F.concat(state["loss"], F.array(span))).otherwise(state["loss"]).alias("loss"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["turn_text"]["head"], t["turn_text"]["body"], F.lit(END))), "")
    return segments.select("conv_id", "segment", text.alias("formatted"), F.aggregate("turns", begin, add, lambda s: s["loss"]).alias("loss"))


def read_conversations(written: DataFrame) -> DataFrame:
    """One row for each conversation of a formatted table: its turns as the parser finds them and the text under
    the loss mask, as counts and digests."""
    def said(t: Column) -> Column:
        return F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))

    def masked(s: Column) -> Column:
        return _plain_text(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))

    parts = written.select("conv_id", "segment", F.length("formatted").cast("long").alias("n"), parse(F.col("formatted")).alias("turns"),
                           F.array_join(F.transform("loss", masked), "").alias("loss_text"))
    parts = parts.select("conv_id", "n", F.size("turns").cast("long").alias("n_turns"), F.length("loss_text").cast("long").alias("loss_chars"),
                         F.struct("segment", F.array_join(F.transform("turns", said), "").alias("text"), "loss_text").alias("part"))
    whole = parts.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.sum("loss_chars").alias("loss_chars"),
                                         F.sum("n").alias("formatted_chars"), F.array_sort(F.collect_list("part")).alias("parts"))

    def digest(field: str) -> Column:
        return F.sha2(F.array_join(F.transform("parts", lambda p: p[field]), "").cast("binary"), 256)

    return whole.select("conv_id", "n_turns", digest("text").alias("turns_sha256"), "loss_chars", digest("loss_text").alias("loss_sha256"), "formatted_chars")
