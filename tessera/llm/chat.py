"""Chat formatting from an event log, in DataFrame operations only.

A conversation is a log of events ordered by sequence number: ``start`` opens a
message with a role, ``delta`` appends to it, ``edit`` puts a new text in the
place of what it held, ``regenerate`` empties it so that what follows is
written anew, ``delete`` takes it away.  A message's text is what stands from
its last edit or regeneration on, in order.  Messages come out in the order of
their first event and are rendered by a template:

``<s>`` at the start, then for each message ``[SYS]``, ``[INST]`` or ``[ASST]``,
the text, and ``[/]``; any other role stands in its mark after ``ROLE``.  Texts
are escaped so that they can hold no mark: ``\\`` becomes ``\\\\``, ``<`` becomes
``\\l``, ``[`` becomes ``\\b``; ``unescape`` undoes it exactly.  Only marks hold
a bare ``<`` or ``[``, so a rendered conversation can be read back from its
text alone.  The loss mask is a list of spans: the assistants' texts.

A rendered conversation is one value, so its length is limited by that of a
value.  Events are folded message by message first, so of a hot conversation
only its messages meet in one task, not its events.

Defined results: null texts are empty, null roles are empty roles, null ids are
one conversation; events of equal sequence number are ordered by kind and text;
a conversation of which all messages are deleted is the start mark alone; an
empty log gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<s>", "[/]"
#: Role and its mark; any other role is written into the mark after ``ROLE ``.
MARKS = {"system": "SYS", "user": "INST", "assistant": "ASST"}
OTHER = "ROLE "
LOSS_ROLE = "assistant"
_REST = 2**31 - 1


def escape(text: Column) -> Column:
    """The text without bare ``<`` and ``[``."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("]"), F.lit("\\e"))


def unescape(text: Column) -> Column:
    """The inverse of escape: doubled backslashes are parted from the left, so what is left holds single ones only."""

    def single(t: Column) -> Column:
        return F.replace(F.replace(F.replace(t, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\e"), F.lit("]"))

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), single), "\\")


def events_of_turns(turns: DataFrame, conversation: str = "conv_id", sequence: str = "turn") -> DataFrame:
    """A log with a start and a delta for each row of a table of finished turns.

    Rows with the same conversation and sequence number are messages of their
    own, in the order of role and a hash of the text; equal rows are told apart
    by a row number, whose value has no effect on the result.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    message = F.struct(F.col(sequence).alias("at"), role.alias("role"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    rows = turns.select(F.col(conversation).alias("conv_id"), message.alias("message"), text.alias("text"))
    kinds = F.array(F.struct(F.lit("start").alias("kind"), F.col("message.role").alias("text")), F.struct(F.lit("delta").alias("kind"), F.col("text")))
    rows = rows.select("conv_id", "message", F.posexplode(kinds).alias("step", "event"))
    return rows.select("conv_id", F.struct("message", "step").alias("seq"), "message", "event.kind", "event.text")


def messages(events: DataFrame) -> DataFrame:
    """The messages of a log (conv_id, seq, message, kind, text): conv_id, first (their order), role, text, gone.

    seq may be of any type with an order.
    """
    anew = F.when(F.col("kind").isin("edit", "regenerate"), F.struct("seq", "kind"))
    folded = (
        events.select("conv_id", "seq", "message", "kind", F.coalesce(F.col("text"), F.lit("")).alias("text"))
        .groupBy("conv_id", "message")
        .agg(
            F.min("seq").alias("first"),
            F.min(F.when(F.col("kind") == "start", F.struct("seq", "text"))).getField("text").alias("role"),
            F.max(F.col("kind") == "delete").alias("gone"),
            F.max(anew).alias("anew"),
            F.collect_list(F.when(F.col("kind").isin("delta", "edit"), F.struct("seq", (F.col("kind") == "delta").alias("after"), "text"))).alias("parts"),
        )
    )
    last = F.col("anew.seq")
    live = F.filter("parts", lambda p: last.isNull() | (p["seq"] > last) | ((p["seq"] == last) & (~p["after"] | (F.col("anew.kind") == "edit"))))
    whole = F.array_join(F.transform(F.array_sort(live), lambda p: p["text"]), "")
    return folded.select("conv_id", "first", F.coalesce("role", F.lit("")).alias("role"), whole.alias("text"), F.coalesce("gone", F.lit(False)).alias("gone"))


def render(events: DataFrame) -> DataFrame:
    """conv_id, formatted, and loss (the mask: start and length in code points) of each conversation in the log."""
    mark = F.coalesce(*[F.when(F.col("role") == r, F.lit(m)) for r, m in MARKS.items()], F.concat(F.lit(OTHER), _escape_role(F.col("role"))))
    turns = messages(events).select("conv_id", "first", "gone", "role", F.concat(F.lit("["), mark, F.lit("]")).alias("head"), escape(F.col("text")).alias("body"))
    size = F.when(F.col("gone"), 0).otherwise(F.length("head") + F.length("body") + len(END)).cast("long")
    before = F.sum(size).over(Window.partitionBy("conv_id").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    start = len(START) + F.coalesce(before, F.lit(0)) + F.length("head")
    span = F.when(F.col("role") == LOSS_ROLE, F.struct(start.cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    turn = F.when(~F.col("gone"), F.struct("first", F.concat("head", "body", F.lit(END)).alias("out"), span.alias("span")))
    done = turns.select("conv_id", turn.alias("turn")).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return done.select(
        "conv_id",
        F.concat(F.lit(START), F.array_join(F.transform("turns", lambda t: t["out"]), "")).alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a rendered conversation, in order, from its text alone."""

    def turn(piece: Column) -> Column:
        mark = F.substring_index(F.substring(piece, 2, _REST), "]", 1)
        role = F.coalesce(*[F.when(mark == m, F.lit(r)) for r, m in MARKS.items()], unescape(F.substring(mark, len(OTHER) + 1, _REST)))
        return F.struct(role.alias("role"), unescape(F.substring(piece, F.length(mark) + 3, F.length(piece))).alias("text"))

    pieces = F.split(F.substring(formatted, len(START) + 1, _REST), r"\[/\]", -1)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)  # nothing follows the last end mark


def under_loss(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
