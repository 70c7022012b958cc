"""Conversations rebuilt from an event log and rendered for training.

Events have conv_id, seq, kind, message, role and text. Per conversation, in order of seq:

- `message` starts (or restarts) message number `message` with a role and a text,
- `delta` appends streamed text to it,
- `edit` replaces its text so far,
- `regenerate` empties it and drops every later message that was written before.

The fold is relational: a message's text is what follows its last start, edit or regeneration. So it needs
no state across rows, and all sorting is done by Spark per conversation.

Rendered form: `<s>`, then per message `[INST]role[SAY]text[/INST]`, or `[OUT]role[SAY]text</s>` for the
assistant. Inside roles and texts a backslash is doubled and every control string gets one after its first
character, so rendered text holds control strings at turn marks only and can be read back.

Only DataFrame functions are used. Null texts and roles count as empty, a null conversation id is a
conversation, events that tie on seq are ordered by their other columns, and conversations without a
message left give no row. A conversation is one row of the result, so it must fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Control strings of the template. Fixed values.
BEGIN, CLOSE, OPEN_USER, CLOSE_USER, OPEN_MODEL, SAY = "<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[SAY]"
CONTROLS = (BEGIN, CLOSE, OPEN_USER, CLOSE_USER, OPEN_MODEL, SAY)


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROLS:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, message, role, text."""
    order = F.struct("seq", "kind", "role", "text")
    per_message = Window.partitionBy("conv_id", "message").orderBy("seq", "kind", "role", "text")
    # a window ordered by message sees regenerations of earlier messages only
    earlier = (
        Window.partitionBy("conv_id").orderBy("message").rangeBetween(Window.unboundedPreceding, -1)
    )
    starts = F.col("kind").isin("message", "edit", "regenerate")
    version = F.sum(starts.cast("int")).over(per_message)
    pieces = (
        events.withColumn("message", F.col("message").cast("long"))
        .withColumn("_version", version)
        .withColumn("_redone", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier))
        .filter(F.col("_redone").isNull() | (F.col("seq") > F.col("_redone")))
    )
    last = F.max("_version").over(Window.partitionBy("conv_id", "message"))
    return (
        pieces.withColumn("_last", last)
        .groupBy("conv_id", "message")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("_version") == F.col("_last"), order))).alias("_events"),
            F.max_by("role", F.when(F.col("role").isNotNull() & (F.col("kind") == "message"), F.col("seq"))).alias("role"),
        )
        .select(
            "conv_id", "message", F.coalesce("role", F.lit("")).alias("role"),
            F.array_join(
                F.transform(
                    "_events",
                    lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(F.coalesce(e["text"], F.lit(""))),
                ),
                "",
            ).alias("text"),
        )
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted text, and `loss`: byte spans (start, length) of the assistant texts in it."""
    assistant = F.col("role") == "assistant"
    head = F.concat(F.when(assistant, F.lit(OPEN_MODEL)).otherwise(F.lit(OPEN_USER)), escape(F.col("role")), F.lit(SAY))
    body = escape(F.col("text"))
    tail = F.when(assistant, F.lit(CLOSE)).otherwise(F.lit(CLOSE_USER))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("head") + F.octet_length("body") + F.octet_length("tail")
    placed = messages.select(
        "conv_id", "message", assistant.alias("learn"), head.alias("head"), body.alias("body"), tail.alias("tail")
    ).withColumn(
        "start", F.coalesce(F.sum(size).over(before), F.lit(0)) + len(BEGIN) + F.octet_length("head")
    )
    turn = F.struct("message", "learn", "start", F.octet_length("body").cast("long").alias("length"), F.concat("head", "body", "tail").alias("piece"))
    return (
        placed.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .select(
            "conv_id",
            F.concat(F.lit(BEGIN), F.array_join(F.transform("turns", lambda t: t["piece"]), "")).alias("formatted"),
            F.transform(
                F.filter("turns", lambda t: t["learn"]),
                lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")),
            ).alias("loss"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from rendered text."""
    pieces = F.split(F.substring(formatted, len(BEGIN) + 1, 2**31 - 1), r"(?=\[INST\]|\[OUT\])")
    marked = F.filter(pieces, lambda p: p != "")

    def turn(piece: Column) -> Column:
        inner = F.regexp_extract(piece, r"(?s)^\[(?:INST|OUT)\](.*?)\[SAY\](.*)(?:\[/INST\]|</s>)$", 0)
        role = F.regexp_extract(inner, r"(?s)^\[(?:INST|OUT)\](.*?)\[SAY\]", 1)
        text = F.regexp_replace(inner, r"(?s)^\[(?:INST|OUT)\].*?\[SAY\]|(?:\[/INST\]|</s>)$", "")
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(marked, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """Text under the loss spans, unescaped."""
    # bytes can be cut at any place without walking over the text from its start
    parts = F.transform(
        F.array(F.encode(formatted, "UTF-8")),
        lambda raw: F.array_join(
            F.transform(
                loss,
                lambda s: unescape(F.decode(F.substring(raw, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8")),
            ),
            "",
        ),
    )
    return parts[0]
