"""Chat formatting from event logs: messages are rebuilt from their events, then rendered.

A log has one row per event: conversation, sequence number, message (any type that sorts:
its place in the conversation), kind, role, text. Kinds: ``start`` opens a message,
``delta`` appends to its text, ``edit`` puts its text in the place of all so far,
``regenerate`` throws all so far away. Other kinds are ignored.

A log that is partitioned by conversation is not shuffled again. A window finds each
message's last event that starts its text anew; only events from there on are gathered, so
drafts that were thrown away never are. Nothing but a conversation's final messages meets in one row, which is the
formatted conversation itself. That row is one training sample and cannot be split.

The template puts every turn between control strings. A control string inside a text or a
role gets one more backslash behind its first character than it has; reading takes one away,
so every text comes back as it was. ``segments`` holds the formatted text in pieces, each
with its loss flag: the flag is set on the texts of assistant turns and on nothing else.

Events of a message are ordered by sequence number, then kind (start, regenerate, edit,
delta), then text; nulls come first. Repeated events count as often as they occur. The role
is the last that is not null, else empty; null texts are empty. A null conversation id is an
id of its own. Messages without an event of a known kind do not exist. An empty log gives an
empty result; other columns are ignored. A message without text is a turn with empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN = "<s>"
# Control strings around a turn: role, opening, closing. Other roles are named in the opening.
TURNS = (
    ("user", "[INST] ", " [/INST]"),
    ("system", "[SYS] ", " [/SYS]"),
    ("assistant", "[OUT] ", " </s>"),
)
NAMED_OPENING, NAMED_MIDDLE, NAMED_CLOSING = "[ROLE] ", " [/ROLE] ", " [/TURN]"
LEARNED = "assistant"
CONTROL = r"(?:/?s>|/?INST\]|/?SYS\]|OUT\]|/?ROLE\]|/TURN\])"
CLOSINGS = r" (?:\[/INST\]|\[/SYS\]|</s>|\[/TURN\])"
OPENING = r"(?s)^(?:\[(INST|SYS|OUT)\] |\[ROLE\] (.*?) \[/ROLE\] )"
# Kinds in the order in which events of one sequence number take effect.
KINDS = ("start", "regenerate", "edit", "delta")
DELTA = KINDS.index("delta")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)(" + CONTROL + ")", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*" + CONTROL + ")", "$1$2")


def messages(events: DataFrame) -> DataFrame:
    """conv_id, message, role, text: final messages of the event log."""
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    known = events.withColumn("place", place).filter("place >= 0").select(
        "conv_id", "message", "role",
        F.struct("seq", "place", F.coalesce("text", F.lit("")).alias("text")).alias("event"),
    )
    anew = F.max(F.when(F.col("event.place") != DELTA, F.col("event")))
    last = known.withColumn("anew", anew.over(Window.partitionBy("conv_id", "message")))
    live = last.filter("anew IS NULL OR event >= anew OR role IS NOT NULL")
    # A role may stand on an event whose text is gone; that event then gives its role only.
    text = F.when(F.col("anew").isNull() | (F.col("event") >= F.col("anew")), F.col("event"))
    parts = F.transform(F.sort_array(F.collect_list(text)), lambda e: F.when(e["place"] == KINDS.index("regenerate"), "").otherwise(e["text"]))
    return live.groupBy("conv_id", "message").agg(
        F.coalesce(F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("event", "role"))), F.lit("")).alias("role"),
        F.array_join(parts, "").alias("text"),
    )


def turn_segments(role: Column, text: Column) -> Column:
    """Opening, escaped text and closing of a turn, each with its loss flag."""
    opening = F.concat(F.lit(NAMED_OPENING), escape(role), F.lit(NAMED_MIDDLE))
    closing = F.lit(NAMED_CLOSING)
    for name, start, end in TURNS:
        opening = F.when(role == name, F.lit(start)).otherwise(opening)
        closing = F.when(role == name, F.lit(end)).otherwise(closing)
    no = F.lit(False).alias("loss")
    return F.array(
        F.struct(opening.alias("text"), no),
        F.struct(escape(text).alias("text"), (role == LEARNED).alias("loss")),
        F.struct(closing.alias("text"), no),
    )


def formatted(events: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, segments (text, loss): one row per conversation."""
    turns = messages(events).select("conv_id", F.struct("message", turn_segments(F.col("role"), F.col("text")).alias("segments")).alias("turn"))
    begin = F.array(F.struct(F.lit(BEGIN).alias("text"), F.lit(False).alias("loss")))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    pieces = gathered.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.concat(begin, F.flatten(F.transform("turns", lambda t: t["segments"]))).alias("segments"),
    )
    return pieces.select(
        "conv_id", "n_turns", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments"
    )


def turns_of(text: Column) -> Column:
    """Array of (role, text), read back from a formatted conversation."""
    inner = F.substring(text, len(BEGIN) + 1, 2**31 - 1)
    pieces = F.split(inner, CLOSINGS, -1)
    names = {"INST": "user", "SYS": "system", "OUT": "assistant"}

    def turn(piece: Column) -> Column:
        mark = F.regexp_extract(piece, OPENING, 1)
        role = unescape(F.regexp_extract(piece, OPENING, 2))
        for short, name in names.items():
            role = F.when(mark == short, name).otherwise(role)
        return F.struct(role.alias("role"), unescape(F.regexp_replace(piece, OPENING, "")).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before formatting."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def streamed(rows: DataFrame, step: int = 64, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The event log of a service that streams these finished turns (conv_id, turn, role, text).

    A turn's text arrives in deltas of ``step`` characters. An assistant turn is first
    streamed up to its first ``step`` characters and then regenerated; another turn is sent
    with its first ``step`` characters only and then edited. Turns of one conversation and
    number are ordered by role, then text, nulls first; rows that repeat are turns each.
    """
    plain = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    in_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    deltas = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    numbered = plain.withColumn("message", F.row_number().over(in_turn)).withColumn("deltas", deltas)

    def event(seq, kind: str, text: Column) -> Column:
        return F.struct(seq.alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))

    head = F.coalesce(F.get("deltas", F.lit(0)), F.lit(""))
    opened = [event(F.lit(0), "start", F.lit("")), event(F.lit(1), "delta", head)]
    again = F.concat(
        F.array(*opened, event(F.lit(2), "regenerate", F.lit(""))),
        F.transform("deltas", lambda d, i: event(i + 3, "delta", d)),
    )
    edited = F.array(*opened, event(F.lit(2), "edit", F.col("text")))
    log = numbered.select(
        "conv_id", "message", "role", F.explode(F.when(F.col("role") == LEARNED, again).otherwise(edited)).alias("e")
    )
    opener = F.when(F.col("e.kind") == "start", F.col("role"))
    return log.select("conv_id", "e.seq", "message", "e.kind", opener.alias("role"), "e.text")
