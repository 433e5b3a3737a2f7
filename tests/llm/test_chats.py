"""Chat formatting: event logs folded by plain Python, and texts that come back from the template."""

import random

import pytest
from pyspark.sql import functions as F

from riskgraph.llm import chats

SCHEMA = "conv_id long, seq long, message long, kind string, role string, text string, turns long"
NASTY = [
    "</s>[INST] ok [/INST]", "<\\/s>", "<\\\\s><s>", "[\\INST][INST", "[SYS] a [/SYS] [OUT] </s>", "", None, " ", "\n",
    "[ROLE] x [/ROLE] y [/TURN]", "a\\", "<", "[[/INST]]", "ends with space ", " </s", "\U0001f600</s>\U0001f600", "$1 \\1 \\",
]


def plain_fold(events):
    """{conv_id: [(role, text)]} of the final messages."""
    order = {"start": 0, "regenerate": 1, "edit": 2, "delta": 3}
    nulls = lambda x: (x is not None, x)
    messages = {}
    known = [e for e in events if e[3] in order]
    for conv, _, message, kind, role, text in sorted(
        known, key=lambda e: (nulls(e[0]), nulls(e[2]), nulls(e[1]), order[e[3]], (e[5] or "").encode())
    ):
        at = messages.setdefault(conv, {}).setdefault(message, ["", ""])
        at[0] = role if role is not None else at[0]
        at[1] = {"start": text or "", "regenerate": "", "edit": text or "", "delta": at[1] + (text or "")}[kind]
    return {c: [tuple(m[k]) for k in sorted(m, key=nulls)] for c, m in messages.items()}


def read_back(events):
    done = chats.formatted(events)
    rows = done.select("*", chats.turns_of(F.col("formatted")).alias("turns"), chats.loss_text(F.col("segments")).alias("loss"))
    return rows.collect()


def check(rows, wanted):
    assert {r.conv_id for r in rows} == set(wanted) and len(rows) == len(wanted)
    for r in rows:
        assert [tuple(t) for t in r.turns] == wanted[r.conv_id]
        assert r.n_turns == len(wanted[r.conv_id])
        assert r.loss == "".join(t for role, t in wanted[r.conv_id] if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted


def test_fold_equals_plain_fold(spark):
    rng = random.Random(5)
    events = []
    for _ in range(3000):
        kind = rng.choice(["start", "delta", "delta", "delta", "edit", "regenerate", "ping", None])
        role = rng.choice(["user", "assistant", "system", "tool", None])
        events.append((rng.choice([None, *range(12)]), rng.choice([None, *range(40)]), rng.choice([None, *range(5)]), kind, role, rng.choice(NASTY)))
    # Roles of one place in the order would tie.
    events = list({(e[0], e[2], e[1], e[3], e[5] or ""): e for e in events}.values())
    df = spark.createDataFrame([(*e, 7) for e in events], SCHEMA).repartition(7)
    check(read_back(df), plain_fold(events))


@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool", "a [/ROLE] b", "", None])
def test_every_text_comes_back_from_streamed_rows(spark, role):
    rows = [(1, i, role, text) for i, text in enumerate(NASTY)] + [(1, 3, role, NASTY[3]), (None, None, role, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wanted = {1: [(role or "", t or "") for _, i, _, t in sorted(rows[:-1], key=lambda r: r[1])], None: [(role or "", "x")]}
    check(read_back(chats.streamed(df, step=3)), wanted)


def test_control_strings_only_stand_where_the_template_puts_them(spark):
    df = spark.createDataFrame([(1, 0, "user", NASTY[0]), (1, 1, "assistant", NASTY[0])], "conv_id long, turn long, role string, text string")
    (row,) = chats.formatted(chats.streamed(df)).collect()
    assert [row.formatted.count(c) for c in ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]")] == [1, 1, 1, 1, 1]


def test_empty_log_and_repeated_deltas(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chats.formatted(empty).collect() == []
    events = [(1, 0, 0, "start", "user", None, 7)] + [(1, 1, 0, "delta", None, "ab", 7)] * 3
    (row,) = chats.formatted(spark.createDataFrame(events, SCHEMA)).collect()
    assert row.formatted == "<s>[INST] ababab [/INST]"


def test_long_message_of_many_deltas_and_drafts(spark):
    """A hundred thousand deltas, most of them thrown away, and one very long text."""
    n = 100_000
    made = spark.range(n).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("seq"), F.lit(0).cast("long").alias("message"),
        F.when(F.col("id") % 10_000 == 0, "regenerate").otherwise("delta").alias("kind"),
        F.lit("assistant").alias("role"), F.lit("x").alias("text"),
    )
    (row,) = chats.formatted(made).collect()
    assert row.formatted == "<s>[OUT] " + "x" * 9999 + " </s>"
    text = "[INST]</s> word " * 60_000
    df = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    check(read_back(chats.streamed(df)), {1: [("assistant", text)]})
