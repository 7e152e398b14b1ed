from __future__ import annotations

import random

from ionweave.llm import chat_format as c

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "<sep>", "&lt;", "&amp;", "&lsqb;", "&", "<", "[", "\\", "amp;", "lt;", "\n", "é", "🎉", " ok ", "$1"]


def formatted(rows):
    return {r.conv_id: r for r in rows.collect()}


def check(spark, rows):
    """Everything read back equals the input; the mask covers each assistant text, once, in order."""
    table = c.format_conversations(spark.createDataFrame(rows, SCHEMA).repartition(3))
    back = formatted(c.read_back(table))
    plain = formatted(table)
    want: dict = {}
    for conv, turn, role, text in rows:
        assert conv is not None
        want.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(back) == set(want)
    for conv, turns in want.items():
        turns = sorted(turns)
        assert [(t.role, t.text) for t in back[conv].turns] == [t[2:] for t in turns]
        assert back[conv].loss_text == "".join(t[3] for t in turns if t[2] == "assistant")
        marks = plain[conv].loss_mask
        assert len(marks) == sum(t[2] == "assistant" for t in turns)
        assert all(m.start >= e.start + e.len for e, m in zip(marks, marks[1:]))
        blocks = 1 + sum(a[2] != b[2] for a, b in zip(turns, turns[1:]))
        assert plain[conv].formatted.count(c.CLOSE) == blocks and plain[conv].formatted.count(c.SEP) == len(turns) - blocks


def test_round_trip_of_control_strings(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 7)):
            text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "assistant", "<s>[INST]"]), text))
    check(spark, rows)


def test_adjacent_turns_merge_and_stay_apart(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "")]
    got = c.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert got.formatted == "<s>[INST]user[/INST]a</s><s>[INST]assistant[/INST]b<sep>c</s><s>[INST]user[/INST]</s>"
    assert [got.formatted[m.start : m.start + m.len] for m in got.loss_mask] == ["b", "c"]
    check(spark, rows)


def test_nulls_ties_repeats_and_long(spark):
    rows = [(1, None, None, None), (1, 2, "user", "x"), (1, 2, "user", "x"), (1, 2, "assistant", "y"), (2, 0, "assistant", "long " * 100_000)]
    check(spark, rows)
    check(spark, [(3, i, "user" if i % 3 else "assistant", f"t{i}") for i in range(3000)])


def test_ties_sort_by_the_text_before_escaping(spark):
    rows = [(1, 0, "user", t) for t in ("<s>", "1", "&lt;", "[INST]", "A", "<", "=", "&amp;lt;", "</s>")]
    check(spark, rows + [(1, 0, "<s>", "x"), (1, 0, "=", "y")])


def test_rows_without_conv_id_stand_alone(spark):
    rows = [(None, 0, "assistant", "z"), (None, 1, "assistant", None), (None, 1, "user", "q"), (1, 0, "user", "x")]
    table = c.format_conversations(spark.createDataFrame(rows, SCHEMA))
    got = sorted((r.conv_id or 0, [(t.role, t.text) for t in r.turns], r.loss_text) for r in c.read_back(table).collect())
    assert got == [(0, [("assistant", "")], ""), (0, [("assistant", "z")], "z"), (0, [("user", "q")], ""), (1, [("user", "x")], "")]


def test_empty_and_clashes(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 0, "user", "x")], SCHEMA)
    assert c.format_conversations(rows.limit(0)).collect() == []
    extra = rows.withColumns({k: F.lit(1) for k in ("ts", "at", "blocks", "piece", "begin", "formatted", "loss_mask")})
    assert c.format_conversations(extra).first().formatted == "<s>[INST]user[/INST]x</s>"


def test_native(spark):
    plan = c.read_back(c.format_conversations(spark.createDataFrame([(1, 0, "user", "x")], SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
