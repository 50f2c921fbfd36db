from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sketchloom.llm import chat
from sketchloom.llm.queries import op7_chat_formatting, oracle_sql

from ..conftest import rows_of
from .helpers import SMALL, extra


def test_against_sql(spark, duck):
    df = op7_chat_formatting(spark, SMALL)
    found = duck.execute(oracle_sql()["op7_chat_formatting"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in found.description], found.fetchall())
    assert df.where("conv_id = -7").first().n_turns == 2


def test_plan_is_native_and_holds_the_automaton(spark):
    made = op7_chat_formatting(spark, SMALL)._jdf.queryExecution()
    plan = made.executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    held = made.optimizedPlan().toString()
    assert "aggregate(" in held and "zip_with(" in held


@pytest.fixture
def dirty(spark, duck):
    """Turns with ties, clashing signs, nulls and broken orders, in Spark and in DuckDB."""
    r = random.Random(5)
    texts, roles = ["A", "<", ">", "\\", "\\l", "a", "", None, "\n", "é", "</turn>", "z" * 70], ["user", "assistant", "system", "tool", None, "User"]
    rows = [(c, r.choice([0, 0, 1, 2, None]), r.choice(roles), r.choice(texts)) for c in range(60) for _ in range(r.randint(1, 6))]
    rows += [(100, 0, "user", "A"), (100, 0, "user", "<"), (100, 1, "assistant", "A"), (100, 1, "assistant", "<"), (101, 0, "user", "<"), (101, 0, "user", "A")]
    rows += [(200, i, ("user", "assistant")[i % 2], f"t{i}<") for i in range(200)] + [(201, i, ("user", "assistant")[i % 2], "x") for i in range(129)]
    con = duck.cursor()
    con.execute("CREATE OR REPLACE TEMP TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), con


def test_ties_and_faults_against_sql(dirty):
    turns, con = dirty
    df = chat.digest(chat.format_conversations(turns))
    found = con.execute(oracle_sql()["op7_chat_formatting"])
    columns = [c[0] for c in found.description]
    expected = [x for x in found.fetchall() if x[columns.index("conv_id")] != -7]
    assert rows_of(df.columns, [tuple(x) for x in df.collect()]) == rows_of(columns, expected)
    assert [r.text for r in chat.format_conversations(turns.where("conv_id = 100")).select(F.explode(chat.read_turns(F.col("formatted")))).select("col.*").collect()] == ["<", "A", "<", "A"]


def test_machine_against_a_plain_one(dirty):
    """States, flags and verdict of a machine written out by hand, beyond a block's length too."""
    turns, _ = dirty
    held: dict = {}
    for r in turns.collect():
        held.setdefault(r.conv_id, []).append((r.turn is not None, r.turn or 0, (r.role or "").encode(), (r.text or "").encode()))
    moves = {("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}
    for r in chat.format_conversations(turns).collect():
        state, valid, flags = "start", True, []
        for _, _, role, _ in sorted(held[r.conv_id]):
            role = role.decode()
            valid &= (state, role) in moves
            state = role if role in ("system", "user", "assistant") else "other"
            flags += [False, state == "assistant", False]
        assert [s.loss for s in r.segments] == flags and r.valid == (valid and state == "assistant")


def test_states_decide_the_loss(spark):
    """Another template: only a reply to a system turn counts."""
    t = chat.ChatTemplate(moves=(("start", "system", "told"), ("told", "assistant", "first"), ("first", "user", "asked"), ("asked", "assistant", "later")), loss_states=("first",), accept=("later",))
    turns = spark.createDataFrame([(1, i, r, r[0] + str(i)) for i, r in enumerate(["system", "assistant", "user", "assistant"])], "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(turns, t).first()
    assert [s.text for s in r.segments if s.loss] == ["a1"] and r.valid


NASTY = ["\\", "\\e", "\\l<>\\g", "<turn user>\nx\n</turn>\n", "</turn>", "", None, "a\nb", "\n", "é🙂\\\\"]


def test_round_trip_and_automaton(spark):
    rows = [(i, 0, "user", t) for i, t in enumerate(NASTY)] + [(i, 1, "assistant", t) for i, t in enumerate(NASTY)]
    rows += [(50, 0, "assistant", "x"), (51, 0, "user", "x"), (51, 1, "user", "y"), (52, 0, None, None), (53, None, "us>er", "z"), (None, 0, "user", "n"), (None, 1, "assistant", "m"), (54, 0, "user", "d"), (54, 0, "user", "d")]
    rows += [(60, 0, "system", "s"), (60, 1, "user", "u"), (60, 2, "assistant", "a"), (60, 3, "user", "u2"), (60, 4, "assistant", "a2")]
    turns = extra(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    made = chat.format_conversations(turns)
    back = {r.conv_id: [(x.role, x.text) for x in r.t] for r in made.select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    expected: dict = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        expected.setdefault(c, []).append((role or "", text or ""))
    assert back == expected
    valid = {r.conv_id: r.valid for r in made.collect()}
    assert valid[60] and valid[0] and not valid[50] and not valid[51] and not valid[52]
    for r in chat.digest(made).collect():
        loss = "".join(t for role, t in expected[r.conv_id] if role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_segments_concatenate(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(turns).first()
    assert "".join(s.text for s in r.segments) == r.formatted and [s.text for s in r.segments if s.loss] == ["a"]
