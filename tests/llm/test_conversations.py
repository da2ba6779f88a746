"""Conversation repair against SQL that tries all edit sequences, and its layers against a plain search."""

import random

import duckdb
import pytest

from vectide.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, pos int, sub int, TEXT2 string"


def rows(seed, convs, most):
    r = random.Random(seed)
    out = []
    for c in range(convs):
        texts = [f"word {i} said{r.choice(['.', '!', '?', '', '. ', chr(10), '.\t'])}" for i in range(6)] + ["", "  ", None, "..."]
        for t in range(r.randrange(0, most)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "User", "assist"])
            out.append((None if c == 3 else c, r.choice([t, t, t, t + 3, t // 2, None]), role, r.choice(texts), 1, 2, "x"))
    return out + out[:5]


def by_sql(table, tmp_path):
    table.toPandas().to_parquet(tmp_path / "c.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, CAST(role AS VARCHAR) AS role, CAST(text AS VARCHAR) AS text FROM '{tmp_path}/c.parquet'")
    return sorted(con.execute(conversations.ORACLE_SQL["op11_conversations"]).fetchall(), key=str)


COLUMNS = ["conv_id", *conversations.REPORT, "audit", "repaired_sha256"]


@pytest.mark.parametrize("most_turns", [1_024, 3])
def test_repair(spark, tmp_path, monkeypatch, most_turns):
    table = spark.createDataFrame(rows(1, 60, 14), SCHEMA)
    monkeypatch.setattr(conversations, "BLOCK_BITS", 2)
    edits = conversations.repair(conversations.damaged(table), "copies", most_turns)
    got = sorted((tuple(x) for x in conversations.digests(edits).select(*COLUMNS).collect()), key=str)
    assert got == by_sql(table, tmp_path)


@pytest.mark.parametrize("most_turns", [1_024, 100])
def test_one_long_conversation(spark, tmp_path, most_turns):
    table = spark.createDataFrame([x for x in rows(2, 3, 900) if x[0] == 1] + rows(5, 4, 9), SCHEMA)
    edits = conversations.repair(conversations.damaged(table), "copies", most_turns)
    got = sorted((tuple(x) for x in conversations.digests(edits).select(*COLUMNS).collect()), key=str)
    assert got == by_sql(table, tmp_path)


def test_empty_and_turns(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert conversations.digests(conversations.repair(table)).count() == 0
    table = spark.createDataFrame([(1, 0, "user", "Hi.", 0, 0, ""), (1, 1, "user", "Yes?", 0, 0, ""), (1, 2, "tool", "No", 0, 0, "")], SCHEMA)
    edits = conversations.repair(table)
    turns = [tuple(x) for x in conversations.repaired_turns(edits).orderBy("pos", "sub").select("role", "text").collect()]
    # to add an answer and keep the last turn cut off costs 5, as would KRD; I comes before R
    assert turns == [("user", "Hi."), ("assistant", ""), ("user", "Yes?"), ("assistant", "No")]
    assert tuple(conversations.digests(edits).select("illegal", "truncated", "cost", "audit").first()) == (2, 1, 5, "KIKR")
