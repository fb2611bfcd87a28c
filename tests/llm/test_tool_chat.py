import json

import duckdb
import pytest

from terradelta.llm import tool_chat as t

SCHEMAS = [("add", "a", "number", True), ("add", "b", "number", True), ("find", "q", "string", True), ("find", "deep", "object", False)]


def rows(spark, messages):
    m = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    return {(r.conv_id, r.call_id): r for r in t.link(t.calls_of(m), t.results_of(m), spark.createDataFrame(SCHEMAS, t.SCHEMA)).collect()}


def call(id, name, arguments, after=None):
    return {"id": id, "name": name, "arguments": arguments} | ({"after": after} if after else {})


def test_links_orders_and_validates(spark):
    calls = [call("c", "find", {"q": "$b"}), call("b", "find", {"q": "x", "deep": {"z": 1, "a": [True, None]}}, ["a"]), call("a", "add", {"b": 2, "a": 1.5})]
    got = rows(
        spark,
        [
            (1, 0, "user", "hello"),
            (1, 1, "assistant", json.dumps({"tool_calls": calls})),
            (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "3.5"})),
            (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": "later"})),
            (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": "é\n\"q\""})),
            (1, 5, "assistant", json.dumps({"tool_calls": [call("d", "add", {"a": "1", "extra": 0}, ["c", "nope"]), call("x", "find", {"q": "$y"}), call("y", "find", {"q": "$x"}), call("w", "gone", {}), {"id": "v", "name": "add", "arguments": [1]}]})),
            (2, 0, "assistant", "plain"),
            (2, 1, "assistant", "{broken"),
            (2, 2, "tool", None),
            (2, 3, "assistant", ""),
        ],
    )
    assert [got[1, k].level for k in "abcd"] == [0, 1, 2, 0] and got[1, "x"].level is None and "cycle" in got[1, "y"].errors
    assert [got[1, k].status for k in ("a", "b", "zz")] == ["answered", "unanswered", "orphan"] and got[1, "a"].result_turn == 2
    assert got[1, "a"].errors == [] and got[1, "b"].errors == []
    assert sorted(got[1, "d"].errors) == ["bad reference", "missing b", "type a", "unknown extra"]
    assert got[1, "w"].errors == ["no such tool"] and got[1, "v"].errors == ["not an object"]
    assert got[1, "b"].json == '{"arguments":{"deep":{"a":[true,null],"z":1},"q":"x"},"content":null,"id":"b","name":"find"}'
    assert json.loads(got[1, "zz"].json)["content"] == 'é\n"q"' and len(got) == 9


def test_empty(spark):
    assert rows(spark, []) == {}


def test_query_matches_sql(spark, tmp_path):
    data = [(1, 0, "user", "a\t\"b\" \\ é/"), (1, 1, "assistant", "c\n\x0b"), (1, 2, "user", None), (2, 0, "system", "s"), (2, 1, "assistant", "lone"), (3, 5, "user", ""), (3, 6, "assistant", None), (3, 6, "assistant", None)]
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = t.op7_tool_chat(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(t.ORACLE)
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_query_reads_calls_and_results(spark, tmp_path):
    data = [(1, 0, "user", "hi"), (1, 1, "assistant", json.dumps({"tool_calls": [call("a", "find", {"q": "x"})]})), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "y"})), (1, 3, "assistant", "{plain")]
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.call_id: (r.status, r.turn, r.result_turn) for r in t.op7_tool_chat(spark, str(tmp_path)).collect()}
    assert got == {"1:0:a": ("unanswered", 0, None), "1:0:b": ("unanswered", 0, None), "a": ("answered", 1, 2), "1:2:a": ("orphan", None, 3)}
