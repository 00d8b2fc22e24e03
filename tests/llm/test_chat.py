import json

from oracle import same_as_sql

from lakeline.llm import chat


def test_op3_equals_sql(spark):
    assert same_as_sql(spark, chat.op3_chat, chat.ORACLE, "/root/testdata/sf0.01", ["conversations"]) > 100


SCHEMAS = {"add": {"a": ("integer", True, 0, 9), "b": ("number", False, None, None)}, "say": {"text": ("string", True, 1, 5)}}


def linked(spark, messages):
    df = spark.createDataFrame([(c, t, "x", json.dumps(m) if m is not None and not isinstance(m, str) else m, 0) for c, t, m in messages], "conv_id long, turn long, role string, text string, level int")
    return chat.link(*chat.parse_messages(df), SCHEMAS).collect()


def call(i, name, args, after=()):
    return {"tool_calls": [{"id": i, "name": name, "arguments": args, "after": list(after)}]}


def test_links_validates_and_serialises(spark):
    rows = linked(spark, [
        (1, 0, call("c1", "add", {"b": 1.5, "a": 3})), (1, 1, {"tool_call_id": "c1", "content": "4.5"}), (1, 2, {"tool_call_id": "c1", "content": "late"}),
        (1, 3, call("c2", "add", {"a": "3", "z": 1}, ["c1"])), (1, 4, call("c3", "say", {"text": ""}, ["nope"])), (1, 5, call("c4", "fly", {})), (1, 6, {"tool_call_id": "gone", "content": None}),
        (1, 7, "plain text"), (1, 8, None), (1, 9, call("c5", "add", {"a": 10})), (1, 10, call("c6", "add", {})), (None, 11, call("n", "add", {"a": 1})),
    ])
    by = {r.call_id: r for r in rows}
    assert len(rows) == 8
    assert by["c1"].status == "linked" and by["c1"].result_turn == 1 and by["c1"].valid
    assert by["c1"].json == '{"arguments":{"a":3,"b":1.5},"call_id":"c1","name":"add","result":"4.5"}'
    assert by["c2"].violations == "a:type; unknown arguments:z" and by["c3"].violations == "after:missing; text:below 1"
    assert by["c4"].violations == "name:unknown" and by["c5"].violations == "a:above 9" and by["c6"].violations == "a:missing"
    assert by["gone"].status == "orphan" and by["gone"].order_key is None and by["n"].status == "unanswered"
    assert by["c1"].order_key < by["c2"].order_key < by["c3"].order_key


def test_orders_forward_references_and_tells_cycles(spark):
    rows = linked(spark, [
        (1, 0, call("a", "add", {"a": 1}, ["b"])), (1, 1, call("b", "add", {"a": 1}, ["c"])), (1, 2, call("c", "add", {"a": 1})),
        (2, 0, call("x", "add", {"a": 1}, ["y"])), (2, 1, call("y", "add", {"a": 1}, ["x"])), (2, 2, call("z", "add", {"a": 1})), (3, 0, call("p", "add", {"a": 1})),
    ])
    key = {r.call_id: r.order_key for r in rows}
    assert key["c"] < key["b"] < key["a"] and key["x"] is None and key["y"] is None and key["z"] and key["p"]


def test_a_long_way_of_forward_references(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(chat, "settle", lambda df, own=chat.settle: kept.append(1) or own(df))
    calls = spark.createDataFrame([(1, f"c{i:02d}") for i in range(12)] + [(2, "a")], "conv_id long, call_id string")
    edges = spark.createDataFrame([(1, f"c{i:02d}", f"c{i + 1:02d}") for i in range(11)], "conv_id long, call_id string, on string")
    got = {(r.conv_id, r.call_id): r.level for r in chat.levels(calls, edges).collect()}
    assert got == {(1, f"c{i:02d}"): 11 - i for i in range(12)} | {(2, "a"): 0} and len(kept) == 2 + 2 * 12


def test_empty_and_nulls(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.link(*chat.turns_as_calls(empty)).count() == 0
    odd = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (2, None, "user", "q"), (None, 0, "user", "q"), (3, 0, None, "q")], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.call_id): (r.status, r.violations) for r in chat.link(*chat.turns_as_calls(odd)).collect()}
    assert got[1, "1:0"] == ("linked", "prompt:missing") and len(got) == 3
