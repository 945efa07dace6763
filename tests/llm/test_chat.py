import json

from check import compare, connect

from shelfsift.llm import chat
from shelfsift.llm.queries import QUERIES, SQL

CALL = "conv_id long, turn long, call_id string, tool string, arguments string, needs array<string>, status string"
RESULT = "conv_id long, turn long, call_id string, content string, level int"
SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", False), "tags": ("array", False), "more": ("object", False), "deep": ("boolean", False)}, "say": {"text": ("string", True)}}


def linked(spark, calls, results):
    rows = chat.link_calls(
        spark.createDataFrame([(*c, "x") for c in calls], CALL), spark.createDataFrame([(*r, 1) for r in results], RESULT), SCHEMAS).collect()
    return sorted(((r["conv_id"] or 0, r["call_id"] or "", r["turn"] or 0, r["status"], r["level"], r["json"]) for r in rows), key=str)


def test_statuses_and_canonical_json(spark):
    calls = [
        (1, 0, "a", "add", '{"b": 1.50, "a": 2, "more": {"z": [1, {"y": null, "x": "é\\n\\""}], "b": true}}', []),
        (1, 2, "b", "add", '{"a": "2"}', ["a"]), (1, 3, "c", "add", '{"a": 1, "other": 2}', []), (1, 4, "d", "say", "no json", []), (1, 5, "e", "what", "{}", []),
        (1, 6, "f", "say", '{"text": "x"}', ["nobody"]), (1, 7, "a", "say", '{"text": "again"}', []), (1, 8, None, "say", '{"text": "x"}', []),
        (None, 0, "n", "say", '{"text": "x"}', None), (1, 9, "g", "add", "[1]", []), (1, 10, "h", None, None, None),
    ]
    results = [(1, 1, "a", "3.5"), (1, 9, "a", "late"), (1, 5, "lost", "?"), (None, 1, "n", None), (1, 6, None, "nameless")]
    got = linked(spark, calls, results)
    assert {(i, t): s for _, i, t, s, _, _ in got} == {
        ("a", 0): "ok", ("b", 2): "invalid", ("c", 3): "invalid", ("d", 4): "invalid", ("e", 5): "invalid", ("f", 6): "unanswered", ("a", 7): "repeated", ("", 8): "no_id",
        ("n", 0): "ok", ("g", 9): "invalid", ("h", 10): "invalid", ("lost", 5): "orphan", ("", 6): "orphan"}
    (text,) = [j for _, i, t, *_, j in got if (i, t) == ("a", 0)]
    assert text == '{"arguments":{"a":2,"b":1.5,"more":{"b":true,"z":[1,{"x":"é\\n\\"","y":null}]}},"id":"a","result":"3.5","tool":"add"}'
    for *_, j in got:
        assert j == json.dumps(json.loads(j), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_order_of_needs(spark):
    def call(conv, turn, name, *needs):
        return (conv, turn, name, "say", '{"text": "x"}', list(needs))

    calls = [
        call(1, 0, "a"), call(1, 1, "b", "a"), call(1, 2, "c", "a", "b"),
        call(2, 0, "a", "c"), call(2, 1, "b"), call(2, 2, "c", "b"), call(2, 3, "d", "a"),
        call(3, 0, "a", "b"), call(3, 1, "b", "a"), call(3, 2, "c", "b"), call(3, 3, "d"), call(4, 0, "self", "self"),
    ]
    got = {(c, i): (s, lv) for c, i, _, s, lv, _ in linked(spark, calls, [])}
    assert {i: lv for (c, i), (_, lv) in got.items() if c == 1} == {"a": 0, "b": 0, "c": 0}
    assert {i: lv for (c, i), (_, lv) in got.items() if c == 2} == {"b": 0, "c": 1, "a": 2, "d": 3}
    assert {i: s for (c, i), (s, _) in got.items() if c > 2} == {"a": "cyclic", "b": "cyclic", "c": "cyclic", "d": "unanswered", "self": "cyclic"}


def test_equal_rows_and_empty_tables(spark):
    calls = [(1, 0, "a", "say", '{"text": "x"}', [])] * 3
    assert sorted(s for _, _, _, s, _, _ in linked(spark, calls, [(1, 1, "a", "y")] * 2)) == ["ok", "repeated", "repeated"]
    assert linked(spark, [], []) == []
    assert [s for _, _, _, s, _, _ in linked(spark, [], [(1, 1, "a", "y")])] == ["orphan"]


def test_equals_sql(spark, folder):
    assert compare(QUERIES["op6_tool_calls"](spark, folder), connect(folder), SQL["op6_tool_calls"]) is None
