import json

import pytest

from rollbook.llm import tool_calls as tc

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"
SCHEMAS = {
    "add": [tc.Field("a", "integer", low=0), tc.Field("b", "number"), tc.Field("note", "string", required=False, high=5)],
    "ping": [],
    "deep": [tc.Field("o", "object"), tc.Field("l", "array", required=False), tc.Field("t", "boolean", required=False)],
}


def run(spark, calls, results):
    df = tc.tool_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS)
    return {(r.conv_id, r.call_id): r for r in df.collect()}


def test_linking(spark):
    got = run(spark, [
        (1, 1, "x", "ping", "{}", None), (1, 3, "y", "ping", "{}", ["x"]), (1, 5, "z", "ping", "{}", ["nowhere"]), (2, 1, "x", "ping", "{}", []),
        (2, 9, "x", "ping", "{}", []), (3, 4, "early", "ping", "{}", []), (4, 1, None, "ping", "{}", []),
    ], [(1, 2, "x", "ok"), (1, 4, "y", None), (1, 6, "lost", "?"), (2, 2, "x", "first"), (2, 3, "x", "second"), (3, 2, "early", "no"), (4, 2, None, "n")])
    status = {k: r.status for k, r in got.items() if k[1] is not None}
    assert status == {(1, "x"): "linked", (1, "y"): "linked", (1, "z"): "unanswered", (1, "lost"): "orphan", (2, "x"): "linked", (3, "early"): "early"}
    assert got[2, "x"].content == "first" and got[2, "x"].n_rows == 4
    assert [got[1, k].position for k in ("x", "y", "z", "lost")] == [1, 2, 3, None]
    assert got[1, "z"].problems == "missing dependency" and not got[1, "z"].valid and got[1, "y"].valid


@pytest.mark.parametrize("arguments, problems", [
    ('{"a": 1, "b": 2.5}', ""), ('{"b":1,"a":0,"note":"short"}', ""), ('{"a": -1, "b": 1}', "range a"), ('{"a": "1", "b": 1}', "type a"),
    ('{"a": 1.5, "b": 1}', "type a"), ('{"a": 1}', "missing b"), ('{"a": null, "b": 1}', "missing a"), ('{"a":1,"b":1,"note":"too long","z":0}', "range note; unknown z"),
    ("[1]", "no object"), ("broken", "no object"), (None, "no object"), ("", "no object"),
])
def test_validation(spark, arguments, problems):
    assert run(spark, [(1, 1, "c", "add", arguments, None)], [])[1, "c"].problems == problems


def test_kinds_and_unknown_tools(spark):
    got = run(spark, [(1, 1, "a", "deep", '{"o": {}, "l": [], "t": true}', None), (1, 2, "b", "deep", '{"o": [], "l": {}, "t": 1}', None),
                      (1, 3, "c", "other", "{}", None), (1, 4, "d", None, "{}", None)], [])
    assert [got[1, k].problems for k in "abcd"] == ["", "type l; type o; type t", "unknown tool", "unknown tool"]


def test_canonical_messages(spark):
    arguments = ' { "b" : 1.0 , "a" : 7, "note":"é\\u00e9\\n" } '
    got = run(spark, [(1, 1, 'q"1', "add", arguments, None), (1, 2, "p", "add", "nope", None)], [(1, 2, 'q"1', 'line\n"two"')])
    message = got[1, 'q"1'].message
    assert json.loads(message) == {"arguments": {"a": 7, "b": 1.0, "note": "éé\n"}, "id": 'q"1', "name": "add", "result": 'line\n"two"'}
    assert message.startswith('{"arguments":{"a":7,"b":1') and " " not in message.split('"note"')[0]
    assert json.loads(got[1, "p"].message) == {"arguments": None, "id": "p", "name": "add", "result": None}


def test_topological_order(spark):
    calls = [(1, 1, "a", "ping", "{}", ["c"]), (1, 2, "b", "ping", "{}", ["a"]), (1, 3, "c", "ping", "{}", ["d"]), (1, 4, "d", "ping", "{}", []),
             (1, 5, "free", "ping", "{}", []), (2, 1, "p", "ping", "{}", ["q"]), (2, 2, "q", "ping", "{}", ["p"]), (2, 3, "r", "ping", "{}", ["q"]),
             (2, 4, "s", "ping", "{}", []), (2, 5, "own", "ping", "{}", ["own"])]
    got = run(spark, calls, [])
    order = sorted((r.position, k[1]) for k, r in got.items() if k[0] == 1)
    assert [k for _, k in order] == ["d", "free", "c", "a", "b"] and [p for p, _ in order] == [1, 2, 3, 4, 5]
    assert {k[1]: r.position for k, r in got.items() if k[0] == 2} == {"p": None, "q": None, "r": None, "s": 1, "own": None}


def test_a_very_long_conversation(spark):
    calls = [(7, i, f"c{i}", "ping", "{}", [f"c{i - 1}"] if i else None) for i in range(3000)]
    got = run(spark, calls, [(7, i + 1, f"c{i}", "ok") for i in range(0, 3000, 2)])
    assert all(r.position == r.turn + 1 for r in got.values()) and sum(r.status == "linked" for r in got.values()) == 1500


def test_the_link_is_a_hash_join(spark):
    linked = tc.link(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS))
    plan = linked._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_positions_in_pieces(spark):
    """Long conversations, many short ones and rows without one; each conversation's first number is repeated by piece only."""
    n = 3 << tc.PIECE_BITS
    long = spark.range(n).selectExpr("7L conv_id", "id turn", "concat('c', id) call_id")
    short = spark.range(6000).selectExpr("1000 + id div 3 conv_id", "id % 3 turn", "concat('s', id) call_id")
    none = spark.range(5).selectExpr("cast(NULL AS long) conv_id", "id turn", "concat('n', id) call_id")
    calls = long.unionByName(short).unionByName(none).selectExpr("*", "'ping' name", "'{}' arguments", "cast(NULL AS array<string>) depends_on")
    linked = tc.link(calls, spark.createDataFrame([], RESULTS))
    got = tc.ordered(linked)
    assert got.count() == n + 6005 and got.filter("NOT position <=> turn + 1").isEmpty()
    numbered = calls.selectExpr("conv_id", "row_number() OVER (ORDER BY conv_id, turn) _number")
    assert 2002 + 3 <= tc._pieces(numbered).count() <= 2002 + (n + 6005 >> tc.PIECE_BITS) + 1
    parts = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in parts


def test_empty(spark):
    assert run(spark, [], []) == {}
