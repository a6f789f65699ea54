import json

from satchel.llm import tool_calls

CALLS = "conv_id long, turn long, call_id string, name string, arguments string"
RESULTS = "conv_id long, turn long, call_id string, content string"
FIELDS = [("add", "a", "number", True), ("add", "b", "integer", False), ("say", "text", "string", True)]


def run(spark, calls, results):
    schemas = spark.createDataFrame(FIELDS, "name string, field string, type string, required boolean")
    linked = tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), schemas)
    return {(r.conv_id, r.call_id): r for r in linked.collect()}


def test_links_validation_and_canonical_json(spark):
    calls = [(1, 0, "a", "add", '{"b": 2, "a": 1.50}'), (1, 0, "a", "add", '{"b": 2, "a": 1.50}'), (1, 1, "b", "add", '{"b":"2"}'), (1, 2, "c", "say", "no json"), (1, 3, "d", "say", '{"text":"é\\n","more":null}'), (1, 4, "e", "none", "{}"), (1, 5, "f", "say", None), (None, 0, "x", "say", "{}"), (2, 0, "a", "say", '{"text":"x"}')]
    got = run(spark, calls, [(1, 2, "a", "late"), (1, 1, "a", "first"), (1, 1, "zzz", "lost"), (2, 1, "a", None)])
    assert set(got) == {(1, c) for c in "abcdef"} | {(2, "a")}
    a = got[1, "a"]
    assert a.valid and a.n_results == 2 and a.json == '{"arguments":{"a":1.5,"b":2},"depth":1,"id":"a","name":"add","result":"first","valid":true}'
    assert (got[1, "b"].valid, got[1, "b"].problems) == (False, ["a", "b"])
    assert got[1, "c"].problems == ["arguments"] == got[1, "f"].problems and got[1, "e"].problems == ["schema"]
    assert got[1, "d"].problems == ["more"] and json.loads(got[1, "d"].json)["arguments"]["text"] == "é\n"
    assert got[2, "a"].n_results == 1 and "result" not in json.loads(got[2, "a"].json)


def test_depths_of_chains_joins_and_cycles(spark):
    ref = lambda *ids: json.dumps({f"k{i}": f"${x}" for i, x in enumerate(ids)})
    calls = [(1, i, f"c{i}", "say", ref(f"c{i - 1}") if i else "{}") for i in range(40)]
    calls += [(2, 0, "p", "say", "{}"), (2, 1, "q", "say", ref("p")), (2, 2, "r", "say", ref("p", "q")), (2, 3, "s", "say", ref("r", "q")), (2, 4, "t", "say", ref("s")), (2, 5, "u", "say", ref("gone"))]
    calls += [(3, 0, "x", "say", ref("y")), (3, 1, "y", "say", ref("x")), (3, 2, "z", "say", ref("y")), (3, 3, "w", "say", ref("z", "v")), (3, 4, "v", "say", "{}")]
    got = {k: r.depth for k, r in run(spark, calls, []).items()}
    assert [got[1, f"c{i}"] for i in range(40)] == list(range(1, 41))
    assert {c: got[2, c] for c in "pqrstu"} == {"p": 1, "q": 2, "r": 3, "s": 4, "t": 5, "u": 1}
    assert {c: got[3, c] for c in "xyzwv"} == {"x": None, "y": None, "z": None, "w": None, "v": 1}


def test_messages_are_parsed(spark):
    rows = [(1, 0, "assistant", '{"tool_calls":[{"id":"a","name":"say","arguments":{"text":"x"}},{"id":"b","name":"say","arguments":{}}]}'), (1, 1, "tool", '{"tool_call_id":"a","content":"y"}'), (1, 2, "user", "plain"), (1, 3, "assistant", "{broken"), (1, 4, "tool", None)]
    calls, results = tool_calls.parse_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted((r.call_id, r.arguments) for r in calls.collect()) == [("a", '{"text":"x"}'), ("b", "{}")]
    assert [(r.call_id, r.content) for r in results.collect()] == [("a", "y")]


def test_empty_tables(spark):
    assert run(spark, [], []) == {}


def test_no_python_in_the_plan(spark, sf_dir):
    from satchel.llm.queries import op2_tool_calls

    plan = op2_tool_calls(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
