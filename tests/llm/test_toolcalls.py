import json
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quadrille.llm import toolcalls

SCHEMAS = {
    "search": {
        "type": "object",
        "properties": {
            "q": {"type": "string", "minLength": 2, "pattern": "^[a-z ]+$"},
            "n": {"type": "integer", "minimum": 1, "maximum": 10},
            "mode": {"enum": ["fast", "slow"]},
            "tags": {"type": "array", "items": {"type": "string"}, "maxItems": 2},
            "where": {"type": "object", "properties": {"city": {"type": "string"}}, "required": ["city"]},
        },
        "required": ["q"],
        "additionalProperties": False,
    },
    "ping": {"type": "object"},
}


def run(spark, calls, results=(), after=()):
    c = spark.createDataFrame(list(calls), "conv_id long, call_id string, position long, name string, arguments string, json int".replace(", json int", ""))
    r = spark.createDataFrame(list(results), "conv_id long, call_id string, position long, content string")
    d = spark.createDataFrame(list(after), "conv_id long, call_id string, after_id string")
    return [x.asDict() for x in toolcalls.link_tool_calls(c, r, SCHEMAS, d).collect()]


def test_validation(spark):
    cases = {
        '{"q":"ab c","n":3}': "",
        '{"q":"a"}': "q: minLength",
        '{"q":"AB"}': "q: pattern",
        '{"q":"ab","n":11}': "n: maximum",
        '{"q":"ab","n":1.5}': "n: type",
        '{"q":"ab","n":2.0}': "",
        '{"q":"ab","mode":"odd"}': "mode: enum",
        '{"q":"ab","tags":["x",1]}': "tags: items",
        '{"q":"ab","tags":["x","y","z"]}': "tags: maxItems",
        '{"q":"ab","where":{}}': "where: required city",
        '{"q":"ab","where":{"city":1}}': "where.city: type",
        '{"n":3}': "arguments: required q",
        '{"q":"ab","extra":1}': "arguments: additionalProperties",
        "[1]": "arguments: type",
        "{oops": "malformed arguments",
        '{"q":"ab","q":"cd"}': "malformed arguments",
        None: "malformed arguments",
    }
    rows = run(spark, [(1, f"c{k:02}", k, "search", a) for k, a in enumerate(cases)])
    got = {r["call_id"]: r["errors"] for r in rows}
    assert got == {f"c{k:02}": e for k, e in enumerate(cases.values())}
    assert all(r["valid"] == (r["errors"] == "") for r in rows)
    assert run(spark, [(1, "x", 0, "nope", "{}")])[0]["errors"] == "unknown tool"


def test_canonical_json(spark):
    args = '{ "q" : "a\\u00e9\\n\\"",  "n": 1.50, "a": [1, {"z":1,"b":null}] }'
    (row,) = run(spark, [(1, "x", 0, "ping", args)], [(1, "x", 1, 'say "hi"\n')])
    assert row["json"] == '{"arguments":{"a":[1,{"b":null,"z":1}],"n":1.5,"q":"aé\\n\\""},"id":"x","name":"ping","result":"say \\"hi\\"\\n"}'
    assert json.loads(row["json"])["result"] == 'say "hi"\n'


def test_linking_and_order(spark):
    calls = [
        (1, "a", 0, "ping", "{}"), (1, "b", 1, "ping", "{}"), (1, "c", 2, "ping", "{}"),
        (2, "a", 0, "ping", "{}"), (2, "b", 1, "ping", "{}"), (2, "c", 2, "ping", "{}"),
        (3, "x", 0, "ping", "{}"), (3, "y", 1, "ping", "{}"), (3, "z", 2, "ping", "{}"), (3, "w", 3, "ping", "{}"),
        (4, "d", 5, "ping", "{}"), (4, "d", 5, "ping", "{}"), (4, "d", 3, "ping", "{}"), (4, None, 1, "ping", None), (None, "q", 1, "ping", "{}"),
    ]
    results = [(1, "a", 9, "r"), (1, "a", 8, "first"), (1, "zz", 3, "lost"), (5, None, 1, None), (2, "a", None, None)]
    after = [(1, "b", "a"), (1, "c", "b"), (1, "c", "gone"), (2, "a", "b"), (2, "b", "c"), (3, "x", "y"), (3, "y", "x"), (3, "w", "x")]
    rows = run(spark, calls, results, after)
    at = {(r["conv_id"], r["call_id"]): r for r in rows if r["step"] is not None}
    assert [at[1, k]["step"] for k in "abc"] == [0, 1, 2] and [at[2, k]["step"] for k in "abc"] == [2, 1, 0]
    assert [at[3, k]["step"] for k in "zxyw"] == [0, 1, 2, 3] and [at[3, k]["cyclic"] for k in "zxyw"] == [False, True, True, True]
    assert at[1, "c"]["n_missing"] == 1 and at[1, "a"]["n_results"] == 2 and json.loads(at[1, "a"]["json"])["result"] == "first"
    status = Counter((r["conv_id"], r["call_id"], r["kind"], r["status"]) for r in rows)
    assert status[1, "zz", "result", "orphan"] == 1 and status[5, None, "result", "unidentified"] == 1
    assert status[4, "d", "call", "repeated"] == 2 and status[4, "d", "call", "unanswered"] == 1 and status[2, "a", "call", "linked"] == 1
    assert status[4, None, "call", "unidentified"] == 1 and status[None, "q", "call", "unidentified"] == 1
    assert len(rows) == len(calls) + 2
    assert run(spark, []) == []


def brute_levels(nodes, edges):
    """Longest chain of dependencies below each call; None on or behind a cycle."""
    needs, level = {v: {u for x, u in edges if x == v} for v in nodes}, {}
    while ready := [v for v in nodes if v not in level and needs[v] <= set(level)]:
        level |= {v: max((level[u] + 1 for u in needs[v]), default=0) for v in ready}
    return {v: level.get(v) for v in nodes}


def test_levels_equal_brute_force(spark):
    """Long chains forwards, trees, calls with several dependencies, cycles."""
    rng = random.Random(11)
    graphs = [
        (range(70), {(v, v + 1) for v in range(69)}),
        (range(40), {(v, (v + 1) % 40) for v in range(30)} | {(5, 3)}),
        (range(9), {(0, 8), (1, 0), (2, 0), (3, 3), (4, 3)}),
        *((range(60), {(v, rng.randrange(v + 1, 60)) for v in range(59) for _ in range(rng.randrange(4))} | {(50, 2)}) for _ in range(3)),
        *((range(60), {(v, rng.randrange(60)) for v in range(60) if rng.random() < 0.6}) for _ in range(3)),
    ]
    calls = [(g, str(v), v, "ping", "{}") for g, (nodes, _) in enumerate(graphs) for v in nodes]
    after = [(g, str(v), str(u)) for g, (_, edges) in enumerate(graphs) for v, u in edges]
    rows = {(r["conv_id"], int(r["call_id"])): r for r in run(spark, calls, (), after)}
    for g, (nodes, edges) in enumerate(graphs):
        level = brute_levels(nodes, edges)
        want = sorted(nodes, key=lambda v: (level[v] is None, level[v] or 0, v)) if any(u >= v for v, u in edges) else list(nodes)
        assert sorted(nodes, key=lambda v: rows[g, v]["step"]) == want
        assert all(rows[g, v]["cyclic"] == (level[v] is None) for v in nodes)


def test_null_position_is_no_missing_parent(spark):
    rows = {r["call_id"]: r for r in run(spark, [(1, "a", None, "ping", "{}"), (1, "b", 1, "ping", "{}")], (), [(1, "b", "a"), (1, "b", "c")])}
    assert rows["b"]["n_missing"] == 1 and (rows["a"]["step"], rows["b"]["step"]) == (0, 1)


def test_schemas_are_checked_whole(spark):
    schema = {"properties": {"xs": {"items": {"type": "object", "properties": {"k": {"const": 1}}, "required": ["k"]}}, "n": {"exclusiveMinimum": 0}}}
    cases = {'{"xs":[{"k":1}],"n":1}': 0, '{"xs":[{"k":2}]}': 1, '{"xs":[{}]}': 1, '{"xs":[3]}': 1, '{"n":0}': 1}
    table = spark.createDataFrame([(a,) for a in cases], "a string")
    got = {r["a"]: r["n"] for r in table.select("a", F.size(toolcalls.argument_errors(F.lit("t"), F.col("a"), {"t": schema})).alias("n")).collect()}
    assert got == cases
    for odd in ({"anyOf": []}, {"properties": {"x": {"$ref": "#"}}}, {"additionalProperties": {"type": "string"}}):
        with pytest.raises(ValueError):
            toolcalls.schema_errors(F.col("a"), odd)


def test_explicit_chat(spark):
    call = {"tool_calls": [{"id": "1", "name": "search", "arguments": '{"q":"ab"}'}, {"id": "2", "name": "search", "arguments": {"q": "cd"}, "after": ["1"]}]}
    rows = [
        (7, 0, "user", "find it", "extra"), (7, 1, "assistant", json.dumps(call), None),
        (7, 2, "tool", json.dumps({"tool_call_id": "2", "content": "two"}), None), (7, 3, "tool", "not json", None), (7, 4, None, None, None),
    ]
    chat = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, name string")
    calls, results, after = toolcalls.from_chat(chat)
    out = {(r["kind"], r["call_id"]): r for r in toolcalls.link_tool_calls(calls, results, SCHEMAS, after).collect()}
    assert out["call", "1"]["status"] == "unanswered" and out["call", "2"]["status"] == "linked"
    assert out["call", "2"]["step"] == 1 and out["call", "2"]["valid"]
    assert out["result", None]["status"] == "unidentified"


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    cursor = con.execute(toolcalls.ORACLE_SQL)
    names = [d[0] for d in cursor.description]
    want = Counter(cursor.fetchall())
    got = toolcalls.op1_tool_calls(spark, sf_dir).select(*names).collect()
    assert Counter(tuple(r) for r in got) == want


def test_turns_odd(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", "twice"), (1, 1, None, "x"), (None, 0, "user", "x"), (2, None, "user", "x"), (3, 5, "assistant", "lost")]
    calls, results, after = toolcalls.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = toolcalls.link_tool_calls(calls, results, toolcalls.SCHEMAS, after).collect()
    assert len(out) == 5  # the linked result has no row of its own
