"""Tool-call linking: order against a plain graph search, validation, canonical JSON, odd rows."""

import json
import random

import pytest

from grainguard.llm import toolcalls
from grainguard.llm.queries import ORACLE, QUERIES

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>, status int"
RESULTS = "conv_id long, call_id string, turn long, content string, level string"
SCHEMAS = {"f": {"a": ("integer", True), "b": ("string", False)}, "g": {"x": ("array", True), "y": ("object", False), "z": ("number", False)}}


def linked(spark, calls, results):
    out = toolcalls.link_tool_calls(
        spark.createDataFrame([(*c, 1) for c in calls], CALLS), spark.createDataFrame([(*r, "x") for r in results], RESULTS), SCHEMAS
    ).collect()
    return {(r.conv_id, r.call_id): r for r in out}


def waits_for_itself(deps):
    """Calls that are in a cycle or wait for one, by depth-first search."""
    def reach(a):
        seen, todo = set(), list(deps.get(a, ()))
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += deps.get(b, ())
        return seen

    cyclic = {a for a in deps if a in reach(a)}
    return {a for a in deps if a in cyclic or reach(a) & cyclic}, cyclic


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_order(spark, seed):
    r = random.Random(seed)
    calls, deps = [], {}
    for conv, n in [(1, 120), *((c, r.randint(1, 6)) for c in range(2, 40))]:
        turn = {f"c{i}": r.randint(0, n) for i in range(n)}
        for c in turn:
            late = r.random() < 0.15
            own = [d for d in r.sample(sorted(turn), min(2, n)) if (turn[d] < turn[c]) or late]
            calls.append((conv, c, turn[c], "f", '{"a":1}', own))
            deps[conv, c] = [(conv, d) for d in own]
    rows = linked(spark, calls, [])
    assert len(rows) == len(calls)
    stuck, cyclic = waits_for_itself(deps)
    for c, row in rows.items():
        if c in cyclic:
            assert row.status == "cycle" and row.level is None
        if row.level is None:
            assert c in stuck
        for d in deps[c]:
            if row.level is not None and rows[d].level is not None:
                place = lambda x: (x.ready_turn, x.level, x.turn, x.call_id)
                assert place(rows[d]) < place(row)


def test_validation_and_json(spark):
    arguments = {
        "ok": '{"b": "é\\n\\"", "a": 3}', "type": '{"a": "3"}', "missing": "{}", "more": '{"a":1,"zz":2,"c":null}', "list": "[1]",
        "broken": '{"a":', "null": None, "twice": '{"a":1,"a":2}', "half": '{"a":1.5}', "void": '{"a":null}',
    }
    rows = linked(spark, [(1, k, 1, "f", v, None) for k, v in arguments.items()], [(1, "ok", 2, 'said "x"\n')])
    got = {k: rows[1, k].errors for k in arguments}
    assert got == {
        "ok": "", "type": "type:a", "missing": "missing:a", "more": "unexpected:c,unexpected:zz", "list": "malformed",
        "broken": "malformed", "null": "malformed", "twice": "malformed", "half": "type:a", "void": "type:a",
    }
    assert rows[1, "ok"].status == "linked"
    message = {"arguments": json.loads(arguments["ok"]), "call_id": "ok", "depends_on": [], "name": "f", "result": 'said "x"\n'}
    assert rows[1, "ok"].message == json.dumps(message, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    nested = '{"z": 2, "x": [ {"q":1, "p": [true , null]} ], "y": {"b":{}, "a":""}}'
    rows = linked(spark, [(1, "n", 0, "g", nested, []), (1, "h", 0, "nope", "{}", [])], [])
    assert rows[1, "n"].message.startswith('{"arguments":' + json.dumps(json.loads(nested), sort_keys=True, separators=(",", ":")))
    assert rows[1, "h"].errors == "unknown_tool" and rows[1, "n"].status == "unanswered"


def test_repeats_nulls_and_hot_conversation(spark):
    calls = [(1, "a", 5, "f", '{"a":2}', None), (1, "a", 3, "f", '{"a":1}', ["b", "b", None]), (1, "b", None, None, '{"a":1}', [])]
    calls += [(None, "x", 1, "f", "{}", []), (2, None, 1, "f", "{}", []), (1, "m", 9, "f", '{"a":1}', ["gone"])]
    calls += [(7, f"h{i}", i, "f", '{"a":1}', [f"h{i - 1}"] if i else None) for i in range(400)]
    results = [(1, "a", 9, "late"), (1, "a", 4, None), (1, "zz", 8, "orphan"), (None, "a", 1, "n")] + [(7, "h3", 4, "hot")] * 50
    rows = linked(spark, calls, results)
    assert len(rows) == 4 + 400
    assert (rows[1, "a"].turn, rows[1, "a"].n_calls, rows[1, "a"].n_results, rows[1, "a"].status) == (3, 2, 2, "linked")
    assert '"depends_on":["b"]' in rows[1, "a"].message and rows[1, "a"].message.endswith('"result":null}')
    assert rows[1, "zz"].status == "orphan_result" and rows[1, "m"].status == "missing_dependency"
    assert rows[1, "b"].turn == -1 and rows[1, "b"].status == "invalid"
    assert all(rows[7, f"h{i}"].ready_turn == i and rows[7, f"h{i}"].level == 0 for i in range(400))
    assert rows[7, "h3"].n_results == 50


def test_empty_tables(spark):
    assert linked(spark, [], []) == {}
    assert [r.status for r in linked(spark, [], [(1, "a", 0, "x")]).values()] == ["orphan_result"]


def test_rows_without_conversation_or_turn_against_the_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = ["a", "bb", "seven77", "x" * 11, "four", "threefivexthree", "y" * 13]
    rows = [(conv, turn, role, t) for conv, turn in [(None, 2), (5, None), (None, None)] for role in ("user", "assistant") for t in texts]
    rows += [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "dddd"), (2, 3, "assistant", "orphan")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    wanted = db.execute(ORACLE["op8_tool_call_linking"]).fetchall()
    got = [tuple(r) for r in QUERIES["op8_tool_call_linking"](spark, str(tmp_path)).collect()]
    assert len(got) == len(rows) - 1
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
