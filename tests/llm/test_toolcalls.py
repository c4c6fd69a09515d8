"""Tool-call linking on hand-made conversations."""

import json

from reviewsift.llm import toolcalls
from reviewsift.llm.queries import SCHEMAS

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after string, content string"
RESULTS = "conv_id long, call_id string, turn long, content string, name string"


def linked(spark, calls, results):
    df = toolcalls.link_tool_calls(
        spark.createDataFrame([(*c, "clash") for c in calls], CALLS),
        spark.createDataFrame([(*r, "clash") for r in results], RESULTS), SCHEMAS)
    return {(r.conv_id, r.call_id): r for r in df.collect()}


def test_links_and_status(spark):
    good = '{"limit":1, "query":"q"}'
    calls = [(1, "a", 1, "search", good, None), (1, "b", 3, "search", good, "a"), (1, "c", 5, "search", good, "b"), (1, "d", 7, "search", good, "gone"),
             (2, "a", 9, "search", good, "a"), (2, "b", 1, "search", good, "c"), (2, "c", 1, "search", good, "b"), (2, "e", 1, "search", good, "c"),
             (3, "a", 1, "search", good, None), (3, "a", 4, "lookup", good, None), (None, "a", 1, "search", good, "a"), (1, None, 1, "search", good, "a")]
    results = [(1, "a", 2, "r1"), (1, "b", 3, "r2"), (1, "zz", 3, "r3"), (3, "a", 2, "first"), (3, "a", 3, "second"), (2, "a", 10, "x"), (1, None, 2, "n")]
    got = linked(spark, calls, results)
    status = {k: (r.status, r.depth) for k, r in got.items()}
    assert status == {
        (1, "a"): ("linked", 0), (1, "b"): ("early_result", 1), (1, "c"): ("unanswered", 2), (1, "d"): ("unanswered", 0),
        (2, "a"): ("cyclic", None), (2, "b"): ("cyclic", None), (2, "c"): ("cyclic", None), (2, "e"): ("cyclic", None),
        (3, "a"): ("linked", 0), (None, "a"): ("unanswered", 0), (1, None): got[1, None].status and (got[1, None].status, got[1, None].depth),
        (1, "zz"): ("orphan_result", None)}
    assert (got[3, "a"].n_calls, got[3, "a"].n_results, got[3, "a"].result_turn) == (2, 2, 2)
    assert got[1, "a"].json == '{"arguments":{"limit":1,"query":"q"},"id":"a","name":"search","result":"r1"}'
    assert got[1, "zz"].valid is None


def test_long_chain(spark):
    n = 300
    calls = [(1, str(i), i, "lookup", "{}", str(i - 1)) for i in range(n)] + [(1, f"x{i}", 500, "lookup", "{}", "0") for i in range(50)]
    got = linked(spark, calls, [])
    assert all(got[1, str(i)].depth == i for i in range(n)) and all(got[1, f"x{i}"].depth == 1 for i in range(50))


def test_validation(spark):
    cases = {
        '{"query":"é\\n\\"","limit":3}': [], ' { "limit" : 3 , "query" : "" } ': [], '{"query":"a"}': ["missing:limit"], '{"query":null,"limit":1}': ["missing:query"],
        '{"query":1,"limit":"2"}': ["type:limit", "type:query"], '{"query":"a","limit":1.5}': ["type:limit"], '{"query":"a","limit":1,"zz":{"b":1,"a":[true]}}': ["unexpected:zz"],
        "": ["invalid_json"], None: ["invalid_json"], "[1]": ["invalid_json"], "{": ["invalid_json"], '"text"': ["invalid_json"],
        '{"query":"' + "long " * 50_000 + '","limit":1}': []}
    calls = [(1, f"c{i}", i, "search", a, None) for i, a in enumerate(cases)]
    calls += [(1, "u", 1, "nobody", "{}", None), (1, "n", 1, None, "{}", None), (1, "o", 1, "measure", '{"text":"t"}', None),
              (1, "p", 1, "measure", '{"text":"t","scale":true}', None)]
    got = linked(spark, calls, [])
    for i, (arguments, errors) in enumerate(cases.items()):
        r = got[1, f"c{i}"]
        assert (r.valid, list(r.errors)) == (not errors, errors), arguments
        back = json.loads(r.json)
        if arguments and errors != ["invalid_json"]:
            assert back["arguments"] == json.loads(arguments)
            assert r.json == json.dumps(back, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert [list(got[1, k].errors) for k in "unop"] == [["unknown_tool"], ["unknown_tool"], [], ["type:scale"]]


def test_no_rows(spark):
    assert linked(spark, [], []) == {}
