import json

from feedmill.llm import chat, queries

SCHEMAS = [("find", "q", "string", True), ("find", "n", "integer", False), ("find", "x", "number", False), ("find", "o", "object", False), ("find", "l", "array", False)]


def run(spark, calls, results, schemas=SCHEMAS):
    c = spark.createDataFrame([(*r, "extra") for r in calls], "conv_id long, turn long, call_id string, name string, arguments string, line string")
    r = spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string")
    return chat.linked(c.repartition(3), r, spark.createDataFrame(schemas, "tool string, field string, type string, required boolean")).collect()


def test_links_order_and_lines(spark):
    calls = [
        (1, 1, "a", "find", '{"q": "x", "n": 3}'), (1, 1, "a", "find", '{"q": "x", "n": 3}'), (1, 2, "a", "find", "{}"),
        (1, 3, "b", "find", '{ "q": "$a", "n": null }'), (1, 5, "c", "find", '{"q":"$b and $a and $zz and $c"}'),
        (2, 1, "a", "find", '{"q":"$b"}'), (2, 2, "b", "find", '{"q":"$a"}'), (2, 3, "d", "find", '{"q":"$a"}'),
        (3, 1, "a", None, None), (None, 1, "a", "find", "{}"), (3, 1, None, "find", "{}"), (4, 1, "é\"", "find", '{"q":"Ü\\n\\"","x":2,"o":{"b":1,"a":[1, 2]},"l":[]}'),
    ]
    results = [(1, 2, "a", "found"), (1, 9, "a", "again"), (1, 4, "b", None), (7, 1, "a", "orphan\n\"x\""), (2, 4, "b", "r"), (None, 1, "a", "n")]
    out = {(r.conv_id, r.call_id, r.kind, r.turn): r for r in run(spark, calls, results)}
    assert len(out) == 14
    state = {k: (r.status, r.level) for k, r in out.items()}
    assert state[1, "a", "call", 1] == ("linked", 0) and state[1, "a", "call", 2] == ("repeated", None)
    assert state[1, "b", "call", 3] == ("linked", 1) and state[1, "c", "call", 5] == ("unanswered", 2)
    assert [state[2, i, "call", t][0] for i, t in (("a", 1), ("b", 2), ("d", 3))] == ["cycle"] * 3 and state[2, "b", "result", 4] == ("cycle", None)
    assert state[1, "a", "result", 2] == ("linked", 0) and state[1, "a", "result", 9][0] == "repeated" and state[7, "a", "result", 1] == ("orphan", 0)
    assert out[1, "b", "call", 3].line == '{"arguments":{"n":null,"q":"$a"},"call_id":"b","name":"find"}' and not out[1, "b", "call", 3].errors
    assert out[3, "a", "call", 1].line == '{"arguments":null,"call_id":"a","name":null}'
    assert out[1, "b", "result", 4].line == '{"call_id":"b","content":null}'
    assert json.loads(out[7, "a", "result", 1].line) == {"call_id": "a", "content": 'orphan\n"x"'}
    line = out[4, 'é"', "call", 1].line
    assert json.loads(line) == {"arguments": {"q": 'Ü\n"', "x": 2, "o": {"b": 1, "a": [1, 2]}, "l": []}, "call_id": 'é"', "name": "find"}
    assert line == json.dumps(json.loads(line), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert not out[4, 'é"', "call", 1].errors


def test_validation(spark):
    cases = {
        "a": ("find", "not json", ["arguments are not an object"]), "b": ("find", "[1]", ["arguments are not an object"]), "c": ("none", "{}", ["unknown tool"]),
        "d": ("find", '{"n":"3","z":1}', ["missing q", "n is not integer", "unexpected z"]), "e": ("find", '{"q":null}', ["q is not string"]),
        "f": ("find", '{"q":"","x":1.5,"n":1.5}', ["n is not integer"]), "g": ("find", '{"q":"","o":[],"l":{}}', ["l is not array", "o is not object"]), "h": ("find", None, ["arguments are not an object"]),
    }
    out = run(spark, [(1, 1, i, n, a) for i, (n, a, _) in cases.items()], [])
    assert {r.call_id: r.errors for r in out} == {i: e for i, (_, _, e) in cases.items()}
    assert run(spark, [], []) == []


def test_query(spark, medium):
    frame = queries.QUERIES["op9_chat"].run(spark, medium)
    out = frame.collect()
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
    turns = spark.read.parquet(f"{medium}/conversations.parquet").collect()
    calls = {(r.conv_id, f"c{r.turn}"): r for r in turns if r.role == "assistant"}
    answers = {(r.conv_id, f"c{r.turn - 1}"): r for r in turns if r.role == "user" and r.turn > 0}
    got = {(r.conv_id, r.call_id): r for r in out if r.kind == "call"}
    assert set(got) == set(calls) and {(r.conv_id, r.call_id) for r in out if r.kind == "result"} == set(answers)
    depth = {}
    for key in sorted(calls, key=lambda k: (k[0], calls[k].turn)):
        r, n = calls[key], len(calls[key].text)
        on = (r.conv_id, f"c{r.turn - 2}")
        depth[key] = 1 + depth[on] if r.turn >= 3 and n % 3 == 0 and on in calls else 0
        errors = ["unknown tool"] if n % 3 == 2 else []
        if n % 3 == 0 and n % 7 == 0:
            errors = ["size is not integer"]
        if n % 3 == 1:
            errors = ["missing unit"] + (["size is not number"] if n % 7 == 0 else [])
        assert (got[key].level, got[key].errors) == (depth[key], "; ".join(errors))
        assert got[key].status == ("linked" if key in answers else "unanswered")
        assert json.loads(got[key].line)["call_id"] == key[1]
    assert max(depth.values()) >= 1


def test_query_lines_hold_whole_texts(spark, medium, tmp_path):
    turns = spark.read.parquet(f"{medium}/conversations.parquet")
    odd = [(-1, 0, "user", "go"), (-1, 1, "assistant", 'said "a\\b"\r\n\tthen 5 ü 漢 😀 {}, ' * 30), (-1, 2, "user", 'and "so"\n'), (-2, 1, "assistant", None), (-3, 1, "assistant", "")]
    more = spark.createDataFrame(odd, "conv_id long, turn int, role string, text string")
    cols = ["conv_id", "turn", "role", "text"]
    turns.select(cols).union(more.select([more[c].cast(turns.schema[c].dataType) for c in cols])).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.kind, r.turn): r.line for r in queries.QUERIES["op9_chat"].run(spark, str(tmp_path)).collect()}
    want = {}
    for r in spark.read.parquet(str(tmp_path / "conversations.parquet")).collect():
        if r.role == "assistant":
            n, arguments = len(r.text or ""), None
            if r.text is not None:
                arguments = {"text": r.text, "size": n if n % 7 else "many"} | ({"after": f"$c{r.turn - 2}"} if r.turn >= 3 and n % 3 == 0 else {})
            name = "open" if r.text is None else ("search", "measure", "open")[n % 3]
            want[r.conv_id, "call", r.turn] = {"arguments": arguments, "call_id": f"c{r.turn}", "name": name}
        elif r.role == "user" and r.turn > 0:
            want[r.conv_id, "result", r.turn] = {"call_id": f"c{r.turn - 1}", "content": r.text}
    assert got == {k: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for k, v in want.items()}
