import json
import random

from verdigris.llm import chat


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, id string")
    return {(r.conv_id, r.turn, r.part): r for r in chat.format_conversations(df).collect()}


def call(i, name="f", **args):
    return "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": args}) + "</tool_call>"


def reply(i, content):
    return "<tool_response>" + json.dumps({"tool_call_id": i, "content": content}) + "</tool_response>"


TOOLS = '<tools>[{"name":"f","parameters":{"type":"object","properties":{"x":{"type":"integer"}},"required":["x"],"additionalProperties":false}}]</tools>'


def test_links_levels_and_validation(spark):
    rows = [
        (1, 0, "system", TOOLS, "k"),
        (1, 1, "assistant", "Wait. " + call("a", x=1) + call("b", x="$a"), "k"),
        (1, 2, "tool", reply("a", {"z": 1.0, "b": [1, 2]}) + reply("q", 0), "k"),
        (1, 3, "assistant", call("c", x="$d") + call("d", x="$c") + call("a", x=2), "k"),
        (None, 1, "assistant", call("a", x=1), "k"),
        (3, None, "assistant", call("a", x=1), "k"),
        (2, 0, None, None, "k"),
        (2, 1, "assistant", "<tool_call>{broken</tool_call>", "k"),
    ]
    out = run(spark, rows)
    a, b = out[1, 1, 1], out[1, 1, 2]
    assert (a.status, a.level, a.valid) == ("linked", 0, True)
    assert json.loads(a.json)["result"] == {"b": [1, 2], "z": 1}
    assert a.json.index('"arguments"') < a.json.index('"id"')
    assert (b.status, b.level, b.valid) == ("open", 1, False)
    assert (out[1, 2, 0].status, out[1, 2, 1].status) == ("linked", "orphan")
    assert [out[1, 3, i].status for i in range(3)] == ["cyclic", "cyclic", "repeated"]
    assert (out[None, 1, 0].status, out[3, None, 0].status) == ("unnamed", "open")
    assert out[2, 0, 0].json == '{"content":"","role":"user","type":"text"}'
    assert out[2, 1, 0].kind == "text"


def test_without_calls_and_empty(spark):
    out = run(spark, [(1, 0, "user", "hi", "x"), (1, 0, "user", "hi", "x")])
    assert len(out) == 1
    assert run(spark, []) == {}


def test_canonical():
    assert chat.canonical({"b": 1.0, "a": [True, None, "é"]}) == '{"a":[true,null,"é"],"b":1}'


def test_schema_keywords(spark):
    schemas = [
        ({"const": 1}, 1, True), ({"const": 1}, True, False), ({"enum": [1]}, True, False), ({"exclusiveMinimum": 2}, 2, False), ({"exclusiveMaximum": 2}, 2, False),
        ({"multipleOf": 0.1}, 0.3, True), ({"multipleOf": 2}, 3, False), ({"pattern": "^a+$"}, "ab", False), ({"minItems": 1}, [], False), ({"maxItems": 1}, [1, 2], False),
        ({"uniqueItems": True}, [1, 1], False), ({"uniqueItems": True}, [1, True], True), ({"additionalProperties": {"type": "string"}}, {"a": 1}, False),
        ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, 2, False), ({"oneOf": [{"minimum": 1}, {"minimum": 2}]}, 2, False),
        ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, 3, False), ({"not": {"type": "null"}}, None, False), ({"$ref": "#/$defs/n"}, 1, None), ({"if": {"type": "string"}}, 1, None),
    ]
    rows = []
    for i, (s, v, _) in enumerate(schemas):
        tool = {"name": "f", "parameters": {"type": "object", "properties": {"x": s}}}
        rows += [(i, 0, "system", "<tools>" + json.dumps([tool]) + "</tools>", "k"), (i, 1, "assistant", call("a", x=v), "k")]
    out = run(spark, rows)
    assert [out[i, 1, 0].valid for i in range(len(schemas))] == [want for *_, want in schemas]


def plainly(rows):
    """(conv, turn, part) -> (kind, id, level, status, result) of every part, one message at a time."""
    parts = [(c, t, i, *p) for c, t, role, text, _ in rows for i, p in enumerate(chat.parts_of(role, text))]
    calls, answers, out = {}, {}, {}
    for c, t, i, kind, key, _, body, needs in sorted((p for p in parts if p[4] is not None), key=lambda p: (p[1], p[2])):
        if kind == "call":
            calls.setdefault((c, key), (t, i, needs))
        elif kind == "result":
            answers.setdefault((c, key), (t, i, body))

    def level(k, above=()):
        if k in above:
            return None
        below = [level((k[0], n), (*above, k)) for n in calls[k][2] if (k[0], n) in calls]
        return None if None in below else 1 + max(below, default=-1)

    for c, t, i, kind, key, *_ in parts:
        k = (c, key)
        status, at, result = None, 0, None
        if kind in ("call", "result"):
            at = level(k) if k in calls and key is not None else 0
            if key is None or k not in calls:
                status = "unnamed" if kind == "call" else "orphan"
            elif kind == "call":
                own = calls[k][:2] == (t, i)
                status = "repeated" if not own else "cyclic" if at is None else "linked" if k in answers else "open"
                result = answers[k][2] if own and k in answers else None
            else:
                status = "linked" if answers[k][:2] == (t, i) else "repeated"
        out[c, t, i] = (kind, key, at, status, result)
    return out


def test_generated_calls_equal_a_plain_version(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(120):
        ids = [f"c{k}" for k in range(rng.randrange(1, 12))]
        for turn in range(rng.randrange(2, 14)):
            if turn % 2:
                text = "".join(reply(rng.choice([*ids, "nobody"]), {"n": rng.randrange(9)}) for _ in range(rng.randrange(1, 4)))
                rows.append((conv, turn, "tool", text, "k"))
            else:
                text = "".join(rng.choice(["", "Say. "]) + call(rng.choice([*ids, *ids, None]), x=rng.choice([1, "$" + rng.choice(ids), "$gone", [f"${rng.choice(ids)}", {"y": "$" + rng.choice(ids)}]])) for _ in range(rng.randrange(1, 5)))
                rows.append((conv, turn, "assistant", text, "k"))
    out, want = run(spark, rows), plainly(rows)
    assert out.keys() == want.keys()
    seen = set()
    for k, (kind, key, at, status, result) in want.items():
        r = out[k]
        assert (r.kind, r.call_id, r.level, r.status) == (kind, key, at, status), k
        assert json.loads(r.json).get("result") == (None if result is None else json.loads(result)), k
        seen.add((kind, status))
    assert {("call", s) for s in ("linked", "open", "repeated", "cyclic", "unnamed")} | {("result", s) for s in ("linked", "orphan", "repeated")} <= seen
    assert max(v[2] or 0 for v in want.values()) >= 2


def test_odd_values_do_no_harm(spark):
    deep = "[" * 3000 + "]" * 3000
    odd = [
        '{"id":1,"name":"f","arguments":{"x":' + "9" * 400 + "}}", '{"id":"\\ud800","name":"f\\udfff","arguments":{"x":"\\ud800"}}',
        '{"id":"d","name":"f","arguments":' + deep + "}", '{"id":"n","name":"f","arguments":{"x":NaN}}', '{"id":"i","name":"f","arguments":{"x":1e999}}',
        '{"id":[1],"name":"g","arguments":{"x":1}}',
    ]
    rows = [(1, 0, "system", '<tools>[{"name":"g","parameters":{"required":5}},{"name":"f","parameters":{"properties":{"x":{"type":"integer","multipleOf":3}}}}]</tools>', "k")]
    rows += [(1, 1 + i, "assistant", f"<tool_call>{x}</tool_call>", "k") for i, x in enumerate(odd)]
    rows.append((2, 0, "user", "word " * 400_000, "k"))
    out = run(spark, rows)
    assert [out[1, 1 + i, 0].kind for i in range(6)] == ["call", "call", "text", "text", "text", "call"]
    assert out[1, 1, 0].valid and out[1, 2, 0].call_id == "\\ud800" and not out[1, 2, 0].valid
    assert (out[1, 6, 0].call_id, out[1, 6, 0].valid) == ("[1]", None)
    assert all(json.loads(r.json) for r in out.values())


def test_broken_schemas_say_nothing_and_patterns_are_linear():
    import time

    for schema, value in [({"type": "integr"}, 1), ({"type": ["string", "txt"]}, "a"), ({"properties": 5}, {}), ({"enum": 3}, 3), ({"minLength": "5"}, "a"), ({"required": "a"}, {}), ({"items": [{}]}, [1]), ({"anyOf": []}, 1), ({"not": 3}, 1), ({"multipleOf": 0}, 1), ({"pattern": "(?=a)b"}, "b"), ({"pattern": "(a)\\1"}, "aa"), ({"properties": {"a": 7}}, {"a": 1}), (5, 1)]:
        assert chat._verdict(schema, value) == (None, []), schema
    for schema, value, want in [({"pattern": "^a$"}, "a\n", False), ({"pattern": "^a$"}, "a", True), ({"pattern": "b+"}, "abc", True), (True, 1, True), (False, 1, False), ({"additionalProperties": True}, {"x": 1}, True), ({"minLength": 2.0}, "ab", True), ({"pattern": "é$"}, "né", True)]:
        assert chat._verdict(schema, value)[0] is want, schema
    t = time.time()
    assert chat._verdict({"pattern": "(a+)+$"}, "a" * 5000 + "!")[0] is False and time.time() - t < 1


def test_long_chains(spark):
    """A chain of 1,000 calls takes a round or two, with identifiers that don't follow it."""
    import time

    names = [f"c{(i * 7919) % 1009:04d}" for i in range(1000)]
    call = lambda i: '<tool_call>{"id": "%s", "name": "f", "arguments": {"x": "%s"}}</tool_call>' % (names[i], f"${names[i - 1]}" if i else "start")  # noqa: E731, UP031
    rows = [(1, i, "assistant", call(i)) for i in range(1000)] + [(2, 0, "assistant", call(5)), (3, 0, "assistant", '<tool_call>{"id": "a", "name": "f", "arguments": "$b"}</tool_call><tool_call>{"id": "b", "name": "f", "arguments": ["$a"]}</tool_call><tool_call>{"id": "d", "name": "f", "arguments": {"y": "$b"}}</tool_call>')]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    t = time.time()
    got = {(r.conv_id, r.call_id): r.level for r in chat.format_conversations(d).collect()}
    assert time.time() - t < 60
    assert got == {(1, n): i for i, n in enumerate(names)} | {(2, names[5]): 0, (3, "a"): None, (3, "b"): None, (3, "d"): None}
