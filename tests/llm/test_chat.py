import json
import random

from tessara.llm.chat import PART_TURNS, format_chats
from tessara.llm.queries import op10_chat

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, json string, part int"
TOOLS = [("add", '{"type":"object","required":["x"],"properties":{"x":{"type":"integer"},"y":{"type":"number"},"s":{"type":"string"},"a":{"type":"array"},"o":{"type":"object"},"b":{"type":"boolean"},"n":{"type":"null"}},"additionalProperties":false}'), ("free", "{}"), (None, "{}")]


def chats(frame, rows, schemas=None):
    df = frame(SCHEMA, [(*r, "clash", 9) for r in rows])
    tools = None if schemas is None else frame("name string, parameters string", schemas)
    return {(r.conv_id, r.part): r for r in format_chats(df, tools).collect()}


def call(*calls, content="x"):
    return json.dumps({"content": content, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(i, content="4"):
    return json.dumps({"tool_call_id": i, "content": content})


def test_results_follow_their_calls(frame):
    rows = [(1, 0, "user", "hi"), (1, 1, "tool", result("b")), (1, 2, "assistant", call(("a", "add", {"z": {"q": 1, "b": [1, {"d": 1, "c": 2}]}, "x": 1}), ("b", "add", '{"y": 2.5}'))), (1, 3, "user", "wait"), (1, 4, "tool", result("a")), (1, 5, "tool", result("none"))]
    random.Random(1).shuffle(rows)
    r = chats(frame, rows)[1, 0]
    said = json.loads(r.json)["messages"]
    assert [m.get("tool_call_id") or m["role"] for m in said] == ["user", "assistant", "a", "b", "user", "none"]
    assert said[1]["tool_calls"][1]["arguments"] == {"y": 2.5}
    assert '"arguments":{"x":1,"z":{"b":[1,{"c":2,"d":1}],"q":1}},"id":"a","name":"add"' in r.json
    assert (r.n_messages, r.n_calls, r.n_linked, r.n_orphans) == (6, 2, 2, 1)
    assert r.json == json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_arguments_are_held_against_schemas(frame):
    good = [{"x": 1}, {"x": 1, "y": 1}, {"x": 1, "y": 1.5, "s": "t", "a": [], "o": {}, "b": True, "n": None}]
    bad = [{}, {"y": 1}, {"x": "1"}, {"x": 1.5}, {"x": 1, "other": 1}, {"x": None}, [1], "no json", {"x": 1, "b": 1}, None]
    rows = [(k, 0, "assistant", call(("i", "add", a))) for k, a in enumerate(good + bad)] + [(100, 0, "assistant", call(("i", "free", {"q": 1}))), (101, 0, "assistant", call(("i", "unknown", {}))), (102, 0, "assistant", call((None, "free", {})))]
    got = {k: r.n_invalid for (k, _), r in chats(frame, rows, TOOLS).items()}
    assert got == {**dict.fromkeys(range(len(good)), 0), **dict.fromkeys(range(len(good), len(good) + len(bad)), 1), 100: 0, 101: 1, 102: 1}


def test_conversations_declare_their_tools(frame):
    def tools(*listed):
        return json.dumps({"tools": list(listed)})

    f, g = {"name": "f", "parameters": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}}, {"type": "function", "function": {"name": "g", "parameters": {"properties": {"y": {"enum": [1, 2]}}}}}
    rows = [(1, 0, "system", tools(f, g)), (1, 1, "assistant", call(("a", "f", {"x": 1}), ("b", "f", {"x": "1"}), ("c", "g", {"y": 2}), ("d", "g", {"y": 3}), ("e", "h", {})))]
    rows += [(2, 0, "system", "be kind"), (2, 1, "assistant", call(("a", "f", {"x": "1"}), (None, "f", {}), ("c", None, {})))]
    rows += [(3, 0, "system", tools({"name": "f"})), (3, 1, "system", '{"tools": 1}'), (3, 2, "assistant", call(("a", "f", {"x": "1"}), ("b", "f", [1])))]
    rows += [(4, 0, "system", tools()), (4, 1, "user", tools(f)), (4, 2, "assistant", call(("a", "f", {})))]
    rows += [(None, 0, "system", tools(f)), (None, 1, "assistant", call(("a", "f", {}))), (5, None, "system", None), (5, None, "system", tools({}, {"name": None}))]
    got = {k: (r.n_calls, r.n_invalid) for (k, _), r in chats(frame, rows).items()}
    assert got == {1: (5, 3), 2: (3, 2), 3: (2, 1), 4: (1, 0), None: (1, 0), 5: (0, 0)}
    given = {k: r.n_invalid for (k, _), r in chats(frame, rows, [("f", "{}")]).items()}
    assert given == {1: 3, 2: 2, 3: 1, 4: 0, None: 0, 5: 0}
    assert {r.n_invalid for r in chats(frame, rows, []).values()} == {5, 3, 2, 1, 0}


NESTED = {
    "type": "object",
    "required": ["to"],
    "properties": {
        "to": {"type": "array", "items": {"type": "object", "required": ["{}"], "properties": {"{}": {"type": "string"}, "n": {"type": ["integer", "null"]}}, "additionalProperties": False}},
        "unit": {"enum": ["C", "F", 3, None, {"b": 1, "a": [2]}]},
        "mode": {"const": "x"},
        "level": {"type": "number", "minimum": 0, "maximum": 1.5},
        "any": True,
        "never": False,
    },
    "additionalProperties": {"type": "boolean"},
}


def plain(v, s):
    """Whether the schema accepts the value."""
    if isinstance(s, bool):
        return s
    kinds = {dict: ["object"], list: ["array"], str: ["string"], bool: ["boolean"], int: ["integer", "number"], float: ["number"], type(None): ["null"]}[type(v)]
    wanted = s.get("type", kinds)
    same = lambda x: json.dumps(x, sort_keys=True) == json.dumps(v, sort_keys=True)
    ok = bool(set(kinds) & set([wanted] if isinstance(wanted, str) else wanted))
    ok &= not ("enum" in s and not any(map(same, s["enum"]))) and not ("const" in s and not same(s["const"]))
    if "number" in kinds:
        ok &= s.get("minimum", v) <= v <= s.get("maximum", v)
    if isinstance(v, dict):
        ok &= set(s.get("required", [])) <= set(v) and all(plain(x, s.get("properties", {}).get(k, s.get("additionalProperties", True))) for k, x in v.items())
    if isinstance(v, list):
        ok &= all(plain(x, s.get("items", True)) for x in v)
    return ok


def test_nested_schemas_as_a_plain_validator(frame):
    to = [[], [{"{}": "a"}], [{"{}": "a", "n": None}, {"{}": "b", "n": 2}], [{"{}": 1}], [{"n": 1}], [{"{}": "a", "z": 1}], [{"{}": "a", "n": 1.5}], ["a"], {"{}": "a"}, None, [{"{}": "a"}, None]]
    rest = [{}, {"unit": "C"}, {"unit": 3}, {"unit": None}, {"unit": {"a": [2], "b": 1}}, {"unit": "K"}, {"unit": {"a": [1], "b": 1}}, {"mode": "x"}, {"mode": "y"}, {"level": 0}, {"level": 1.5}, {"level": 1.75}, {"level": -1}, {"level": "1"}, {"any": [1, {"q": None}]}, {"never": 1}, {"other": True}, {"other": 1}]
    args = [{"to": t} for t in to] + [{"to": [], **r} for r in rest] + rest[:3]
    rows = [(k, 0, "assistant", call(("i", "nested", a))) for k, a in enumerate(args)]
    tools = [("nested", json.dumps(NESTED)), ("nested", "~ later by text, so not taken"), ("broken", "no json")]
    got = {k: r.n_invalid == 0 for (k, _), r in chats(frame, [*rows, (1000, 0, "assistant", call(("i", "broken", {"q": 1})))], tools).items()}
    want = {k: plain(a, NESTED) for k, a in enumerate(args)}
    assert got == {**want, 1000: True} and 8 < sum(want.values()) < len(want) - 8


def test_many_schemas_are_joined_by_salts(frame, monkeypatch):
    from tessara.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    got = chats(frame, [(1, 0, "assistant", call(("a", "add", {"x": 1}), ("b", "add", {"x": "1"}), ("c", "none", {})))], TOOLS)
    assert got[1, 0].n_invalid == 2


def test_odd_messages(frame):
    rows = [(None, None, None, None), (None, None, None, None), (2, 0, "assistant", "{bad"), (2, 0, "assistant", "{bad"), (3, 1, "user", '{"tool_calls":[]}'), (3, None, "user", "last"), (4, 0, "assistant", ""), (5, 0, "assistant", "ü\n\"" + "y" * 100_000), (6, 0, "tool", result("x")), (6, 1, "assistant", call(("x", "f", {}), ("x", "g", {}))), (6, 2, "tool", result("x"))]
    got = chats(frame, rows)
    assert got[None, 0].n_messages == 2 and got[2, 0].n_messages == 2
    assert [m["content"] for m in json.loads(got[3, 0].json)["messages"]] == ['{"tool_calls":[]}', "last"]
    assert len(json.loads(got[5, 0].json)["messages"][0]["content"]) == 100_003
    assert got[6, 0].n_linked == 2 and got[6, 0].n_calls == 2
    assert chats(frame, []) == {} and chats(frame, [], TOOLS) == {}


def test_long_conversations_are_cut_into_parts(frame):
    n = 2 * PART_TURNS + 5
    got = chats(frame, [(1, t, "user", str(t)) for t in range(n)])
    assert [got[1, p].n_messages for p in range(3)] == [PART_TURNS, PART_TURNS, 5]
    assert [m["content"] for p in range(3) for m in json.loads(got[1, p].json)["messages"]] == [str(t) for t in range(n)]


def test_query(spark):
    df = op10_chat(spark, FOLDER)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text
    rows = spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()
    got = [(json.loads(r.json)["conv_id"], m["role"], m["content"]) for r in df.orderBy("conv_id", "part").collect() for m in json.loads(r.json)["messages"]]
    assert got == [(r.conv_id, r.role, r.text) for r in sorted(rows, key=lambda r: (r.conv_id, r.turn))]
