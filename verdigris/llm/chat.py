"""Chat formatting with linked tool calls.

Assistant turns may hold ``<tool_call>{"id", "name", "arguments"}</tool_call>`` blocks, tool turns
``<tool_response>{"id" or "tool_call_id", "content"}</tool_response>`` blocks, and system turns ``<tools>[...]</tools>``
with JSON schemas. Calls and results are joined by (conversation, identifier) in hash joins, calls and schemas by
(conversation, name). An argument string "$id" that names another call makes the caller depend on it. Calls are range-partitioned
by conversation and identifier; each task orders what it can, however deep, and what hangs on calls of other tasks waits
for the next round, so a conversation that fits in a task takes one. Every message becomes one row of canonical JSON:
sorted keys, no spaces, calls with their level, result and verdict. Conversations are not collected into one value, so
none can outgrow a task; (level, turn, part) orders a conversation's rows topologically.

Null texts are empty, null roles are "user". Blocks that don't parse stay ordinary text. Of calls with equal identifiers the
first by (turn, part) is linked, the others are "repeated"; results without a call are "orphan", calls without a result
"open". Calls in a cycle, or that hang on one, are "cyclic" with a null level. Repeated rows give a row each, the
later one by content counting as a repetition. Calls without an identifier or a conversation are "unnamed". A call without a known schema, or with one
whose keywords aren't all implemented and well-formed, is neither valid nor invalid. Patterns run in linear time, by automata; one that
automata can't run, with look-around or back references, says nothing either. Blocks nested deeper than ``DEEPEST`` stay text.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, per_batch, rows_of

BLOCK = re.compile(r"<(tool_call|tool_response|tools)>(.*?)</\1>", re.DOTALL)
LONE = re.compile("[\ud800-\udfff]")
DEEPEST = 200
REFERENCE = re.compile(r"\$([A-Za-z0-9_.:-]+)")


def canonical(value) -> str:
    """RFC 8785 in spirit: sorted keys, no spaces, no escapes beyond JSON's own, integral doubles as integers."""

    def plain(v):
        if isinstance(v, float) and math.isfinite(v) and v == int(v) and abs(v) < 2**53:
            return int(v)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return writable(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def writable(s: str) -> str:
    """``s`` with escapes for lone surrogates, which no UTF-8 text can hold."""
    return LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", s)


def _number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


#: The types of JSON schemas.
TYPES = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None, "number": _number, "integer": lambda v: _number(v) and (isinstance(v, int) or v.is_integer()),
}


def _count(v) -> bool:
    return TYPES["integer"](v) and v >= 0


def _schema(v) -> bool:
    return isinstance(v, (dict, bool))


#: What a keyword's own value must be.
WELL_FORMED = {
    "type": lambda v: v in TYPES if isinstance(v, str) else isinstance(v, list) and bool(v) and all(isinstance(k, str) and k in TYPES for k in v),
    "enum": lambda v: isinstance(v, list), "properties": lambda v: isinstance(v, dict) and all(map(_schema, v.values())), "required": lambda v: isinstance(v, list) and all(isinstance(k, str) for k in v),
    "additionalProperties": _schema, "items": _schema, "not": _schema, "pattern": lambda v: isinstance(v, str), "uniqueItems": lambda v: isinstance(v, bool),
    "minimum": _number, "maximum": _number, "exclusiveMinimum": lambda v: _number(v) or isinstance(v, bool), "exclusiveMaximum": lambda v: _number(v) or isinstance(v, bool), "multipleOf": lambda v: _number(v) and v > 0,
    **dict.fromkeys(("minLength", "maxLength", "minItems", "maxItems"), _count), **dict.fromkeys(("allOf", "anyOf", "oneOf"), lambda v: isinstance(v, list) and bool(v) and all(map(_schema, v))),
}


#: Keywords that constrain values and aren't implemented.
UNSUPPORTED = frozenset(
    "$dynamicRef $recursiveRef if then else contains minContains maxContains prefixItems additionalItems propertyNames dependencies "
    "dependentRequired dependentSchemas patternProperties minProperties maxProperties unevaluatedItems unevaluatedProperties $ref".split()
)


class UnsupportedSchema(ValueError):
    """A schema of which nothing can be said."""


def _matches(pattern: str, value: str) -> bool:
    try:
        return pc.match_substring_regex(pa.array([value], pa.string()), pattern)[0].as_py()
    except (pa.ArrowInvalid, UnicodeEncodeError):
        raise UnsupportedSchema(f"pattern {pattern}") from None


def problems(schema, value, path: str = "$") -> list[str]:
    """Where ``value`` breaks a JSON schema.

    Types, enums, constants, bounds, multiples, lengths, patterns, required and further properties, items and their number
    and combined schemas are looked at; where other keywords constrain the value, references too, UnsupportedSchema is raised.
    """
    if schema is False:
        return [f"{path}: not allowed"]
    if schema is True:
        return []
    if not isinstance(schema, dict):
        raise UnsupportedSchema(path)
    if found := [k for k, well in WELL_FORMED.items() if k in schema and not well(schema[k])] + sorted(UNSUPPORTED & schema.keys()):
        raise UnsupportedSchema(", ".join(found))
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(TYPES[k](value) for k in kinds):
        return [f"{path}: not {'/'.join(kinds)}"]
    out = []
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{path}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{path}: not the constant")
    if _number(value):
        low, high = schema.get("exclusiveMinimum"), schema.get("exclusiveMaximum")
        low, high = schema.get("minimum") if low is True else low, schema.get("maximum") if high is True else high
        if _number(schema.get("minimum")) and value < schema["minimum"] or _number(low) and value <= low:
            out.append(f"{path}: below minimum")
        if _number(schema.get("maximum")) and value > schema["maximum"] or _number(high) and value >= high:
            out.append(f"{path}: above maximum")
        step = schema.get("multipleOf")
        if _number(step) and step > 0 and Fraction(str(value)) % Fraction(str(step)):
            out.append(f"{path}: not a multiple")
    if isinstance(value, str):
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            out.append(f"{path}: too long")
        if "minLength" in schema and len(value) < schema["minLength"]:
            out.append(f"{path}: too short")
        if "pattern" in schema and not _matches(schema["pattern"], value):
            out.append(f"{path}: doesn't match pattern")
    if isinstance(value, dict):
        known, further = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in value:
            if k not in known:
                out += [f"{path}.{k}: unknown"] if further is False else problems(further, value[k], f"{path}.{k}")
        for k, s in known.items():
            if k in value:
                out += problems(s, value[k], f"{path}.{k}")
    if isinstance(value, list):
        if "minItems" in schema and len(value) < schema["minItems"]:
            out.append(f"{path}: too few items")
        if "maxItems" in schema and len(value) > schema["maxItems"]:
            out.append(f"{path}: too many items")
        if schema.get("uniqueItems") is True and len(set(map(canonical, value))) < len(value):
            out.append(f"{path}: repeated items")
        for i, x in enumerate(value):
            out += problems(schema.get("items", True), x, f"{path}[{i}]")
    branches = {k: [problems(s, value, path) for s in schema[k]] for k in ("allOf", "anyOf", "oneOf") if k in schema}
    out += [p for found in branches.get("allOf", ()) for p in found]
    if "anyOf" in branches and all(branches["anyOf"]):
        out.append(f"{path}: none of anyOf")
    if "oneOf" in branches and sum(not found for found in branches["oneOf"]) != 1:
        out.append(f"{path}: not one of oneOf")
    if "not" in schema and not problems(schema["not"], value, path):
        out.append(f"{path}: excluded")
    return out


def _verdict(schema, value) -> tuple[bool | None, list[str]]:
    try:
        found = problems(schema, value)
    except (UnsupportedSchema, RecursionError, TypeError):
        return None, []
    return not found, found


def references(value) -> list[str]:
    if isinstance(value, str):
        m = REFERENCE.fullmatch(value)
        return [m[1]] if m else []
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [r for x in inner for r in references(x)]


def _finite(s: str) -> float:
    x = float(s)
    if not math.isfinite(x):
        raise ValueError(s)
    return x


def _json(s: str):
    """The value of JSON text; None for what isn't JSON, numbers beyond doubles included, or is nested deeper than ``DEEPEST``."""
    try:
        value = json.loads(s, parse_constant=_finite, parse_float=_finite)
    except (ValueError, RecursionError):
        return None
    level, depth = [value], 0
    while level and depth <= DEEPEST:
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        depth += 1
    return value if depth <= DEEPEST else None


def _name(v) -> str | None:
    """An identifier as text: a string as it is, another value as canonical JSON."""
    return None if v is None else writable(v) if isinstance(v, str) else canonical(v)


PART = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int64()), ("role", pa.string()), ("kind", pa.string()), ("id", pa.string()), ("name", pa.string()), ("body", pa.string()), ("needs", pa.list_(pa.string()))])
PART_DDL = "conv_id long, turn long, part long, role string, kind string, id string, name string, body string, needs array<string>"


def parts_of(role: str, text: str) -> list[tuple]:
    """(kind, id, name, body, needs) of a message, in order: texts, calls, results and schemas."""
    out, at = [], 0

    def say(s: str) -> None:
        if s.strip() or (not out and at == 0 and not BLOCK.search(text)):
            out.append(("text", None, None, s, []))

    for m in BLOCK.finditer(text):
        v = _json(m[2])
        new = []
        if m[1] == "tool_call" and role == "assistant" and isinstance(v, dict) and isinstance(v.get("name"), str):
            args = v.get("arguments", {})
            args = _json(args) if isinstance(args, str) and _json(args) is not None else args
            new = [("call", _name(v.get("id")), writable(v["name"]), canonical(args), sorted(set(references(args))))]
        elif m[1] == "tool_response" and role == "tool" and isinstance(v, dict):
            name = v.get("name")
            new = [("result", _name(v.get("tool_call_id", v.get("id"))), writable(name) if isinstance(name, str) else None, canonical(v.get("content")), [])]
        elif m[1] == "tools" and role == "system" and isinstance(v, list):
            tools = [t.get("function", t) for t in v if isinstance(t, dict)]
            new = [("schema", None, writable(t["name"]), canonical(t.get("parameters", {})), []) for t in tools if isinstance(t, dict) and isinstance(t.get("name"), str)]
        if new:
            if m.start() > at:
                say(text[at : m.start()])
            out += new
            at = m.end()
    say(text[at:])
    return out


def _parse(batch: pa.RecordBatch):
    rows = []
    for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        rows += [(conv, turn, i, role, *p) for i, p in enumerate(parts_of(role, text))]
    for at in range(0, len(rows), 1 << 14):
        yield rows_of(PART, dict(zip(PART.names, zip(*rows[at : at + (1 << 14)], strict=True), strict=True)))


OUT = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int64()), ("level", pa.int64()), ("role", pa.string()), ("kind", pa.string()), ("call_id", pa.string()), ("status", pa.string()), ("valid", pa.bool_()), ("json", pa.string())])
OUT_DDL = "conv_id long, turn long, part long, level long, role string, kind string, call_id string, status string, valid boolean, json string"


def _write(batch: pa.RecordBatch):
    rows = []
    for r in batch.to_pylist():
        message: dict = {"role": r["role"], "type": r["kind"]}
        valid = None
        if r["kind"] == "text":
            message["content"] = r["body"]
        elif r["kind"] == "schema":
            message |= {"name": r["name"], "parameters": _json(r["body"])}
        else:
            message |= {"id": r["id"], "name": r["name"], "status": r["status"]}
            message["arguments" if r["kind"] == "call" else "content"] = _json(r["body"])
            if r["kind"] == "call" and r["schema"] is not None:
                valid, found = _verdict(_json(r["schema"]), _json(r["body"]))
                message |= {"valid": valid} | ({"problems": found} if found else {})
            if r["kind"] == "call" and r["result"] is not None:
                message["result"] = _json(r["result"])
        rows.append((r["conv_id"], r["turn"], r["part"], r["level"], r["role"], r["kind"], r["id"], r["status"], valid, canonical(message)))
    yield rows_of(OUT, dict(zip(OUT.names, zip(*rows, strict=True), strict=True)))


def _first(d: DataFrame, keys: list[str], *cols: str) -> DataFrame:
    """The first part by (turn, part) of each key; partial aggregation keeps a hot key small."""
    first = F.min(F.struct("turn", "part", *cols)).alias("f")
    return d.groupBy(*keys).agg(first).select(*keys, *[F.col(f"f.{c}").alias(c) for c in ("turn", "part", *cols)])


WAIT_DDL = "conv_id long, id string, need string, low long"
LEVEL = pa.schema([("conv_id", pa.int64()), ("id", pa.string()), ("level", pa.int64())])
LEVEL_DDL = "conv_id long, id string, level long"


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of the calls of a range of (conversation, identifier) that hang on nothing but each other. A conversation's
    part is ordered when the next begins."""
    now, waits, low = None, {}, {}

    def solve() -> list[tuple]:
        users: dict[str, list[str]] = {}
        for i, needs in waits.items():
            for n in needs:
                users.setdefault(n, []).append(i)
        ready, out = [i for i, needs in waits.items() if not needs], []
        while ready:
            i = ready.pop()
            out.append((now, i, low[i]))
            for u in users.get(i, ()):
                low[u] = max(low[u], low[i] + 1)
                waits[u].discard(i)
                if not waits[u]:
                    ready.append(u)
        waits.clear()
        low.clear()
        return out

    for b in chain(batches, [None]):
        out = []
        for conv, i, need, least in zip(*(c.to_pylist() for c in b.columns), strict=True) if b is not None else [(None, None, None, 0)]:
            if conv != now:
                out += solve()
                now = conv
            if i is not None:
                own = waits.setdefault(i, set())
                low[i] = max(low.get(i, 0), least)
                if need is not None:
                    own.add(need)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), LEVEL.types, strict=True)], schema=LEVEL)


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, level): 0 for calls that need none, else one more than the highest they need; null on cycles.

    A row waits for each need that has no level yet, ``low`` is what the others ask for. Rounds end when one has ordered nothing.
    """
    calls = calls.where("conv_id IS NOT NULL")  # calls without a conversation are linked with nothing
    known = calls.select("conv_id", F.col("id").alias("need"))
    edges = calls.where(F.size("needs") > 0).select("conv_id", "id", F.explode("needs").alias("need")).distinct().join(known, ["conv_id", "need"], "left_semi")
    alone = calls.select("conv_id", "id", F.lit(None).cast("string").alias("need"))
    left = cut(edges.select("conv_id", "id", "need").union(alone).withColumn("low", F.lit(0).cast("long")), "waiting")
    parts = []
    while True:
        done = cut(left.repartitionByRange("conv_id", "id").sortWithinPartitions("conv_id", "id").mapInArrow(_ordered, LEVEL_DDL), "level")
        if done.isEmpty():
            drop_cut(left)
            drop_cut(done)
            break
        parts.append(done)
        still = left.join(done.select("conv_id", "id"), ["conv_id", "id"], "left_anti")
        met = still.join(done.select("conv_id", F.col("id").alias("need"), "level"), ["conv_id", "need"], "left")
        rest = met.select("conv_id", "id", F.when(F.col("level").isNull(), F.col("need")).alias("need"), F.greatest("low", F.coalesce(F.col("level") + 1, F.lit(0))).alias("low"))
        new = cut(rest, "waiting")
        drop_cut(left)
        left = new
        if left.isEmpty():
            drop_cut(left)
            break
    out = calls.sparkSession.createDataFrame([], LEVEL_DDL)
    for p in parts:
        out = out.union(p)
    return out


def format_conversations(messages: DataFrame) -> DataFrame:
    """One row per message part with its canonical JSON. ``messages``: conv_id, turn, role, text."""
    text = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("user")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    parts = cut(text.mapInArrow(per_batch(_parse), PART_DDL), "parts")
    calls = parts.where("kind = 'call'")
    named = calls.where(F.col("id").isNotNull())
    first = cut(_first(named, ["conv_id", "id"], "needs", "body"), "calls")
    results = parts.where("kind = 'result'").where(F.col("id").isNotNull())
    answer = _first(results, ["conv_id", "id"], "body").select("conv_id", "id", F.col("turn").alias("r_turn"), F.col("part").alias("r_part"), F.col("body").alias("r_body"))
    schema = _first(parts.where("kind = 'schema'"), ["conv_id", "name"], "body").select("conv_id", "name", F.col("body").alias("schema"))
    level = _levels(first)
    order = Window.partitionBy("conv_id", "id", "turn", "part").orderBy("body")
    linked = first.select("conv_id", "id", F.col("turn").alias("c_turn"), F.col("part").alias("c_part")).join(level, ["conv_id", "id"], "left").join(answer, ["conv_id", "id"], "left")
    tool = parts.where("kind IN ('call', 'result')").withColumn("n", F.row_number().over(order)).join(linked, ["conv_id", "id"], "left").join(schema, ["conv_id", "name"], "left")
    own = F.col("turn").eqNullSafe(F.col("c_turn")) & (F.col("part") == F.col("c_part")) & (F.col("n") == 1)
    reply = F.col("turn").eqNullSafe(F.col("r_turn")) & (F.col("part") == F.col("r_part")) & (F.col("n") == 1)
    call_status = F.when(F.col("c_part").isNull(), "unnamed").when(~own, "repeated").when(F.col("level").isNull(), "cyclic").when(F.col("r_part").isNull(), "open").otherwise("linked")
    result_status = F.when(F.col("c_part").isNull(), "orphan").when(~reply, "repeated").otherwise("linked")
    is_call = F.col("kind") == "call"
    tool = tool.select(
        *PART.names, F.when(F.col("c_part").isNull(), F.lit(0)).otherwise(F.col("level")).cast("long").alias("level"),
        F.when(is_call, call_status).otherwise(result_status).alias("status"), F.when(is_call, F.col("schema")).alias("schema"),
        F.when(is_call & own, F.col("r_body")).alias("result"),
    )
    none = F.lit(None).cast("string")
    rest = parts.where("kind NOT IN ('call', 'result')").select(*PART.names, F.lit(0).cast("long").alias("level"), none.alias("status"), none.alias("schema"), none.alias("result"))
    return tool.union(rest).mapInArrow(per_batch(_write), OUT_DDL)
