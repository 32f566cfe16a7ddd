"""Chat formatting: tool calls are linked to their results, ordered, checked against schemas and written as canonical JSON.

An assistant turn whose text is a JSON object with a list `tool_calls` makes calls: objects with `id`, `name` and
`arguments` (an object, or JSON text of one), or the last two within `function`. A tool turn whose text is an
object with `tool_call_id` is a result. A call that names another's result, `{"$result": id}` anywhere in its
arguments, comes after it. Any other turn is a message.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larkspur.plans.session import written

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces, and every character but control characters as itself."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def valid(value: object, schema: Mapping) -> bool:
    """Whether value meets schema: type, enum, required, properties, additionalProperties, items, minimum and maximum."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return False
    if "enum" in schema and not any(value == e and isinstance(value, bool) == isinstance(e, bool) for e in schema["enum"]):
        return False
    if _is(value, "number") and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return False
    if isinstance(value, dict):
        own = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", ())) or schema.get("additionalProperties") is False and any(k not in own for k in value):
            return False
        return all(valid(value[k], s) for k, s in own.items() if k in value)
    return not isinstance(value, list) or "items" not in schema or all(valid(v, schema["items"]) for v in value)


def _is(value: object, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or float(value).is_integer())
    return isinstance(value, _TYPES.get(kind, ()))


def _parsed(text: str | None) -> dict:
    if not text or text.lstrip()[:1] != "{":
        return {}
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return {}
    return found if isinstance(found, dict) else {}


def _refs(value: object) -> set[str]:
    todo, out = [value], set()
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if isinstance(x.get("$result"), str):
                out.add(x["$result"])
            todo += x.values()
        elif isinstance(x, list):
            todo += x
    return out


_PART = pa.schema([("idx", pa.int32()), ("kind", pa.string()), ("call_id", pa.string()), ("name", pa.string()), ("ok", pa.bool_()), ("refs", pa.list_(pa.string())), ("body", pa.string())])
_PART_DDL = "idx int, kind string, call_id string, name string, ok boolean, refs array<string>, body string"


def _parts(role: str | None, text: str | None, schemas: Mapping[str, Mapping]) -> Iterator[tuple]:
    found = _parsed(text) if role in ("assistant", "tool") else {}
    if role == "assistant" and isinstance(calls := found.get("tool_calls"), list):
        rest = {k: v for k, v in found.items() if k != "tool_calls"}
        yield 0, "message", None, None, None, [], canonical({"role": role, **rest})
        for i, call in enumerate(calls, 1):
            call = call if isinstance(call, dict) else {}
            inner = call["function"] if isinstance(call.get("function"), dict) else call
            name, arguments = inner.get("name"), inner.get("arguments")
            if isinstance(arguments, str):
                arguments = _parsed(arguments) or (arguments if arguments.strip() != "{}" else {})
            key, name = (x if isinstance(x, str) else None for x in (call.get("id"), name))
            ok = valid(arguments, schemas[name]) if name in schemas else None
            yield i, "call", key, name, ok, sorted(_refs(arguments)), canonical({"id": key, "name": name, "arguments": arguments})
    elif role == "tool" and isinstance(key := found.get("tool_call_id"), str):
        yield 0, "result", key, None, None, [], canonical({"role": role, **found})
    else:
        yield 0, "message", None, None, None, [], canonical({"role": role, "content": text})


def format_chats(turns: DataFrame, schemas: Mapping[str, Mapping] | None = None) -> DataFrame:
    """A row for each message, call and result of turns (conv_id, turn, role, text), in the order they are to be written.

    Returns conv_id, turn, idx (of the part within its turn), kind, call_id, name, status, pos and json. Sorted by
    pos = (turn, idx, step, own_turn, own_idx) within conv_id, a result comes after its call and a call after the results
    it names. status of a call: `ok`, `invalid` (arguments don't meet the schema), `unknown` (no id, name or schema),
    `unanswered`, or `cycle` (it waits for itself); of a result: `ok` or `orphan` (no call has its id). Of calls of
    one conversation with the same id the first counts, the others are `duplicate`, and so are results; equal
    turns all stay. A null text is the content null; a null conv_id is a conversation. Ids are linked by a hash join,
    so no conversation has to fit a task.
    """
    rules = dict(schemas or {})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rows = [], []
            for i, (role, text) in enumerate(zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)):
                for part in _parts(role, text, rules):
                    own.append(i)
                    rows.append(part)
            at, cols = pa.array(own, pa.int64()), [list(c) for c in zip(*rows, strict=True)] or [[] for _ in _PART]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(at), batch.column("turn").take(at), *(pa.array(c, f.type) for c, f in zip(cols, _PART, strict=True))], names=["conv_id", "turn", *_PART.names])

    turns = turns.select("conv_id", "turn", "role", "text")
    kinds = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    parts = written(turns.mapInArrow(split, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, {_PART_DDL}"))
    order = F.struct(F.col("turn").alias("turn"), F.col("idx").alias("idx"), F.lit(0).alias("step"), F.col("turn").alias("own_turn"), F.col("idx").alias("own_idx"))
    keys = [F.coalesce(F.to_json(F.struct("conv_id")), F.lit("")).alias("conv"), "call_id"]
    ids = parts.where("call_id is not null").select(*keys, "kind", order.alias("own"), "refs", "body")
    of = ids.groupBy("conv", "call_id").agg(F.min(F.when(F.col("kind") == "call", F.struct("own", "body"))).alias("call"), F.min(F.when(F.col("kind") == "result", F.struct("own", "body"))).alias("result"))
    after = lambda own, first: F.when(own > first, own).otherwise(F.struct(first["turn"].alias("turn"), first["idx"].alias("idx"), (first["step"] + 1).alias("step"), own["turn"].alias("own_turn"), own["idx"].alias("own_idx")))
    links = written(of.select("conv", "call_id", F.col("call.own").alias("call"), F.col("call.body").alias("call_body"), F.col("result.own").alias("result"), F.col("result.body").alias("result_body")))
    # calls that wait for results: their order comes round by round, as far as the longest chain
    waits = written(ids.where("kind = 'call'").join(links.select("conv", "call_id", "call"), ["conv", "call_id"]).where("own = call").select("conv", "call_id", F.explode("refs").alias("ref")).distinct().join(links.where("result is not null and call is not null").select("conv", F.col("call_id").alias("ref")), ["conv", "ref"]))
    placed = links.where("call is not null").select("conv", "call_id", "call", "result")
    late = waits.select("conv", "call_id").distinct()
    done = written(placed.join(late, ["conv", "call_id"], "left_anti").select("conv", "call_id", "call", F.when(F.col("result").isNotNull(), after(F.col("result"), F.col("call"))).alias("result")))
    left = late.count()
    while left:
        ready = waits.join(done.select("conv", F.col("call_id").alias("ref"), F.col("result").alias("r")), ["conv", "ref"], "left")
        ready = ready.groupBy("conv", "call_id").agg(F.max("r").alias("r"), F.max(F.col("r").isNull()).alias("open")).where("not open").join(done, ["conv", "call_id"], "left_anti")
        new = written(ready.join(placed, ["conv", "call_id"]).select("conv", "call_id", after(F.col("call"), F.col("r")).alias("call"), "result").withColumn("result", F.when(F.col("result").isNotNull(), after(F.col("result"), F.col("call")))))
        n = new.count()
        if not n:
            break
        done, left = written(done.unionByName(new)), left - n

    where = done.select("conv", "call_id", F.col("call").alias("call_at"), F.col("result").alias("result_at"))
    full = parts.withColumn("conv", F.coalesce(F.to_json(F.struct("conv_id")), F.lit(""))).withColumn("own", order).join(links, ["conv", "call_id"], "left").join(where, ["conv", "call_id"], "left")
    first = (F.col("own").eqNullSafe(F.col("call")) & F.col("body").eqNullSafe(F.col("call_body")), F.col("own").eqNullSafe(F.col("result")) & F.col("body").eqNullSafe(F.col("result_body")))
    call = F.when(F.col("call_id").isNull() | F.col("name").isNull(), "unknown").when(~first[0], "duplicate").when(F.col("call_at").isNull(), "cycle").when(F.col("ok").isNull(), "unknown").when(~F.col("ok"), "invalid").when(F.col("result").isNull(), "unanswered").otherwise("ok")
    result = F.when(F.col("call").isNull(), "orphan").when(~first[1], "duplicate").otherwise("ok")
    pos = F.when((F.col("kind") == "call") & first[0], F.coalesce("call_at", "own")).when((F.col("kind") == "result") & F.col("call").isNotNull(), F.when(first[1], F.coalesce("result_at", "own")).otherwise(after(F.col("own"), F.coalesce("call_at", "call")))).otherwise(F.col("own"))
    return full.select("conv_id", "turn", "idx", "kind", "call_id", "name", F.when(F.col("kind") == "call", call).when(F.col("kind") == "result", result).otherwise("ok").alias("status"), pos.alias("pos"), F.col("body").alias("json"))
