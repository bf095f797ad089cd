"""Chat formatting with linked tool calls.

A message is plain text, or a JSON object with `tool_calls` (a list of {id, name, arguments[, depends_on]}), or of role
`tool` with `tool_call_id` and `content`. Messages are split into parts: plain messages, calls, results. Calls and
results are joined by conversation and identifier. Parts are ordered topologically: a result follows its call, and a
call follows the results of the calls it depends on, otherwise by turn. Arguments are checked against the schema of the
called tool. Each part is written as canonical JSON: sorted keys, no spaces, characters as they are, lone surrogates as
U+FFFD. A text that is no JSON (NaN, infinities, numbers beyond a double and nesting beyond the parser's depth are none)
is a plain message.

Every step is a join or a row-wise map; no conversation is gathered in one task, so its length doesn't matter.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

PARTS = "conv_id long, turn long, role string, part int, kind string, call_id string, name string, depends_on array<string>, error string, message string"


_LONE = re.compile("[\ud800-\udfff]")


def clean(text: str) -> str:
    """Without lone surrogates, which UTF-8 cannot hold: each becomes U+FFFD."""
    return _LONE.sub("\ufffd", text)


def canonical(value: object) -> str:
    return clean(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _finite(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise ValueError(f"{text} is too large")
    return value


def _refuse(text: str) -> None:
    raise ValueError(f"{text} is not JSON")


def parsed(text: str) -> object:
    """The value of a JSON text; ValueError for anything else, NaN, infinities and too deep nesting among it."""
    try:
        return json.loads(text, parse_float=_finite, parse_constant=_refuse)
    except RecursionError:
        raise ValueError("nested too deeply") from None


def _name(value: object) -> str | None:
    """An identifier as text: strings as they are, other values as canonical JSON."""
    return None if value is None else clean(value) if isinstance(value, str) else canonical(value)


_KINDS = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def _is(value: object, kind: str) -> bool:
    if kind in ("integer", "number"):
        return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and (kind == "number" or value.is_integer()))
    return isinstance(value, _KINDS.get(kind, object))


def schema_error(value: object, schema: dict, at: str = "$") -> str | None:
    """The first breach of a schema (type, required, properties, additionalProperties, items, enum), or None."""
    kind = schema.get("type")
    if kind is not None and not any(_is(value, k) for k in (kind if isinstance(kind, list) else [kind])):
        return f"{at}: not of type {kind if isinstance(kind, str) else canonical(kind)}"
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        return f"{at}: not one of the allowed values"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for key in sorted(schema.get("required", ())):
            if key not in value:
                return f"{at}.{key}: missing"
        for key in sorted(value):
            if key in known:
                if error := schema_error(value[key], known[key], f"{at}.{key}"):
                    return error
            elif schema.get("additionalProperties", True) is False:
                return f"{at}.{key}: unknown"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if error := schema_error(x, schema["items"], f"{at}[{i}]"):
                return error
    return None


def _call(role: str | None, call: object, schemas: dict[str, dict]) -> tuple:
    call = call if isinstance(call, dict) else {}
    name, args, error = call.get("name"), call.get("arguments", {}), None
    if isinstance(args, str):
        try:
            args = parsed(args)
        except ValueError:
            error = "$: arguments are not JSON"
    if error is None:
        error = schema_error(args, schemas[name]) if isinstance(name, str) and name in schemas else f"unknown tool {'None' if name is None else _name(name)}"
    ident, needs = _name(call.get("id")), call.get("depends_on")
    needs = sorted({_name(x) for x in needs if x is not None}) if isinstance(needs, list) else []
    return ("call", ident, _name(name), needs, clean(error) if error else None, canonical({"role": role, "tool_call": {"arguments": args, "id": ident, "name": name}}))


def message_parts(role: str | None, text: str | None, schemas: dict[str, dict]) -> list[tuple]:
    """(kind, call_id, name, depends_on, error, message) of each part of a message."""
    plain = [("message", None, None, [], None, canonical({"content": text, "role": role}))]
    if not text or text.lstrip()[:1] != "{":
        return plain
    try:
        value = parsed(text)
        if isinstance(value.get("tool_calls"), list):
            head = [] if value.get("content") is None else [("message", None, None, [], None, canonical({"content": value["content"], "role": role}))]
            return head + [_call(role, call, schemas) for call in value["tool_calls"]]
        if role == "tool" and value.get("tool_call_id") is not None:
            ident = _name(value["tool_call_id"])
            return [("result", ident, None, [], None, canonical({"content": value.get("content"), "role": role, "tool_call_id": ident}))]
    except (ValueError, RecursionError):  # no JSON, or nested too deeply to be checked or written again
        pass
    return plain


def _split(schemas: dict[str, dict]):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string())
    names = [x.strip().split(" ")[0] for x in PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]
            for conv, turn, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for i, x in enumerate(message_parts(role, text, schemas)):
                    for to, v in zip(out, (conv, turn, role, i, *x), strict=True):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=names)

    return run


def chat_format(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """(conv_id, turn, part, role, kind, call_id, level, place, linked, error, message) for every part of every message.

    Order parts by (conv_id, place, level, turn, part, message). place is the turn at which a part may stand, not before
    what it depends on; level counts the steps of its dependencies. linked says of calls and results whether the other
    side is there (null for messages; a call answered twice is linked to both). error tells what is wrong with a call:
    its arguments, an identifier used twice, or a dependency that is unknown or circular. Null texts are content null;
    a null conv_id or turn stays null and links with nothing; rows given twice are two messages.
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parts = cut(rows.mapInArrow(_split(schemas or {}), PARTS))
    tied = F.col("kind").isin("call", "result") & F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls = parts.where(tied & (F.col("kind") == "call")).groupBy("conv_id", "call_id").agg(F.count("*").alias("n_calls"), F.min("turn").alias("call_turn"))
    results = parts.where(tied & (F.col("kind") == "result")).groupBy("conv_id", "call_id").agg(F.count("*").alias("n_results"), F.max("turn").alias("result_turn"))
    needs = parts.where(tied & (F.col("kind") == "call")).select("conv_id", "call_id", F.explode("depends_on").alias("need")).distinct()
    base = calls.join(results.hint("shuffle_hash"), ["conv_id", "call_id"], "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    # calls without open dependencies first, then those that only depend on them, and so on
    waiting = needs.join(calls.select("conv_id", F.col("call_id").alias("need"), F.lit(True).alias("known")), ["conv_id", "need"], "left")
    unknown = waiting.where("known is null").select("conv_id", "call_id").distinct().withColumn("unknown_need", F.lit(True))
    waiting = cut(waiting.where("known").select("conv_id", "call_id", "need"))
    done = cut(base.join(waiting.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(0).alias("level"), F.col("call_turn").alias("place"), F.greatest("call_turn", "result_turn").alias("answered")))
    while not waiting.isEmpty():  # a round for each step of the longest chain of dependencies
        state = waiting.join(done.select("conv_id", F.col("call_id").alias("need"), "level", "answered"), ["conv_id", "need"], "left")
        ready = state.groupBy("conv_id", "call_id").agg(F.max("level").alias("level"), F.max("answered").alias("after"), F.count_if(F.col("level").isNull()).alias("open")).where("open = 0")
        ready = cut(ready.join(base, ["conv_id", "call_id"]).select("conv_id", "call_id", (F.col("level") + 1).alias("level"), F.greatest("call_turn", "after").alias("place"), F.greatest("call_turn", "after", "result_turn").alias("answered")))
        if ready.isEmpty():
            break
        done = cut(done.unionByName(ready))
        waiting = cut(waiting.join(ready.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti"))
    circular = waiting.select("conv_id", "call_id").distinct().withColumn("circular", F.lit(True))
    state = base.join(done, ["conv_id", "call_id"], "left").join(unknown, ["conv_id", "call_id"], "left").join(circular, ["conv_id", "call_id"], "left")
    loose = parts.where(~tied | tied.isNull())
    bound = parts.where(tied).join(state.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    error = F.when(F.col("kind") == "call", F.coalesce("error", F.when(F.col("n_calls") > 1, "identifier used twice"), F.when(F.col("circular"), "circular dependency"), F.when(F.col("unknown_need"), "unknown dependency")))
    is_call = F.col("kind") == "call"
    bound = bound.select(
        "conv_id", "turn", "part", "role", "kind", "call_id",
        F.coalesce(2 * F.col("level") + F.when(is_call, 1).otherwise(2), F.lit(0)).cast("int").alias("level"),
        F.when(is_call, F.coalesce("place", "turn")).otherwise(F.greatest("turn", F.coalesce("place", F.col("turn")))).alias("place"),
        F.when(is_call, F.col("n_results") > 0).otherwise(F.col("n_calls").isNotNull()).alias("linked"), error.alias("error"), "message",
    )
    loose = loose.select("conv_id", "turn", "part", "role", "kind", "call_id", F.lit(0).alias("level"), F.col("turn").alias("place"), F.when(F.col("kind") != "message", F.lit(False)).alias("linked"), "error", "message")
    return loose.unionByName(bound)
