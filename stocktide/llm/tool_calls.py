"""Chat formatting: tool calls linked to their results, ordered, checked and written as canonical JSON.

Method. Calls and results are read from the messages: an assistant message whose text is a JSON object with ``tool_calls`` (id, name,
arguments, and ``after``: ids it depends on), and tool messages whose text is one with ``tool_call_id`` and ``content``. Copies of one
id in a conversation are folded to the earliest, then calls and results meet in one hash join by (conversation, id). Calls are put
in topological order: a call whose dependencies all stand in earlier turns is in order by its turn (layer 0). Only in conversations where
some call points forward are layers found by rounds: in each, the calls whose dependencies are settled get the next layer; what
no round can settle is a cycle. Sorting by (layer, turn, call_id) is a topological order. Arguments are validated against the
tool's schema, and each linked pair is serialised with sorted keys, no spaces and numbers in one form.

A conversation is never gathered in one task: all steps are joins and sums by (conversation, id), and validation is row by row.

Defined results: null or broken JSON holds no call; a call without id cannot be linked (``no_id``, one row per call); a call without
result is ``unanswered``, a result without call ``orphan``; a dependency on an unknown id counts as settled; ``copies`` tells how many
calls (or orphan results) of the id were folded; an unknown tool or arguments that are no object are invalid; an empty table gives
no row; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocktide.llm.text import named_columns
from stocktide.session import stage_table

CALLS = "tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>, tool_call_id string, content string"
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}
LONE = re.compile("[\ud800-\udfff]")


def faults(value, schema: dict, at: str = "$") -> list[str]:
    """What of a JSON value breaks a schema of type, enum, properties, required, additionalProperties, items and bounds."""
    kind, out = schema.get("type"), []
    if kind and (not isinstance(value, TYPES[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return [f"{at}: not {kind}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: length")
    elif isinstance(value, (int, float)):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{at}: range")
    elif isinstance(value, list):
        for k, item in enumerate(value):
            out += faults(item, schema.get("items", {}), f"{at}[{k}]")
    elif isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in own:
                out += faults(value[k], own[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    return out


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, and whole floats as integers."""
    def plain(x):
        if isinstance(x, float) and x.is_integer():
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x
    return _encodable(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _encodable(text: str) -> str:
    """The text with lone surrogates, which UTF-8 cannot hold, as JSON escapes."""
    return LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _parsed(text: str | None):
    """The JSON value, or None where the text is no JSON that ``canonical`` can write (broken, not finite or nested too deep)."""
    try:
        value = json.loads(text) if text is not None else None
        canonical(value)
        return value
    except (ValueError, RecursionError):
        return None


def extract(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (conv_id, turn, call_id, name, arguments, after) and results (conv_id, turn, call_id, content)."""
    rows = messages.select("conv_id", "turn", "role", F.from_json("text", CALLS).alias("m"))
    calls = rows.filter("role = 'assistant'").select("conv_id", "turn", F.explode("m.tool_calls").alias("c")).filter("c is not null").select(
        "conv_id", "turn", F.col("c.id").alias("call_id"), "c.name", "c.arguments", "c.after")
    results = rows.filter("role = 'tool' and m is not null").select("conv_id", "turn", F.col("m.tool_call_id").alias("call_id"), "m.content")
    return calls, results


def _earliest(rows: DataFrame) -> DataFrame:
    """One row per (conv_id, call_id): the earliest, then the one that hashes lowest; rows without id stay as they are."""
    rest = [c for c in rows.columns if c not in ("conv_id", "call_id")]
    named = rows.filter("call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min_by(F.struct(*rest), F.struct("turn", F.xxhash64(*rest))).alias("r"), F.count(F.lit(1)).alias("copies"))
    return named.select("conv_id", "call_id", "r.*", "copies")


def layers(calls: DataFrame) -> DataFrame:
    """Rows (conv_id, call_id, layer) of the calls of all conversations in which some call depends on a later or equal turn.

    ``layer`` is null on a cycle. The rounds are as many as the longest chain in those conversations.
    """
    deps = calls.select("conv_id", "call_id", "turn", F.explode("after").alias("on"))
    known = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("turn").alias("t"))
    deps = deps.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("on") == F.col("i"))).select("conv_id", "call_id", "on", "turn", "t")
    tangled = stage_table(deps.filter("t >= turn or t is null or turn is null").select("conv_id").distinct(), "tangled")
    if tangled.isEmpty():
        return calls.select("conv_id", "call_id", F.lit(0).alias("layer")).limit(0)
    of = tangled.withColumnRenamed("conv_id", "c")
    waiting = stage_table(calls.select("conv_id", "call_id").join(of, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi"), "waiting")
    edges = stage_table(deps.select("conv_id", "call_id", "on").distinct().join(of, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi"), "edges")
    done, layer = None, 0
    while True:
        held = edges.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"))
        same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("i"))
        ready = stage_table(waiting.join(held, same, "left_anti").withColumn("layer", F.lit(layer)), "ready")
        if ready.isEmpty():
            break
        done = ready if done is None else done.union(ready)
        now = ready.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"))
        waiting = stage_table(waiting.join(now, same, "left_anti"), "waiting")
        edges = stage_table(edges.join(now, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("on") == F.col("i")), "left_anti"), "edges")
        layer += 1
    left = waiting.withColumn("layer", F.lit(None).cast("int"))
    return left if done is None else done.union(left)


def link_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Rows (conv_id, layer, turn, call_id, name, status, valid, faults, copies, json).

    One per call id, per call without id (``no_id``) and per result that no call asked for (``orphan``; without id: each by itself).
    """
    named_columns(messages, "conv_id", "turn", "role", "text")
    calls, results = extract(messages)
    one = stage_table(_earliest(calls), "calls")
    answers = _earliest(results).select(*[F.col(c).alias(f"r_{c}") for c in ("conv_id", "call_id", "turn", "content", "copies")])
    same = F.col("conv_id").eqNullSafe(F.col("r_conv_id")) & (F.col("call_id") == F.col("r_call_id"))
    met = one.join(answers, same, "full")
    status = F.when(F.col("call_id").isNull(), "orphan").when(F.col("r_call_id").isNull(), "unanswered").otherwise("linked")
    met = met.select(F.when(F.col("call_id").isNull(), F.col("r_conv_id")).otherwise(F.col("conv_id")).alias("conv_id"),
                     F.coalesce("call_id", "r_call_id").alias("call_id"), F.coalesce("turn", "r_turn").alias("turn"), "name", "arguments", F.col("r_content").alias("content"),
                     F.coalesce("copies", "r_copies").alias("copies"), status.alias("status"))
    bare = calls.filter("call_id is null").select("conv_id", "call_id", "turn", "name", "arguments", F.lit(None).cast("string").alias("content"),
                                                  F.lit(1).cast("long").alias("copies"), F.lit("no_id").alias("status"))
    none = F.lit(None).cast("string")
    bare = bare.unionByName(results.filter("call_id is null").select("conv_id", "call_id", "turn", none.alias("name"), none.alias("arguments"), "content",
                                                                     F.lit(1).cast("long").alias("copies"), F.lit("orphan").alias("status")))
    placed = layers(one).select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), "layer", F.lit(True).alias("placed"))
    met = met.unionByName(bare).join(placed, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("i")), "left")
    cyclic = F.coalesce("placed", F.lit(False)) & F.col("layer").isNull() & (F.col("status") != "orphan")
    met = met.withColumn("status", F.when(cyclic, "cycle").otherwise(F.col("status"))).withColumn("layer", F.when(cyclic, None).otherwise(F.coalesce("layer", F.lit(0))))

    @F.pandas_udf("valid boolean, faults string, json string")
    def written(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for ids, names, arguments, contents, kinds in batches:
            rows = []
            for call_id, name, text, content, kind in zip(ids, names, arguments, contents, kinds, strict=True):
                value, result, found = _parsed(text), _parsed(content), []
                if kind != "orphan":
                    found = faults(value, {"type": "object"} | schemas[name]) if name in schemas else ["$: unknown tool"]
                body = {"id": call_id, "name": name, "arguments": text if value is None else value, "result": content if result is None else result}
                rows.append((kind != "orphan" and not found, _encodable("; ".join(found)), canonical(body)))
            yield pd.DataFrame(rows, columns=["valid", "faults", "json"])

    out = met.withColumn("w", written("call_id", "name", "arguments", "content", "status"))
    return out.select("conv_id", "layer", "turn", "call_id", "name", "status", "w.valid", "w.faults", "copies", "w.json")


#: Schemas of the calls that ``as_tool_messages`` makes.
SCHEMAS = {"lookup": {"properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 40}},
                      "required": ["query", "limit"], "additionalProperties": False},
           "recall": {"properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"]}}


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as tool traffic: a user turn becomes a call that follows the call before it, an assistant turn the result of the turn before."""
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]", -1), ""))
    args = F.struct(F.coalesce("text", F.lit("")).alias("query"), words.alias("limit"))
    call = F.struct(F.concat(F.lit("c"), F.col("turn")).alias("id"), F.when(F.pmod("turn", F.lit(4)) == 0, "lookup").otherwise("recall").alias("name"),
                    args.alias("arguments"), F.array(F.concat(F.lit("c"), F.col("turn") - 2)).alias("after"))
    answer = F.struct(F.concat(F.lit("c"), F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content"))
    return conversations.filter("role in ('user', 'assistant')").select(
        "conv_id", "turn", F.when(F.col("role") == "user", "assistant").otherwise("tool").alias("role"),
        F.when(F.col("role") == "user", F.to_json(F.struct(F.array(call).alias("tool_calls")))).otherwise(F.to_json(answer)).alias("text"))
