"""Tool calls in chats: link calls and results, order them, validate arguments, write canonical JSON.

Results find their calls by a join on the call's identifier.  A call may name the call it follows; its
depth in that order is found by doubling pointers, so a chain of n calls takes log n joins, and a
conversation of any length is never in one task.  Arguments are parsed, validated against their tool's
schema and written again in canonical form by a small function per row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import query, table

KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def problem(value: Any, schema: Mapping[str, Any], path: str = "$") -> str | None:
    """First violation of a schema (type, enum, minLength, maxLength, minimum, maximum, properties, required,
    additionalProperties, items), or nothing."""
    kind = schema.get("type")
    if kind and (not isinstance(value, KINDS[kind]) or isinstance(value, bool) and kind != "boolean"):
        return f"{path}: not of type {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: not one of the allowed values"
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        return f"{path}: wrong length"
    if isinstance(value, (int, float)) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return f"{path}: out of range"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", ()):
            if name not in value:
                return f"{path}.{name}: missing"
        for name in sorted(value):
            if name in known and (found := problem(value[name], known[name], f"{path}.{name}")):
                return found
            if name not in known and not schema.get("additionalProperties", True):
                return f"{path}.{name}: unknown"
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            if found := problem(item, schema["items"], f"{path}[{i}]"):
                return found
    return None


def canonical(value: Any) -> str:
    """JSON with sorted keys, no spaces, and characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def parse(text: str | None) -> Any:
    """Strict JSON: no repeated names and no NaN."""
    def unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
        if len(dict(pairs)) < len(pairs):
            raise ValueError("repeated name")
        return dict(pairs)

    def refuse(name: str) -> None:
        raise ValueError(f"{name} is not JSON")

    return json.loads(text or "", object_pairs_hook=unique, parse_constant=refuse)


def _message(kind: str, call: str | None, name: str | None, content: str | None,
             schemas: Mapping[str, Mapping[str, Any]]) -> tuple[str | None, str]:
    """What is wrong with a record, and its message."""
    if kind == "result":
        return None, canonical({"content": content, "role": "tool", "tool_call_id": call})
    wrong, arguments = None, content
    try:
        value = parse(content)
        arguments = canonical(value)
        wrong = problem(value, schemas[name]) if name in schemas else "$: unknown tool"
        if any("\ud800" <= c <= "\udfff" for c in arguments):  # half a character, which only escapes can write
            wrong, arguments = "$: lone surrogate", content
    except (ValueError, RecursionError):
        wrong = "$: not JSON"
    return wrong, canonical({"content": None, "role": "assistant", "tool_calls": [
        {"function": {"arguments": arguments, "name": name}, "id": call, "type": "function"}]})


def _spread(key: str, row: Column) -> Column:
    """A join key whose nulls are many different strings no identifier is like, so that they do not meet in one task."""
    return F.coalesce(F.col(key), F.concat(F.lit("\0null "), F.xxhash64(row).cast("string")))


def depths(calls: DataFrame) -> DataFrame:
    """Depth of every call (``id``, ``after``) in the order "after"; null for calls on or behind a cycle.

    A call after nothing, or after an id that is not there, has depth 0.  An id given twice follows the
    smallest of its predecessors.
    """
    once = calls.where("id IS NOT NULL").groupBy("id").agg(F.min("after").alias("after"))
    there = once.select(F.col("id").alias("_key"), F.lit(1).alias("_one"))
    state = stage(once.join(there, _spread("after", F.col("id")) == F.col("_key"), "left").select(
        "id", F.when(F.col("_one") == 1, F.col("after")).alias("after"),
        F.when(F.col("_one") == 1, 1).otherwise(0).cast("long").alias("depth")), "call-order")
    total, reach = state.count(), 1
    while reach <= total and not state.where("after IS NOT NULL").isEmpty():
        next_ = state.select(F.col("id").alias("after"), F.col("after").alias("_next"), F.col("depth").alias("_more"))
        moved = (state.where("after IS NOT NULL").join(next_, "after")
                 .select("id", F.col("_next").alias("after"), (F.col("depth") + F.col("_more")).alias("depth")))
        state, reach = stage(state.where("after IS NULL").union(moved), "call-order"), 2 * reach
    return state.select("id", F.when(F.col("after").isNull(), F.col("depth")).alias("depth"))


def link(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """One row per record: ``record`` (carried through), ``kind``, ``call_id``, ``place``, ``status``,
    ``wrong`` and ``message``.

    ``calls`` has ``record``, ``id``, ``after``, ``name``, ``arguments``; ``results`` has ``record``, ``id``,
    ``content``; other columns are ignored.  ``place`` orders records topologically: twice the call's depth,
    and one more for its results; null where a call is on or behind a cycle, and for results without a
    call.  ``status`` of a call is ``invalid`` if its arguments are, else ``linked`` or ``unanswered``; of a
    result ``linked`` or ``orphan``.  Null ids match nothing.  Repeated records are kept, each as a row.
    """
    order = depths(calls).withColumnRenamed("id", "_key")
    answered = results.where("id IS NOT NULL").select(F.col("id").alias("_of")).distinct().withColumn("_linked", F.lit(True))
    own = _spread("id", F.col("record"))
    asked = (calls.select("record", F.lit("call").alias("kind"), "id", "name", F.col("arguments").alias("content"))
             .join(order, own == F.col("_key"), "left").join(answered, own == F.col("_of"), "left")
             .withColumn("place", 2 * F.col("depth")))
    known = order.withColumn("_linked", F.lit(True))
    replies = (results.select("record", F.lit("result").alias("kind"), "id", F.lit(None).cast("string").alias("name"),
                              "content").join(known, own == F.col("_key"), "left").withColumn("place", 2 * F.col("depth") + 1))
    columns = ["record", "kind", "id", "name", "content", "place", "_linked"]
    rows = asked.select(*columns).union(replies.select(*columns))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [_message(*row, schemas) for row in zip(*[batch.column(i).to_pylist() for i in range(1, 5)], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(5), batch.column(6),
                 pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.string())],
                ["record", "kind", "call_id", "place", "linked", "wrong", "message"])

    kind = rows.schema["record"].dataType.simpleString()
    written = rows.mapInArrow(write, f"record {kind}, kind string, call_id string, place long, linked boolean, "
                                     "wrong string, message string")
    linked = F.coalesce("linked", F.lit(False))
    status = F.when(F.col("wrong").isNotNull(), "invalid").when(linked, "linked").otherwise(
        F.when(F.col("kind") == "call", "unanswered").otherwise("orphan"))
    return written.select("record", "kind", "call_id", "place", status.alias("status"), "wrong", "message")


SCHEMAS = {
    "answer": {"type": "object", "required": ["text", "turn"], "additionalProperties": False,
               "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}},
    "configure": {"type": "object", "required": ["style"], "additionalProperties": False,
                  "properties": {"style": {"type": "string", "maxLength": 200}}},
}


#: Values of ``turn`` that one window orders.
TURNS = 1024


def _asked_before(turns: DataFrame, asking: DataFrame) -> DataFrame:
    """``turns`` with ``_before``: the latest earlier turn of the conversation that is in ``asking``.

    Conversations are ordered in blocks of turn numbers, so that a long one is no single task.
    """
    keys = ["conv_id", "_blk"]

    def tagged(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_blk", F.floor(F.col("turn") / TURNS).cast("long"))

    places = tagged(turns.select("conv_id", "turn").where("conv_id IS NOT NULL AND turn IS NOT NULL").distinct()
                    .join(asking.withColumn("_ask", F.col("turn")), ["conv_id", "turn"], "left"))
    lasts = places.groupBy(*keys).agg(F.max("_ask").alias("_last")).select(*keys, F.max("_last").over(
        Window.partitionBy("conv_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    inside = F.max("_ask").over(Window.partitionBy(*keys).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    found = (places.withColumn("_inside", inside).join(lasts, keys)
             .select("conv_id", "turn", F.coalesce("_inside", "_carry").alias("_before")))
    return turns.join(stage(found, "calls-before"), ["conv_id", "turn"], "left")


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of conversations: a system turn configures, a user turn asks for an answer and
    follows the call before it, an assistant's turn is a result of the latest call before it.

    Turn numbers may have gaps, and a call may have any number of results.
    """
    def name(turn: Column) -> Column:
        return F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))

    record = F.struct("conv_id", "turn").alias("record")
    assistant = F.coalesce(F.col("role") == "assistant", F.lit(False))
    linked = _asked_before(turns, turns.where(~assistant).select("conv_id", "turn").distinct())
    configure = F.coalesce(F.col("role") == "system", F.lit(False))
    calls = linked.where(~assistant).select(
        record, name(F.col("turn")).alias("id"), name(F.col("_before")).alias("after"),
        F.when(configure, "configure").otherwise("answer").alias("name"),
        F.when(configure, F.to_json(F.struct(F.col("text").alias("style"))))
         .otherwise(F.to_json(F.struct("turn", "text"))).alias("arguments"))
    results = linked.where(assistant).select(record, name(F.col("_before")).alias("id"), F.col("text").alias("content"))
    return calls, results


CHAT_SQL = """
WITH t AS (SELECT *, role <> 'assistant' AS asks, sum((role <> 'assistant')::INT) OVER (
             PARTITION BY conv_id ORDER BY turn)::BIGINT AS calls, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role
           FROM conversations),
m AS (SELECT *, 'call_' || conv_id || '_' || (CASE WHEN asks THEN turn ELSE turn - 1 END) AS call_id,
             CASE WHEN asks AND role = 'system' AND length(text) > 200 THEN '$.style: wrong length'
                  WHEN asks AND role <> 'system' AND text = '' THEN '$.text: wrong length' END AS wrong FROM t)
SELECT conv_id, turn, CASE WHEN asks THEN 'call' ELSE 'result' END AS kind, call_id,
       CASE WHEN asks THEN 2 * (calls - 1) ELSE 2 * (calls - 1) + 1 END AS place,
       CASE WHEN wrong IS NOT NULL THEN 'invalid' WHEN NOT asks OR next_role = 'assistant' THEN 'linked'
            ELSE 'unanswered' END AS status, wrong,
       CASE WHEN NOT asks THEN '{"content":' || to_json(text) || ',"role":"tool","tool_call_id":"' || call_id || '"}'
            ELSE '{"content":null,"role":"assistant","tool_calls":[{"function":{"arguments":' || to_json(
              CASE WHEN role = 'system' THEN '{"style":' || to_json(text) || '}'
                   ELSE '{"text":' || to_json(text) || ',"turn":' || turn || '}' END)
              || ',"name":"' || CASE WHEN role = 'system' THEN 'configure' ELSE 'answer' END
              || '"},"id":"' || call_id || '","type":"function"}]}' END AS message
FROM m
"""


@query("op6_chat", CHAT_SQL)
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as linked tool calls and results.

    The SQL names the call of every assistant's turn after the turn before it, even where no call is there.
    """
    calls, results = conversation_calls(table(spark, sf_dir, "conversations"))
    return link(calls, results, SCHEMAS).select("record.conv_id", "record.turn", "kind", "call_id", "place", "status",
                                                "wrong", "message")
