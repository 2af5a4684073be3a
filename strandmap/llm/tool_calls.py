"""Operator 4, chat formatting: tool calls linked to their results.

Calls (conv_id, call_id, turn, name, arguments) and results (conv_id, call_id,
turn, content) meet in a hash join on (conv_id, call_id). A call depends on the
calls of its conversation that its arguments name as {"$ref": id}, and on those
that a column ``after`` of calls lists, if there is one; its level is one above
the highest of those, and position numbers a conversation's calls by level, turn
and id. Levels are found by joins: chains of calls with one reference each are
first cut short by doubling steps, then rounds go on until no level changes. A
call is ``grounded`` if it is linked and valid, and so is every call that it
depends on, directly or through others.
Arguments are parsed, checked against the JSON schema of the tool's name and
written as canonical JSON: keys sorted, no blanks, UTF-8.

status: linked, unanswered (no result), repeated (a further call with an id, or
a further result to one), orphan (a result without a call), cycle (a call that
waits for itself). Of several results to a call the earliest counts, by turn,
then content; the others are rows with ``further=True``. Every result without a
call is a row of its own. Null ids link with nothing. Arguments that are no JSON, or a tool without a schema, are
not valid and say so in ``error``; null arguments count as {}. References to
unknown calls are ignored. Empty tables give an empty table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmap.llm.shared import shared_table

_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


#: Deeper nested arguments count as no JSON.
DEEPEST = 200


def _number(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise ValueError("no finite number")
    return value


def _constant(text: str) -> None:
    raise ValueError(f"{text} is no JSON")


def read_json(text: str) -> Any:
    """A JSON text's value; ValueError for non-finite numbers, lone surrogates and nesting beyond DEEPEST as well."""
    value = json.loads(text, parse_float=_number, parse_constant=_constant)
    level, depth = [value], 0
    while level:
        depth += 1
        if depth > DEEPEST:
            raise ValueError("nested too deep")
        level = [y for x in level if isinstance(x, dict | list) for y in (x.values() if isinstance(x, dict) else x)]
    canonical(value).encode()
    return value


def _same(a: Any, b: Any) -> bool:
    """Equal as JSON: 1 and 1.0 are, 1 and true are not."""
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    return a == b if number(a) and number(b) else canonical(a) == canonical(b)


def _is(value: Any, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(value, int | float) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, _KINDS[kind])


def references(value: Any) -> list[str]:
    """All ids that a value names as {"$ref": id}."""
    if isinstance(value, dict):
        own = [value["$ref"]] if isinstance(value.get("$ref"), str) else []
        return own + [r for v in value.values() for r in references(v)]
    return [r for v in value for r in references(v)] if isinstance(value, list) else []


def violation(value: Any, schema: dict, at: str = "$") -> str | None:
    """The first rule of the schema that a value breaks: type, enum, required, properties, additionalProperties, items, lengths, bounds, pattern. References pass."""
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return None
    kind = schema.get("type")
    kinds = [kind] if isinstance(kind, str) else kind
    if kinds is not None and not any(_is(value, k) for k in kinds):
        return f"{at}: not {' or '.join(kinds)}"
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        return f"{at}: not in enum"
    if isinstance(value, dict):
        for name in schema.get("required", []):
            if name not in value:
                return f"{at}.{name}: missing"
        for name in sorted(value):
            known = schema.get("properties", {}).get(name)
            if known is None and schema.get("additionalProperties", True) is False:
                return f"{at}.{name}: unknown"
            if known is not None and (wrong := violation(value[name], known, f"{at}.{name}")):
                return wrong
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if wrong := violation(x, schema["items"], f"{at}[{i}]"):
                return wrong
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            return f"{at}: length"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            return f"{at}: pattern"
    if isinstance(value, int | float) and not isinstance(value, bool) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return f"{at}: bounds"
    return None


def _parsed(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, text, after in zip(*(batch.column(c).to_pylist() for c in ("name", "arguments", "after")), strict=True):
                refs = [r for r in after or [] if r is not None]
                try:
                    value = read_json(text) if text is not None else {}
                except (ValueError, RecursionError):
                    out.append((None, refs, "no JSON"))
                    continue
                schema = schemas.get(name)
                out.append((canonical(value), references(value) + refs, "unknown tool" if schema is None else violation(value, schema)))
            columns = [batch.column(c) for c in ("conv_id", "call_id", "turn", "name")]
            made = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.list_(pa.string()), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns + made, ["conv_id", "call_id", "turn", "name", "arguments", "refs", "error"])

    after = F.col("after") if "after" in calls.columns else F.lit(None)
    rows = calls.select(F.col("conv_id").cast("long"), F.col("call_id").cast("string"), F.col("turn").cast("long"), F.col("name").cast("string"), F.col("arguments").cast("string"), after.cast("array<string>").alias("after"))
    return rows.mapInArrow(parse, "conv_id long, call_id string, turn long, name string, arguments string, refs array<string>, error string")


def _short(edges: DataFrame) -> DataFrame:
    """The same edges with a distance; that of a call with one reference leads past all such calls, and its ``ok`` is that of all it passes. Chains into a cycle are left out."""
    of = ["conv_id", "call_id"]
    degree = edges.groupBy(*of).count()
    many = edges.join(degree.where("`count` > 1").drop("count"), of, "left_semi").select(*of, "ref", "ok", F.lit(1).cast("long").alias("far"))
    one = shared_table(edges.join(degree.where("`count` = 1").drop("count"), of, "left_semi").select(*of, "ref", "ok", F.lit(1).cast("long").alias("far"), F.lit(True).alias("open")), "chains")
    n = -1
    while True:  # a step doubles the distance; where no more calls come to the end of their chain, the rest runs in cycles
        then = one.select("conv_id", F.col("call_id").alias("ref"), F.col("ref").alias("_ref"), F.col("ok").alias("_ok"), F.col("far").alias("_far"))
        step = one.join(then, ["conv_id", "ref"], "left")
        step = step.select(*of, F.coalesce("_ref", "ref").alias("ref"), (F.col("ok") & F.coalesce("_ok", F.lit(True))).alias("ok"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"), F.col("_ref").isNotNull().alias("open"))
        one = shared_table(step, "chains")
        still = one.where("open").count()
        if still in (0, n):
            return many.unionByName(one.where("not open").drop("open"))
        n = still


def _levels(rows: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, sound) of calls with references or that are referred to; level null in a cycle. sound: this call and all it depends on are ok."""
    first = rows.where("first")
    named = first.select("conv_id", "call_id", "ok", F.explode("refs").alias("ref")).distinct()
    edges = shared_table(named.join(first.select("conv_id", F.col("call_id").alias("ref"), F.col("ok").alias("ref_ok")), ["conv_id", "ref"]), "references")
    nodes = edges.select("conv_id", "call_id", "ok").unionByName(edges.select("conv_id", F.col("ref").alias("call_id"), F.col("ref_ok").alias("ok"))).distinct()
    known = shared_table(nodes.join(edges, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(0).cast("long").alias("level"), F.col("ok").alias("sound")), "levels")
    n, most = known.count(), nodes.count()
    short = shared_table(_short(edges), "short") if n else None
    while n < most and n:  # a round settles the calls all of whose references are settled
        open_ = short.join(known.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
        ends = open_.join(known.select("conv_id", F.col("call_id").alias("ref"), "level", "sound"), ["conv_id", "ref"], "left").groupBy("conv_id", "call_id")
        ready = ends.agg(F.max(F.col("level") + F.col("far")).alias("level"), F.bool_and(F.col("ok") & F.col("sound")).alias("sound"), F.count_if(F.col("level").isNull()).alias("waiting")).where("waiting = 0").drop("waiting")
        known = shared_table(known.unionByName(ready), "levels")
        now = known.count()
        if now == n:
            break
        n = now
    return nodes.select("conv_id", "call_id").join(known, ["conv_id", "call_id"], "left").withColumn("level", F.col("level").cast("int"))


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], further: bool = False) -> DataFrame:
    """conv_id, call_id, turn, name, level, position, status, valid, error, grounded, json (arguments, id, name, result) a call, and a row an orphaned result; with ``further``, also a row each result after a call's first. Results may have a name."""
    by = Window.partitionBy("conv_id", "call_id").orderBy("turn", "name", "arguments")
    name = F.col("name") if "name" in results.columns else F.lit(None)
    given = results.select(F.col("conv_id").cast("long"), F.col("call_id").cast("string"), F.col("turn").cast("long").alias("_turn"), name.cast("string").alias("_name"), F.col("content").cast("string").alias("_content"))
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    ranked = given.where(keyed).withColumn("_rank", F.row_number().over(Window.partitionBy("conv_id", "call_id").orderBy("_turn", "_content", "_name")))
    answers = ranked.where("_rank = 1").select("conv_id", "call_id", F.struct("_turn", "_content").alias("answer"))
    rows = _parsed(calls, schemas).withColumn("first", F.col("conv_id").isNotNull() & F.col("call_id").isNotNull() & (F.row_number().over(by) == 1)).join(answers, ["conv_id", "call_id"], "left")
    rows = shared_table(rows.withColumn("ok", F.col("first") & F.col("error").isNull() & F.col("answer").isNotNull()), "calls")
    levels = _levels(rows).withColumn("_in", F.lit(True))
    out = rows.join(levels, ["conv_id", "call_id"], "left")
    level = F.when(F.col("first"), F.when(F.col("_in"), F.col("level")).otherwise(0))
    status = F.when(~F.col("first"), "repeated").when(F.col("_in") & F.col("level").isNull(), "cycle").when(F.col("answer").isNull(), "unanswered").otherwise("linked")
    place = F.row_number().over(Window.partitionBy("conv_id", "first").orderBy(F.col("level").asc_nulls_last(), "turn", "call_id"))
    out = out.withColumns({"status": status, "level": level}).withColumn("position", F.when(F.col("first"), place))
    out = out.select("conv_id", "call_id", "turn", "name", "level", "position", "status", F.col("error").isNull().alias("valid"), "error", F.when(F.col("first") & F.col("_in"), F.coalesce("sound", F.lit(False))).otherwise(F.col("ok")).alias("grounded"), "arguments", F.when(F.col("first"), F.col("answer._content")).alias("content"))
    left = ranked.join(rows.where("first").select("conv_id", "call_id", "first"), ["conv_id", "call_id"], "left")
    left = left.where(F.col("first").isNull() | (F.lit(further) & (F.col("_rank") > 1))).drop("_rank").unionByName(given.where(~keyed).withColumn("first", F.lit(None).cast("boolean")))
    lost = left.select("conv_id", "call_id", F.col("_turn").alias("turn"), F.col("_name").alias("name"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("position"), F.when(F.col("first"), "repeated").otherwise("orphan").alias("status"), F.lit(False).alias("valid"), F.when(F.col("first"), "further result").otherwise("no call").alias("error"), F.lit(False).alias("grounded"), F.lit(None).cast("string").alias("arguments"), F.col("_content").alias("content"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = []
            for i, n, a, c in zip(*(batch.column(k).to_pylist() for k in ("call_id", "name", "arguments", "content")), strict=True):
                text.append(canonical({"arguments": None if a is None else json.loads(a), "id": i, "name": n, "result": c}))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in names] + [pa.array(text, pa.string())], [*names, "json"])

    names = ["conv_id", "call_id", "turn", "name", "level", "position", "status", "valid", "error", "grounded"]
    return out.unionByName(lost).mapInArrow(write, "conv_id long, call_id string, turn long, name string, level int, position int, status string, valid boolean, error string, grounded boolean, json string")


#: The one tool of plain conversations: the assistant itself.
REPLY = {"reply": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}}, "additionalProperties": False}}


def of_conversations(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of messages (conv_id, turn, role, text) without tool records: what a user says calls reply, and the assistant's messages up to the next one answer it. Messages of other roles, or of none, are results to no call; a result's name is its role.

    Messages stand in order of turns, those without a turn first and in no call; of one turn, what users say comes first, then roles and texts in order, so the order of rows plays no part. What several users say in one turn is one call and repeats of it.

    Whoever asks again goes on from what was said: a call comes ``after`` the call of the user's turn before it, so levels count the turns of users and a call is grounded only if each one before it was answered.
    """
    order = (F.col("turn").asc_nulls_first(), (F.col("role") == "user").desc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col("text").cast("string").alias("text"))
    asked = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("call_id", F.concat(F.lit("call-"), asked.cast("string")))
    turns = Window.partitionBy("conv_id").orderBy("turn")
    users = rows.where("role = 'user'").withColumn("_lag", F.lag("turn").over(turns))
    before = F.max(F.when(F.col("_lag") < F.col("turn"), F.col("_lag"))).over(turns.rowsBetween(Window.unboundedPreceding, 0))
    users = users.withColumn("after", F.when(F.col("call_id").isNotNull() & before.isNotNull(), F.array(F.concat(F.lit("call-"), before.cast("string")))))
    calls = users.select("conv_id", "call_id", "turn", F.lit("reply").alias("name"), F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"))).alias("arguments"), "after")
    answers = rows.where("role is null or role <> 'user'")
    return calls, answers.select("conv_id", F.when(F.col("role") == "assistant", F.col("call_id")).alias("call_id"), "turn", F.col("role").alias("name"), F.col("text").alias("content"))
