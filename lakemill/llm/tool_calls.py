"""Chat messages with tool calls: linking, order, validation and canonical JSON.

A message is a row (conv_id, turn, role, text). Its events:

* text that is a JSON object with ``tool_calls`` (a list of id, name, arguments): a call each;
* role ``tool`` and a JSON object with ``tool_call_id`` and ``content``: a result;
* with ``implicit``: a user turn is a call of ``reply`` whose id is made of conv_id and turn, and an assistant turn is
  a result for the turn before it, so that plain conversations are linked by the same join;
* anything else: a plain event.

Calls and results are joined by (conv_id, call_id) in a hash join. Of several with one id the first by (turn, seq)
counts, the others get the status ``duplicate``. Arguments that hold {"$ref": id} wait for that call's result. The
calls of a conversation that has references are put in topological order in one task, up to ``MOST_CALLS`` of them; a
larger conversation's are peeled off round by round with joins. Positions are ranks inside a conversation, counted in
pieces of turns so that one long conversation is spread.

Defined cases: a null text is empty, and a null or empty prompt is an invalid call; a null conv_id or turn makes a
plain event, and rows with a null conv_id are a conversation of their own; a call without result is ``unanswered``, a
result without call ``orphan``; references to unknown ids give ``unknown reference``, circles of references ``cycle``
(also for what waits for a circle), both keep their turn's place; broken JSON, JSON with NaN or infinities, and JSON
nested deeper than ``DEPTH`` is plain text, or as an argument text the error "arguments are not JSON"; a lone
surrogate stays an escape in canonical JSON, and in ids and names becomes the characters of that escape; repeated rows
are ``duplicate`` after the first. Other columns are left out.

Schemas: the keywords of ``VALIDATING`` are checked, annotations are passed over, and any other keyword raises
``ValueError`` before the job starts, so that no call counts as valid unchecked.
"""

from __future__ import annotations

import json
import re
from collections import deque
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakemill.llm.blocks import checkpointed
from lakemill.llm.ranks import ranked

REPLY = {"reply": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}}, "additionalProperties": False}}
TURNS_PER_PIECE = 64
DEPTH, MOST_CALLS = 200, 100_000
#: JSON Schema keywords that are checked, and those that only describe.
VALIDATING = {
    "type", "enum", "const", "required", "properties", "additionalProperties", "minProperties", "maxProperties", "items", "minItems", "maxItems",
    "uniqueItems", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf",
    "anyOf", "oneOf", "allOf", "not", "$ref",
}
ANNOTATIONS = {"title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly", "$schema", "$id", "$comment", "$defs", "definitions"}
EVENTS = "conv_id bigint, turn bigint, seq int, role string, kind string, call_id string, name string, body string, refs array<string>, error string"
_KINDS = {
    "object": dict,
    "array": list,
    "string": str,
    "boolean": bool,
    "null": type(None),
}
_TYPES = {*_KINDS, "integer", "number"}


_SURROGATE = re.compile("[\ud800-\udfff]")


def _whole(text: str) -> str:
    """Text that UTF-8 can hold: lone surrogates as escapes."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def canonical(value) -> str:
    """JSON with sorted keys, no blanks and characters as they are (but lone surrogates)."""
    return _whole(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _refuse(text: str):
    raise ValueError(f"{text} is not JSON")


def _finite(text: str) -> float:
    value = float(text)
    return value if abs(value) < float("inf") else _refuse(text)


def parsed(text: str):
    """The JSON value of a text; ``ValueError`` if there is none, or one nested deeper than ``DEPTH``."""
    try:
        value = json.loads(text, parse_constant=_refuse, parse_float=_finite)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    todo = [(value, 0)]
    while todo:
        x, depth = todo.pop()
        if depth > DEPTH:
            raise ValueError("nested too deeply")
        todo += [(v, depth + 1) for v in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ())]
    return value


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _KINDS[kind])


def _same(a, b) -> bool:
    """Equality of JSON values: 1 is 1.0 and not true."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    return a == b


def _parts(schema) -> list:
    """The schemas that stand inside a schema."""
    inner = [schema[k] for k in ("items", "additionalProperties", "not") if k in schema]
    for k in ("anyOf", "oneOf", "allOf"):
        inner += schema.get(k, [])
    for k in ("properties", "$defs", "definitions"):
        inner += schema.get(k, {}).values()
    return inner


def check_schema(schema) -> None:
    """Raises ``ValueError`` if a schema holds a keyword or a type that ``violations`` does not know."""
    todo = [schema]
    while todo:
        one = todo.pop()
        if isinstance(one, bool):
            continue
        if strange := set(one) - VALIDATING - ANNOTATIONS:
            raise ValueError(f"schema keywords that are not checked: {sorted(strange)}")
        kinds = one.get("type", [])
        if strange := {kinds} - _TYPES if isinstance(kinds, str) else set(kinds) - _TYPES:
            raise ValueError(f"unknown types: {sorted(strange)}")
        if not str(one.get("$ref", "#")).startswith("#"):
            raise ValueError("only references inside the schema are followed")
        todo += _parts(one)


def _target(root, pointer: str):
    for part in pointer.lstrip("#").split("/")[1:]:
        root = root[part.replace("~1", "/").replace("~0", "~")]
    return root


def violations(value, schema, at: str = "$", root=None, hops: int = 0) -> list[str]:
    """What of a JSON schema fails. A value that is a reference to a result, {"$ref": id}, fits any schema."""
    root = schema if root is None else root
    if schema is True or isinstance(value, dict) and set(value) == {"$ref"}:
        return []
    if schema is False:
        return [f"{at}: not allowed"]
    if hops > DEPTH:
        raise ValueError("the schema refers to itself without end")
    inside = lambda v, s, p: violations(v, s, p, root, 0)
    again = lambda s: violations(value, s, at, root, hops + 1)
    if "$ref" in schema:
        return again(_target(root, schema["$ref"])) + (again({k: v for k, v in schema.items() if k != "$ref"}) if len(schema) > 1 else [])
    kinds = schema.get("type")
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not {kinds}"]
    out = []
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        out.append(f"{at}: not one of the values")
    if "const" in schema and not _same(value, schema["const"]):
        out.append(f"{at}: not the value")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                out += inside(v, known[k], f"{at}.{k}")
            elif "additionalProperties" in schema:
                out += inside(v, schema["additionalProperties"], f"{at}.{k}")
    if isinstance(value, list):
        for i, v in enumerate(value if "items" in schema else []):
            out += inside(v, schema["items"], f"{at}[{i}]")
        if schema.get("uniqueItems") and any(_same(v, w) for i, v in enumerate(value) for w in value[:i]):
            out.append(f"{at}: repeated items")
    for kind, least, most in ((str, "minLength", "maxLength"), (list, "minItems", "maxItems"), (dict, "minProperties", "maxProperties")):
        if isinstance(value, kind) and not schema.get(least, 0) <= len(value) <= schema.get(most, len(value)):
            out.append(f"{at}: length")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at}: not of the pattern")
    if _is(value, "number"):
        if not schema.get("minimum", value) <= value <= schema.get("maximum", value):
            out.append(f"{at}: out of bounds")
        if value <= schema.get("exclusiveMinimum", value - 1) or value >= schema.get("exclusiveMaximum", value + 1):
            out.append(f"{at}: out of bounds")
        if "multipleOf" in schema and Decimal(str(value)) % Decimal(str(schema["multipleOf"])):
            out.append(f"{at}: not a multiple")
    fits = lambda k: sum(not again(s) for s in schema[k])
    if "allOf" in schema:
        out += [x for s in schema["allOf"] for x in again(s)]
    if "anyOf" in schema and not fits("anyOf") or "oneOf" in schema and fits("oneOf") != 1:
        out.append(f"{at}: fits none, or too many, of the schemas")
    if "not" in schema and not again(schema["not"]):
        out.append(f"{at}: fits what it must not")
    return out


def references(value) -> list[str]:
    """The ids of {"$ref": id} anywhere in a value that ``parsed`` allows."""
    out, todo = [], [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict) and set(x) == {"$ref"}:
            out.append(_whole(str(x["$ref"])))
        else:
            todo += x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
    return out


def _call(call_id, name, arguments, schemas: dict) -> tuple:
    if isinstance(arguments, str):
        try:
            arguments = parsed(arguments)
        except ValueError:
            return "call", call_id, name, canonical(arguments), [], "arguments are not JSON"
    wrong = ["unknown tool"] if name not in schemas else violations(arguments, schemas[name])
    return "call", call_id, name, canonical(arguments), sorted(set(references(arguments))), "; ".join(wrong) or None


def events_of(conv, turn, role, text, schemas: dict, implicit: bool) -> list[tuple]:
    """(kind, call_id, name, body as canonical JSON, references, error) for each event of a message."""
    text = text or ""
    plain = [("plain", None, None, canonical(text), [], None)]
    if conv is None or turn is None:
        return plain
    if text.lstrip()[:1] == "{":
        try:
            value = parsed(text)
        except ValueError:
            value = None
        if isinstance(value, dict):
            calls = value.get("tool_calls")
            if isinstance(calls, list) and calls and all(isinstance(c, dict) and "id" in c for c in calls):
                return [_call(_whole(str(c["id"])), _whole(str(c.get("name"))), c.get("arguments", {}), schemas) for c in calls]
            if role == "tool" and "tool_call_id" in value:
                return [("result", _whole(str(value["tool_call_id"])), None, canonical(value.get("content")), [], None)]
    if implicit and role == "user":
        return [_call(f"{conv}:{turn}", "reply", {"text": text}, schemas)]
    if implicit and role == "assistant":
        return [("result", f"{conv}:{turn - 1}", None, canonical(text), [], None)]
    return plain


def events(messages: DataFrame, schemas: dict, implicit: bool = True) -> DataFrame:
    for schema in schemas.values():
        check_schema(schema)
    names = [x.split()[0] for x in EVENTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 5, pa.list_(pa.string()), pa.string()]

    def work(batches):
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for seq, e in enumerate(events_of(conv, turn, role, text, schemas, implicit)):
                    rows.append((conv, turn, seq, role, *e))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    kept = [F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), *[F.col(c).cast("string").alias(c) for c in ("role", "text")]]
    return messages.select(*kept).mapInArrow(work, EVENTS)


_READY = "conv_id bigint, call_id string, ready bigint, depth int, state string"


def _sorted_calls(table: pa.Table) -> pa.Table:
    """When the calls of one conversation can run: by peeling off, again and again, what waits for nothing open."""
    ids = table.column("call_id").to_pylist()
    turn, result, refs = (table.column(c).to_pylist() for c in ("turn", "result_turn", "refs"))
    number = {x: i for i, x in enumerate(ids)}
    waits = [set(r or ()) for r in refs]
    ready, depth, state = list(turn), [0] * len(ids), ["cycle" if w else "" for w in waits]
    open_, followers = [0] * len(ids), [[] for _ in ids]
    free = deque()
    for i, w in enumerate(waits):
        if not w:
            free.append(i)
        elif not all(x in number for x in w):
            state[i] = "unknown reference"
            free.append(i)
        else:
            open_[i] = len(w)
            for x in w:
                followers[number[x]].append(i)
    while free:
        i = free.popleft()
        after = ready[i] if result[i] is None else max(ready[i], result[i])
        for k in followers[i]:
            ready[k], depth[k] = max(ready[k], after), max(depth[k], depth[i] + 2)
            open_[k] -= 1
            if not open_[k]:
                state[k] = ""
                free.append(k)
    for i, s in enumerate(state):
        if s == "cycle":
            ready[i], depth[i] = turn[i], 0
    return pa.table(
        [table.column("conv_id"), pa.array(ids, pa.string()), pa.array(ready, pa.int64()), pa.array(depth, pa.int32()), pa.array(state, pa.string())],
        names=[x.split()[0] for x in _READY.split(", ")],
    )


def _ordered(found: DataFrame, most_calls: int = MOST_CALLS) -> DataFrame:
    """(conv_id, call_id, ready, depth, state) of the calls in conversations with references: when they can run."""
    firsts = found.where("kind = 'call' and place = first_call").select("conv_id", "call_id", "turn", "refs", "result_turn")
    size = firsts.groupBy("conv_id").agg(F.count("*").alias("calls"), F.max(F.size("refs")).alias("most")).where("most > 0")
    small = firsts.join(size.where(F.col("calls") <= most_calls), "conv_id", "left_semi").groupBy("conv_id").applyInArrow(_sorted_calls, _READY)
    huge = size.where(F.col("calls") > most_calls)
    return small if huge.isEmpty() else small.unionAll(_peeled(firsts.join(huge, "conv_id", "left_semi")))


def _peeled(firsts: DataFrame) -> DataFrame:
    """The same for conversations too large for one task: a round of joins for each step of the longest chain."""
    firsts = checkpointed(firsts)
    waits = firsts.select("conv_id", "call_id", F.explode("refs").alias("ref")).distinct()
    done = firsts.where(F.size("refs") == 0).select("conv_id", "call_id", F.col("turn").alias("ready"), F.lit(0).alias("depth"), F.lit("").alias("state"), "result_turn")
    todo = firsts.where(F.size("refs") > 0).drop("refs")
    known = firsts.select("conv_id", F.col("call_id").alias("ref"))
    lost = waits.join(known, ["conv_id", "ref"], "left_anti").select("conv_id", "call_id").distinct()
    out = todo.join(lost, ["conv_id", "call_id"], "left_semi").select(
        "conv_id", "call_id", F.col("turn").alias("ready"), F.lit(0).alias("depth"), F.lit("unknown reference").alias("state"), "result_turn"
    )
    todo = checkpointed(todo.join(lost, ["conv_id", "call_id"], "left_anti"))
    done = checkpointed(done.unionAll(out))
    while not todo.isEmpty():
        met = waits.join(todo.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_semi").join(
            done.select("conv_id", F.col("call_id").alias("ref"), F.greatest("ready", F.coalesce("result_turn", "ready")).alias("after"), "depth"), ["conv_id", "ref"], "left"
        )
        met = met.groupBy("conv_id", "call_id").agg(F.max("after").alias("after"), F.max("depth").alias("depth"), F.count_if(F.col("depth").isNull()).alias("open"))
        now = todo.join(met.where("open = 0").drop("open"), ["conv_id", "call_id"]).select(
            "conv_id", "call_id", F.greatest("turn", "after").alias("ready"), (F.col("depth") + 2).alias("depth"), F.lit("").alias("state"), "result_turn"
        )
        now = checkpointed(now)
        if now.isEmpty():
            now = todo.select("conv_id", "call_id", F.col("turn").alias("ready"), F.lit(0).alias("depth"), F.lit("cycle").alias("state"), "result_turn")
        todo = checkpointed(todo.join(now, ["conv_id", "call_id"], "left_anti"))
        done = checkpointed(done.unionAll(now))
    return done.drop("result_turn")


def link(messages: DataFrame, schemas: dict = REPLY, implicit: bool = True) -> DataFrame:
    """conv_id, turn, seq, role, kind, call_id, status, valid, error, position and message (canonical JSON) of every event."""
    found = events(messages, schemas, implicit)
    # place: order of events in the input; equal rows share it and are told apart by nothing, so only one is first
    found = checkpointed(found.withColumn("place", F.struct("turn", "seq", "body", F.monotonically_increasing_id().alias("row"))))
    tied = found.where("call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min(F.when(F.col("kind") == "call", F.col("place"))).alias("first_call"), F.min(F.when(F.col("kind") == "result", F.col("place"))).alias("first_result")
    )
    found = found.join(tied, ["conv_id", "call_id"], "left").withColumn("result_turn", F.col("first_result.turn"))
    is_first = F.when(F.col("kind") == "call", F.col("place") == F.col("first_call")).otherwise(F.col("place") == F.col("first_result"))
    status = (
        F.when(F.col("call_id").isNull(), "plain")
        .when(~is_first, "duplicate")
        .when(F.col("first_call").isNull(), "orphan")
        .when(F.col("first_result").isNull(), "unanswered")
        .otherwise("linked")
    )
    found = found.withColumn("status", status)
    cited = found.where("size(refs) > 0")
    if cited.isEmpty():
        found = found.withColumns({"ready": F.col("turn"), "depth": F.lit(0), "state": F.lit("")})
    else:
        found = found.join(_ordered(found), ["conv_id", "call_id"], "left")
    answer = (F.col("kind") == "result").cast("int")
    found = found.withColumns(
        {
            # nothing comes before its call
            "ready": F.coalesce(F.greatest("turn", F.coalesce("ready", "first_call.turn")), F.lit(0)),
            "depth": F.coalesce("depth", F.lit(0)) + answer,
            "error": F.nullif(F.concat_ws("; ", "error", F.nullif(F.col("state"), F.lit(""))), F.lit("")),
            "group": F.coalesce("conv_id", F.lit(0)),
            "nameless": F.col("conv_id").isNull(),
        }
    )
    found = found.withColumn("piece", F.expr(f"int(ready div {TURNS_PER_PIECE})"))
    found = ranked(found, ["group", "nameless"], "piece", ["ready", "depth", "turn", "seq", "place"], "position", "events")
    quote = lambda c: F.to_json(F.array(c))
    value = lambda c: F.substring(quote(F.col(c)), F.lit(2), F.length(quote(F.col(c))) - 2)
    parts = [
        F.concat(F.lit('"body":'), F.col("body")),
        F.when(F.col("call_id").isNotNull(), F.concat(F.lit('"id":'), value("call_id"))),
        F.concat(F.lit('"kind":"'), F.col("kind"), F.lit('"')),
        F.when(F.col("name").isNotNull(), F.concat(F.lit('"name":'), value("name"))),
        F.concat(F.lit('"position":'), F.col("position")),
        F.when(F.col("role").isNotNull(), F.concat(F.lit('"role":'), value("role"))),
        F.concat(F.lit('"status":"'), F.col("status"), F.lit('"')),
    ]
    message = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return found.select("conv_id", "turn", "seq", "role", "kind", "call_id", "status", F.col("error").isNull().alias("valid"), "error", "position", message.alias("message"))


def op10_tool_calls(spark, sf_dir: str) -> DataFrame:
    """Every turn of ``conversations`` as linked, ordered and validated events in canonical JSON."""
    return link(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
