"""Tool-call linking for chat formatting: calls and results are hash-joined by identifier, put in topological order, their arguments validated against schemas and written as canonical JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.session import discard, written

#: Bytes of all schemas together, which go to every task.
MOST_SCHEMA_BYTES = 1 << 20
#: Calls and needs of a conversation that one task may put in order by itself; longer conversations are spread over all tasks.
MOST_ROWS = 200_000
#: Turns in one portion of a long conversation, when its calls are numbered.
TURNS = 4096

# The JSON types of a schema.
_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)


def _is_whole(value: float | Decimal) -> bool:
    _, digits, exponent = (value if isinstance(value, Decimal) else Decimal(repr(value))).as_tuple()
    return exponent >= 0 or not any(digits[exponent:])


def _number(value: float | Decimal) -> str:
    """The one spelling of a number: its exact digits, with an exponent from 1e21 on and below 1e-6."""
    value = value if isinstance(value, Decimal) else Decimal(repr(value))
    if not value.is_finite():
        raise ValueError("not a number of JSON")
    sign, digits, exponent = value.as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    short = text.rstrip("0")
    if not short:
        return "0"
    exponent += len(text) - len(short)
    top = len(short) - 1 + exponent
    if not -7 < top < 21:
        out = f"{short[0]}{'.' * (len(short) > 1)}{short[1:]}e{top:+d}"
    elif exponent >= 0:
        out = short + "0" * exponent
    else:
        out = short[:exponent] + "." + short[exponent:] if top >= 0 else "0." + "0" * (-1 - top) + short
    return "-" * sign + out


def canonical(value: Any) -> str:
    """JSON with sorted keys, no white space, one spelling for each number, and characters as they are. A lone surrogate has no such writing (UnicodeEncodeError)."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if _is_number(value):
        return _number(value)
    out = json.dumps(value, ensure_ascii=False)
    out.encode()
    return out


def parsed(text: str) -> Any:
    """JSON with exact numbers."""
    return json.loads(text, parse_float=Decimal, parse_int=Decimal, parse_constant=_no_constant)


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _is(value: Any, kind: str) -> bool:
    if kind in ("number", "integer"):
        return _is_number(value) and (kind == "number" or _is_whole(value))
    return isinstance(value, _TYPES.get(kind, ()))


def problems(value: Any, schema: dict, path: str = "$") -> list[str]:
    """What in a value goes against a schema (type, enum, const, required, properties, additionalProperties, items, pattern, and bounds of numbers, lengths and sizes)."""
    out = []
    if "type" in schema:
        kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        if not any(_is(value, k) for k in kinds):
            return [f"{path}: not {'/'.join(kinds)}"]
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{path}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{path}: not the constant")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: unknown")
    elif isinstance(value, list):
        out += [x for k, v in enumerate(value) for x in problems(v, schema.get("items", {}), f"{path}[{k}]")]
    for name, size, low, high in (("length", isinstance(value, str), "minLength", "maxLength"), ("size", isinstance(value, list), "minItems", "maxItems")):
        if size and not schema.get(low, 0) <= len(value) <= schema.get(high, len(value)):
            out.append(f"{path}: {name}")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{path}: pattern")
    if _is_number(value) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        out.append(f"{path}: range")
    return out


def checked(name: str, raw: str | None, schemas: dict[str, dict]) -> tuple[str | None, str]:
    """The canonical arguments of a call (null if they have none), and what is wrong with them."""
    try:
        value = parsed(raw)
        text = canonical(value)
        return text, "; ".join(problems(value, schemas[name])) if name in schemas else "unknown tool"
    except UnicodeEncodeError:
        return None, "lone surrogate"
    except ArithmeticError:
        return None, "number out of range"
    except RecursionError:
        return None, "nested too deeply"
    except (TypeError, ValueError):
        return None, "not JSON"


_CALL = "conv_id long, call_id string, turn long, name string, arguments string, problems string, call_message string"
_RESULT = "conv_id long, call_id string, result_turn long, n_results long, result_message string"


def _calls(schemas: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("name").to_pylist()
            got = [checked(name, raw, schemas) for name, raw in zip(names, batch.column("arguments").to_pylist(), strict=True)]
            messages = []
            for call_id, name, (text, _) in zip(batch.column("call_id").to_pylist(), names, got, strict=True):
                call = {"id": call_id, "type": "function", "function": {"name": name, "arguments": text}}
                messages.append(None if text is None else canonical({"role": "assistant", "tool_calls": [call]}))
            arrays = [pa.array(x, pa.string()) for x in ([t for t, _ in got], [p for _, p in got], messages)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "call_id", "turn", "name")), *arrays], [x.split()[0] for x in _CALL.split(", ")])

    return run


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("call_id").to_pylist(), batch.column("content").to_pylist(), strict=True)
        messages = [canonical({"role": "tool", "tool_call_id": i, "content": c}) for i, c in pairs]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "call_id", "result_turn", "n_results")), pa.array(messages, pa.string())], [x.split()[0] for x in _RESULT.split(", ")])


def _placed(calls: dict[str, int | None], needs: dict[str, set[str]]) -> list[tuple[str, int | None, int]]:
    """(call, level, position) of one conversation, by taking away calls whose needs are met."""
    left, level, users = {}, dict.fromkeys(calls, 0), {}
    for c in calls:
        own = {n for n in needs.get(c, ()) if n in calls}
        left[c] = len(own)
        for n in own:
            users.setdefault(n, []).append(c)
    ready, done = [c for c, n in left.items() if n == 0], set()
    while ready:
        c = ready.pop()
        done.add(c)
        for u in users.get(c, ()):
            level[u] = max(level[u], level[c] + 1)
            left[u] -= 1
            if left[u] == 0:
                ready.append(u)
    rows = [(c, level[c] if c in done else None) for c in calls]
    rows.sort(key=lambda x: (x[1] is None, x[1] or 0, calls[x[0]] is None, calls[x[0]] or 0, x[0]))
    return [(c, n, k) for k, (c, n) in enumerate(rows)]


_LEVEL = "conv_id long, call_id string, level int, position long"


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole conversations, one conversation after the other: calls (needs is null) and their needs."""
    here, calls, needs, out = None, {}, {}, []

    def table() -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * 4
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in _LEVEL.split(", ")])

    for batch in batches:
        for conv, call, turn, need, is_call in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "call_id", "turn", "needs", "is_call")), strict=True):
            if conv != here:
                out += [(here, *x) for x in _placed(calls, needs)]
                here, calls, needs = conv, {}, {}
            if is_call:
                before = calls.get(call)
                calls[call] = turn if before is None else before if turn is None else min(before, turn)
            else:
                needs.setdefault(call, set()).add(need)
        yield table()
        out = []
    out = [(here, *x) for x in _placed(calls, needs)]
    yield table()


def levels(calls: DataFrame, needs: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """(conv_id, call_id, level, position): the longest path to a call through the calls that it needs (null on and behind a cycle), and its place in the conversation by (level, turn, call_id), nulls last.

    calls: (conv_id, call_id) and perhaps turn, of which the least counts. needs: (conv_id, call_id, needs); a needed call that isn't there counts for nothing. Conversations of up to most_rows rows are put in order by
    one task each; longer ones by all tasks in rounds. Rows with a null conversation or call don't count.
    """
    turn = F.col("turn").cast("long") if "turn" in calls.columns else F.lit(None).cast("long")
    calls = calls.filter("conv_id is not null and call_id is not null").select("conv_id", "call_id", turn.alias("turn"))
    needs = needs.filter("conv_id is not null and call_id is not null and needs is not null").select("conv_id", "call_id", "needs")
    rows = calls.select("*", F.lit(None).cast("string").alias("needs"), F.lit(True).alias("is_call")).unionByName(needs.select("*", F.lit(None).cast("long").alias("turn"), F.lit(False).alias("is_call")))
    long = written(rows.groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > most_rows).select("conv_id"), "long")
    if any_long := not long.isEmpty():
        rows = rows.join(long, "conv_id", "left_anti")
    short = rows.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(_in_order, _LEVEL)
    if not any_long:
        discard(long)
        return short
    return short.union(_in_rounds(calls.join(long, "conv_id", "left_semi"), needs.join(long, "conv_id", "left_semi")))


def _in_rounds(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """The same for conversations of any length. Chains of calls that need one other each are cut short first, by letting each call point to what its target points to, twice as far in each
    round; what is left then takes a round for each layer of calls that need several."""
    keys = ["conv_id", "call_id"]
    nodes = written(calls.groupBy(*keys).agg(F.min("turn").alias("turn")), "calls")
    edges = needs.select(*keys, "needs").distinct().join(nodes.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_semi").join(nodes.select(*keys), keys, "left_semi")
    edges = written(edges.withColumn("steps", F.lit(1)), "needs")
    counts = written(edges.groupBy(*keys).agg(F.count("*").alias("left")), "counts")
    single = written(edges.join(counts.filter("left = 1"), keys, "left_semi").select(*keys, "needs", "steps"), "single")
    for _ in range(single.count().bit_length() + 1):
        onward = single.select("conv_id", F.col("call_id").alias("needs"), F.col("needs").alias("further"), F.col("steps").alias("more"))
        longer = written(single.join(onward, ["conv_id", "needs"], "left").select(*keys, F.coalesce("further", "needs").alias("needs"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("further").isNotNull().alias("moved")), "single")
        discard(single)
        single = longer
        if single.filter("moved").isEmpty():
            break
    several = edges.join(counts.filter("left > 1"), keys, "left_semi").select(*keys, "needs", "steps")
    edges = written(several.unionByName(single.select(*keys, "needs", "steps")), "needs")
    open_ = written(nodes.join(counts, keys, "left").select(*keys, F.coalesce("left", F.lit(0)).alias("left"), F.lit(0).alias("level")), "open")
    done = None
    while True:
        ready = written(open_.filter("left = 0").select(*keys, "level"), "ready")
        if ready.isEmpty():
            break
        done = ready if done is None else done.union(ready)
        met = edges.join(ready.select("conv_id", F.col("call_id").alias("needs"), "level"), ["conv_id", "needs"]).groupBy(*keys).agg(F.count("*").alias("met"), F.max(F.col("level") + F.col("steps")).alias("reached"))
        rest = open_.filter("left > 0").join(met, keys, "left").select(*keys, (F.col("left") - F.coalesce("met", F.lit(0))).alias("left"), F.greatest("level", F.coalesce("reached", F.lit(0))).alias("level"))
        rest = written(rest, "open")
        discard(open_)
        open_ = rest
    stuck = open_.filter("left > 0").select(*keys, F.lit(None).cast("int").alias("level"))
    found = (stuck if done is None else done.union(stuck)).join(nodes, keys)
    # a number within the portion of some turns of a level, after the sizes of those before it
    part = ["conv_id", "level", "portion"]
    found = written(found.withColumn("portion", F.floor(F.col("turn") / TURNS)), "levels")
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy(F.asc_nulls_last("level"), F.asc_nulls_last("portion")).rowsBetween(W.unboundedPreceding, -1))
    sizes = found.groupBy(*part).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    inside = F.row_number().over(W.partitionBy(*part).orderBy(F.asc_nulls_last("turn"), "call_id")) - 1
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in part]
    return found.withColumn("inside", inside).alias("a").join(sizes.alias("b"), same).select("a.conv_id", "a.call_id", "a.level", (F.col("before") + F.col("inside")).alias("position"))


def link_calls(calls: DataFrame, results: DataFrame, needs: DataFrame, schemas: dict[str, dict], most_rows: int = MOST_ROWS) -> DataFrame:
    """One row for each call (conv_id, call_id): turn, name, level, position, linked, result_turn, n_results, arguments (canonical JSON, null if they have none), valid, problems, call_message and result_message
    (the chat's messages as canonical JSON; null for a call without arguments or result).

    calls: conv_id, call_id, turn, name, arguments (JSON text). results: conv_id, call_id, turn and perhaps content (null without it). needs: conv_id, call_id, needs. A conversation's messages in order are its calls
    by position, each with its result. A call that stands more than once counts once, at its first turn (of equals the first by name and arguments). A call's result is the one of the smallest turn (of equals the first by
    content); unlinked_results() has the others. Rows with a null in conv_id or call_id are left out, other columns aren't read. Joins are on (conv_id, call_id), so a long conversation is spread over all tasks.
    """
    if len(json.dumps(schemas)) > MOST_SCHEMA_BYTES:
        raise ValueError("the schemas are too large to go to every task")
    keys = ["conv_id", "call_id"]
    calls = calls.filter("conv_id is not null and call_id is not null")
    once = calls.groupBy(*keys).agg(F.min(F.struct("turn", "name", "arguments")).alias("c")).select(*keys, "c.turn", "c.name", "c.arguments")
    linked = once.mapInArrow(_calls(schemas), _CALL)
    answers = _first_results(results).select(*keys, F.col("first.turn").alias("result_turn"), "n_results", "first.content").mapInArrow(_results, _RESULT)
    out = linked.join(answers.hint("shuffle_hash"), keys, "left").join(levels(calls, needs, most_rows), keys)
    return out.select(
        *keys, "turn", "name", "level", "position", F.col("n_results").isNotNull().alias("linked"), "result_turn", F.coalesce("n_results", F.lit(0)).alias("n_results"),
        "arguments", (F.col("problems") == "").alias("valid"), "problems", "call_message", "result_message",
    )


def _first_results(results: DataFrame) -> DataFrame:
    content = F.col("content") if "content" in results.columns else F.lit(None).cast("string")
    known = results.filter("conv_id is not null and call_id is not null").select("conv_id", "call_id", "turn", content.alias("content"))
    # nulls after the others
    key = F.struct(F.col("turn").isNull(), "turn", F.col("content").isNull(), "content")
    return known.groupBy("conv_id", "call_id").agg(F.min(key).alias("first"), F.count("*").alias("n_results"))


def unlinked_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results that link_calls() doesn't show: conv_id, call_id, turn, content, status (no call, or further result), copies (rows of the same turn and content; of the first result those beside it)."""
    keys = ["conv_id", "call_id"]
    content = F.col("content") if "content" in results.columns else F.lit(None).cast("string")
    rows = results.filter("conv_id is not null and call_id is not null").select(*keys, "turn", content.alias("content")).groupBy(*keys, "turn", "content").agg(F.count("*").alias("copies"))
    known = calls.filter("conv_id is not null and call_id is not null").select(*keys).distinct().withColumn("called", F.lit(True))
    first = _first_results(results).select(*keys, F.col("first.turn").alias("first_turn"), F.col("first.content").alias("first_content"))
    rows = rows.join(first, keys).join(known, keys, "left")
    is_first = F.col("called").isNotNull() & F.col("turn").eqNullSafe(F.col("first_turn")) & F.col("content").eqNullSafe(F.col("first_content"))
    rows = rows.withColumn("copies", F.col("copies") - is_first.cast("long")).filter("copies > 0")
    return rows.select(*keys, "turn", "content", F.when(F.col("called").isNull(), "no call").otherwise("further result").alias("status"), "copies")
