"""Raw trace lines of agents as actions, and their calls paired by id (SRC8).

A line becomes actions: `open` and `close` of a call, `end` of a run, `bad` for each malformed field, `other` for a line
without any. Reading a line is a small function of its dialect inside an Arrow map; pairing is Spark's grouping.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pairwell.functions.text import parse_strict

#: action: phase, call id, name, whether it went well, what is wrong
Action = tuple[str, str | None, str | None, bool | None, str | None]
OTHER: Action = ("other", None, None, None, None)


def _bad(problem: str) -> Action:
    return ("bad", None, None, None, problem)


def _text(x) -> bool:
    return isinstance(x, str) and bool(x.strip())


def _claude(r: dict) -> Iterator[Action]:
    kind, message = r.get("type"), r.get("message")
    if kind == "result":
        yield ("end", None, None, r.get("is_error") is not True, None)
    if kind not in ("assistant", "user") or not isinstance(message, dict):
        return
    content = message.get("content")
    if not isinstance(content, str | list | None):
        yield _bad("message content must be a string or list")
    for block in content if isinstance(content, list) else ():
        if isinstance(block, dict) and block.get("type") == "tool_use":
            wrong = [_bad(f"tool_use {f} must be a non-empty string") for f in ("id", "name") if not _text(block.get(f))]
            wrong += [] if isinstance(block.get("input"), dict) else [_bad("tool_use input must be an object")]
            yield from wrong or [("open", block["id"], block["name"], None, None)]
        if isinstance(block, dict) and block.get("type") == "tool_result":
            wrong = [] if _text(block.get("tool_use_id")) else [_bad("tool_result id must be a non-empty string")]
            wrong += [] if isinstance(block.get("is_error", False), bool | None) else [_bad("tool_result is_error must be boolean")]
            yield from wrong or [("close", block["tool_use_id"], None, not block.get("is_error"), None)]


def _codex(r: dict) -> Iterator[Action]:
    kind, item = r.get("type"), r.get("item")
    if kind in ("turn.completed", "turn.failed"):
        yield ("end", None, None, kind == "turn.completed", None)
    if kind not in ("item.started", "item.completed"):
        return
    if not isinstance(item, dict) or not _text(item.get("id")):
        yield _bad("item id must be a non-empty string")
    elif name := item.get("command") or item.get("tool") or (item.get("query") and "web_search"):
        if kind == "item.started":
            yield ("open", item["id"], str(name), None, None)
        else:
            yield ("close", item["id"], str(name), item.get("status") != "failed" and item.get("exit_code") in (None, 0), None)


def _gemini(r: dict) -> Iterator[Action]:
    kind, call = r.get("type"), r.get("tool_id")
    if kind == "result":
        yield ("end", None, None, r.get("status") == "success", None)
    if kind not in ("tool_use", "tool_result"):
        return
    if not _text(call):
        yield _bad(f"{kind} tool_id must be a non-empty string")
    elif kind == "tool_use":
        wrong = [] if _text(r.get("tool_name")) else [_bad("tool_use tool_name must be a non-empty string")]
        wrong += [] if isinstance(r.get("parameters"), dict) else [_bad("tool_use parameters must be an object")]
        yield from wrong or [("open", call, r["tool_name"], None, None)]
    elif r.get("status") not in ("success", "error"):
        yield _bad("tool_result status must be success or error")
    else:
        yield ("close", call, None, r["status"] == "success", None)


def _pi(r: dict) -> Iterator[Action]:
    kind, call = r.get("type"), r.get("toolCallId")
    if kind == "agent_end":
        yield ("end", None, None, True, None)
    if kind in ("tool_execution_start", "tool_execution_end"):
        if not _text(call):
            yield _bad("toolCallId must be a non-empty string")
        elif kind.endswith("start"):
            yield ("open", call, r.get("toolName"), None, None)
        else:
            yield ("close", call, r.get("toolName"), r.get("isError") is not True, None)


def _vibe(r: dict) -> Iterator[Action]:
    if r.get("role") == "assistant":
        for c in r.get("tool_calls") or ():
            name = (c.get("function") or {}).get("name") if isinstance(c, dict) else None
            yield ("open", c["id"], name, None, None) if isinstance(c, dict) and _text(c.get("id")) else _bad("tool call id must be a non-empty string")
    if r.get("role") == "tool":
        yield ("close", r["tool_call_id"], r.get("name"), True, None) if _text(r.get("tool_call_id")) else _bad("tool_call_id must be a non-empty string")


def _generic(r: dict) -> Iterator[Action]:
    """type, id, name, status as they are: a started call opens, a completed or failed one closes."""
    status = str(r.get("status") or "").strip().lower()
    if _text(r.get("id")):
        if status in ("started", "running", "in_progress"):
            yield ("open", r["id"], r.get("name"), None, None)
        elif status in ("completed", "success", "succeeded", "done", "failed", "error"):
            yield ("close", r["id"], r.get("name"), status not in ("failed", "error"), None)


#: Names are exact; three of them are other names of the generic form.
DIALECTS: dict[str, Callable[[dict], Iterator[Action]]] = {
    "claude": _claude, "codex": _codex, "gemini": _gemini, "pi": _pi, "vibe": _vibe, "jetty": _generic, "generic": _generic, "stub": _generic, "subagent": _generic,
}


def actions_of(dialect: str | None, line: str) -> list[Action]:
    read = DIALECTS.get((dialect or "").lower())
    if read is None:
        return [_bad("unknown dialect")]
    record, why = parse_strict(line)
    if why or not isinstance(record, dict):
        return [_bad("not a JSON object" if why is None else "invalid JSON")]
    return list(read(record)) or [OTHER]


ACTIONS = "place int, phase string, call_id string, name string, ok boolean, problem string"


def trace_actions(lines: DataFrame, keys: Sequence[str], dialect: Column, number: str = "line_number", line: str = "line") -> DataFrame:
    """A row per action of each line: keys, line number, place in the line and the action. Bad lines and dialects are rows."""
    source = lines.select(*keys, F.col(number).cast("long").alias("line_number"), dialect.alias("__dialect"), F.col(line).alias("__line"))
    kinds = StructType([*source.schema.fields[: len(keys) + 1], *StructType.fromDDL(ACTIONS).fields])
    out = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (name, text) in enumerate(zip(batch.column("__dialect").to_pylist(), batch.column("__line").to_pylist())):
                for place, action in enumerate(actions_of(name, text or "")):
                    at.append(i)
                    rows.append((place, *action))
            kept = [batch.column(j).take(pa.array(at, pa.int64())) for j in range(len(keys) + 1)]
            made = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, list(out)[len(keys) + 1 :])]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(kept, out)] + made, schema=out)

    return source.mapInArrow(run, kinds)


def trace_calls(actions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per call of a trace: name, lines of its first open and of the first close after it, status, problem.

    A call without a close is in progress, one closed badly has failed; a close without an open before it is no call
    that was completed; a second open cannot replace the first. Grouped by trace and call id with two passes over
    narrow rows, so neither a trace nor a call's actions are ever gathered.
    """
    by, at = [*keys, "call_id"], F.struct("line_number", "place")
    calls = actions.filter(F.col("phase").isin("open", "close")).withColumn("at", at)
    opened = calls.filter("phase = 'open'").groupBy(*by).agg(F.min_by("name", "at").alias("name"), F.min("at").alias("opened"), F.count("*").alias("opens"))
    closes = calls.filter("phase = 'close'").select(*by, "at", "ok").join(opened.select(*by, "opened"), by, "left")
    after = F.col("at") > F.col("opened")
    closed = closes.groupBy(*by).agg(
        F.min(F.when(after, F.struct("at", "ok"))).alias("first"), F.count_if(after).alias("closes"), F.count_if(~F.coalesce(after, F.lit(False))).alias("early"), F.min("at").alias("seen")
    )
    both = opened.join(closed, by, "full_outer")
    problem = F.concat_ws(
        "; ",
        F.when(F.col("opens") > 1, "opened twice"),
        F.when(F.col("opens").isNull() | (F.col("early") > 0), "unmatched close"),
        F.when(F.col("closes") > 1, "closed twice"),
    )
    status = F.when(F.col("first").isNull(), F.when(F.col("opens").isNull(), "unknown").otherwise("in_progress")).when(F.col("first.ok"), "completed").otherwise("failed")
    return both.select(
        *by, "name", F.col("opened.line_number").alias("opened_line"), F.col("first.at.line_number").alias("closed_line"), status.alias("status"), F.nullif(problem, F.lit("")).alias("problem")
    )
