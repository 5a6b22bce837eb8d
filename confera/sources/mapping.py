"""Mapping of unknown uploads to canonical turns: fields are found by name, on the driver, from the schema alone; and profiles of values."""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from confera.functions.text import js_round
from confera.operators.store import use_shared_folder
from confera.sources.readers import canonical_role, default_time

#: Names that a field may have, best first.
CANDIDATES = {
    "session_id": ("sessionId", "session_id", "conversationId", "conversation_id", "dialogue_id", "chat_id", "thread_id", "id"),
    "role": ("role", "speaker", "sender", "author", "from"),
    "content": ("content", "text", "message", "utterance", "body"),
    "timestamp": ("timestamp", "time", "created_at", "createdAt", "date"),
}
_LISTS = ("messages", "turns", "conversation", "dialogue", "chat")


@dataclass
class MappingPlan:
    path: tuple[str, ...] = ()
    fields: dict[str, str] = field(default_factory=dict)
    parents: dict[str, str] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    confidence: float = 0.52
    questions: list[str] = field(default_factory=list)
    review: str = "none"

    @property
    def capabilities(self) -> dict[str, bool]:
        return capability_report(self.targets)[0]

    @property
    def targets(self) -> set[str]:
        names = {"role": "messages.role", "content": "messages.content", "timestamp": "messages.timestamp", "session_id": "conversationId"}
        return {names[t] for t in (*self.fields, *self.parents)}


# Groups of metrics, each with the capability it needs and what is missing without it.
METRIC_GROUPS = [
    ("basic_chat", "basic_chat_eval", "role and content"), ("schema_aware", "schema_aware_eval", "schema"), ("slot_eval", "slot_eval", "slots or dialogue states"), ("state_tracking", "state_tracking_eval", "dialogue states"),
    ("service_call_eval", "service_call_eval", "service calls"), ("service_result_grounding", "service_result_grounding", "service results"), ("actual_tool_trace_eval", "actual_tool_trace_eval", "tool traces"),
]


def capability_report(targets: set[str]) -> tuple[dict[str, bool], list[str], list[tuple[str, str]]]:
    """targets: names such as messages.role or annotations.serviceCalls. Capabilities, enabled groups, disabled ones with what they lack."""
    starts = lambda prefix: any(t.startswith(prefix) for t in targets)
    any_of = lambda *names: bool(targets & {*names})
    calls = any_of("annotations.serviceCalls")
    has = {
        "basic_chat": {"messages.role", "messages.content"} <= targets, "schema_aware": starts("schema."), "slot_eval": any_of("annotations.slotMentions", "annotations.dialogueStates"), "state_tracking": any_of("annotations.dialogueStates"),
        "service_call_eval": calls, "service_result_grounding": any_of("annotations.serviceResults"), "actual_tool_trace_eval": any_of("actualTrace.toolCalls", "actualTrace.toolResults"), "benchmark_gold_eval": starts("gold.") or calls,
    }
    return has, [g for c, g, _ in METRIC_GROUPS if has[c]], [(g, lack) for c, g, lack in METRIC_GROUPS if not has[c]]


def find_field(names: list[str], target: str) -> str | None:
    """An equal name in order of the candidates, else one that contains a candidate."""
    low = {n.lower(): n for n in reversed(names)}
    for c in CANDIDATES[target]:
        if c.lower() in low:
            return low[c.lower()]
    for c in CANDIDATES[target]:
        for n in names:
            if len(c) > 2 and c.lower() in n.lower():
                return n
    return None


def _arrays(kind: DataType, path: tuple[str, ...] = (), depth: int = 4):
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        yield path, kind.elementType
        kind = kind.elementType
    if isinstance(kind, StructType) and depth:
        for f in kind.fields:
            yield from _arrays(f.dataType, (*path, f.name), depth - 1)


def candidate_score(path: tuple[str, ...], names: list[str]) -> float:
    return 0.45 * bool(find_field(names, "content")) + 0.35 * bool(find_field(names, "role")) + 0.2 * any(w in ".".join(path).lower() for w in _LISTS)


def infer_mapping(schema: StructType) -> MappingPlan:
    options = [(candidate_score((), schema.fieldNames()), (), schema)]
    options += [(candidate_score(p, e.fieldNames()), p, e) for p, e in _arrays(schema)]
    score, path, element = max(options, key=lambda x: x[0])
    if score <= 0.4:
        return MappingPlan(warnings=["no messages found"])
    plan = MappingPlan(path, {t: f for t in CANDIDATES if (f := find_field(element.fieldNames(), t))})
    if path:
        plan.parents = {t: f for t in ("session_id", "timestamp") if t not in plan.fields and (f := find_field(schema.fieldNames(), t)) and isinstance(schema[f].dataType, StringType)}
    plan.warnings = [f"{t} is missing" for t in ("role", "content") if t not in plan.fields]
    plan.confidence = 0.52 if plan.warnings else 0.78
    return plan


def _united(*lists: list[str]) -> list[str]:
    """Trimmed, each once, in the order of their first appearance."""
    return list(dict.fromkeys(t for x in lists for x_ in x if (t := x_.strip())))


def review_mapping(plan: MappingPlan, judge: Callable[[MappingPlan], dict]) -> MappingPlan:
    """The plan after a judge's review: a dict with confidence, warnings and questions, each of which may be missing.

    The confidence is the mean of both, to two places; warnings and questions are united. A judge that fails leaves the plan
    as it is, with a warning.
    """
    try:
        said = judge(plan)
    except Exception as e:  # noqa: BLE001  whatever a judge runs into, the plan stands
        return replace(plan, warnings=_united(plan.warnings, [f"review failed: {e}"]), review="degraded")
    own = min(1.0, max(0.0, said.get("confidence", plan.confidence)))
    return replace(plan, confidence=math.floor((plan.confidence + own) / 2 * 100 + 0.5) / 100, warnings=_united(plan.warnings, said.get("warnings", [])), questions=_united(plan.questions, said.get("questions", [])), review="completed")


def apply_mapping(df: DataFrame, plan: MappingPlan) -> DataFrame:
    """Canonical rows; empty contents go, unknown roles too, missing times are made from the place of the row."""
    if not plan.capabilities["basic_chat"]:
        return df.sparkSession.createDataFrame([], "session_id string, ts_raw string, role string, content string, ingest_seq bigint")
    base = df.withColumn("__seq", F.monotonically_increasing_id())
    if plan.path:
        item = F.col(plan.path[0])
        for p in plan.path[1:]:
            item = item.getField(p)
        rows = base.select(*df.columns, "__seq", F.posexplode(item).alias("__k", "__m"))
        own = lambda t: F.col(f"__m.`{plan.fields[t]}`") if t in plan.fields else F.col(f"`{plan.parents[t]}`") if t in plan.parents else None
    else:
        rows = base.withColumn("__k", F.lit(0))
        own = lambda t: F.col(f"`{plan.fields[t]}`") if t in plan.fields else None
    session, time = own("session_id"), own("timestamp")
    out = rows.select(F.coalesce(session.cast("string"), F.lit("session_001")).alias("session_id") if session is not None else F.lit("session_001").alias("session_id"), F.coalesce(time.cast("string"), default_time(F.col("__k"))).alias("ts_raw") if time is not None else default_time(F.col("__k")).alias("ts_raw"), canonical_role(own("role")).alias("role"), F.trim(own("content").cast("string")).alias("content"), (F.col("__seq") * 100_000 + F.col("__k")).alias("ingest_seq"))
    return out.filter("role is not null and content <> ''")


def detect_source(schema: StructType) -> str:
    names = set(schema.fieldNames()) | {n for _, e in _arrays(schema) for n in e.fieldNames()}
    return "sgd" if {"dialogue_id", "turns"} <= names else "assetops" if {"id", "text", "characteristic_form"} <= names else "custom"


def sample_paths(kind: DataType, most: int = 30, depth: int = 3, keys: int = 20) -> list[str]:
    out: list[str] = []

    def walk(kind: DataType, path: str, left: int) -> None:
        if len(out) >= most:
            return
        out.append(path)
        if isinstance(kind, ArrayType) and left:
            walk(kind.elementType, f"{path}[*]", left - 1)
        elif isinstance(kind, StructType) and left:
            for f in kind.fields[:keys]:
                walk(f.dataType, f"{path}.{f.name}", left - 1)

    walk(kind, "$", depth)
    return out[:most]


#: How far a value is looked into, and how many paths are told.
DEPTH, ITEMS, KEYS, PATHS = 4, 3, 20, 30


def value_paths(value: object, depth: int = DEPTH, items: int = ITEMS, keys: int = KEYS) -> Iterator[tuple[str, str]]:
    """Path and type of a parsed JSON value and of what it holds: the first items of a list, the first keys of an object."""
    todo: list[tuple[str, object, int]] = [("$", value, 0)]
    while todo:
        path, v, level = todo.pop()
        kind = "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"
        yield path, kind
        if level < depth and kind == "array":
            todo += [(f"{path}[*]", x, level + 1) for x in v[:items]]
        elif level < depth and kind == "object":
            todo += [(f"{path}.{k}", x, level + 1) for k, x in list(v.items())[:keys]]


def value_profile(records: DataFrame, most: int = PATHS) -> DataFrame:
    """records: value (JSON text). path, type, records (that hold such a value there), coverage (share of all that parse).

    A record counts once for each type that it has at a path. Types come from the values, so a path that holds numbers in some records and texts in others has a row for each. Batches
    are counted where they are; a row per path and type is all that moves. Told are the paths that most records have. Text
    that doesn't parse is the path "" of type "unparsed" (never cut off), and has no share in the coverage.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["value"]:
                try:
                    seen.update(set(value_paths(json.loads(text))))
                except (TypeError, ValueError, RecursionError):
                    seen["", "unparsed"] += 1
            if len(seen) > 100_000:  # of odd records: hand on what there is
                yield pd.DataFrame([(p, t, n) for (p, t), n in seen.items()], columns=["path", "type", "records"])
                seen.clear()
        yield pd.DataFrame([(p, t, n) for (p, t), n in seen.items()], columns=["path", "type", "records"])

    counts = records.select("value").mapInPandas(count, "path string, type string, records bigint").groupBy("path", "type").agg(F.sum("records").alias("records"))
    use_shared_folder(records.sparkSession)
    counts = counts.checkpoint()
    total = counts.filter("path = '$'").agg(F.sum("records").alias("total"))
    known = counts.groupBy("path").agg(F.sum("records").alias("n"))
    told = known.filter("path = ''").unionByName(known.filter("path <> ''").orderBy(F.desc("n"), "path").limit(most))
    met = counts.join(F.broadcast(told.select("path")), "path").join(F.broadcast(total))
    return met.select("path", "type", "records", F.when(F.col("path") != "", js_round(F.col("records") / F.col("total"), 4)).alias("coverage"))


def source_format(profile: DataFrame) -> str:
    """What the profiled records are: sgd (dialogues with turns), assetops, or custom; from the paths that they hold."""
    names = {r["path"] for r in profile.select("path").distinct().collect()}  # as many as are told
    ends = lambda *keys: any({f"{at}.{k}" for k in keys} <= names for at in {p.rpartition(".")[0] for p in names})
    return "sgd" if ends("dialogue_id", "turns") else "assetops" if ends("id", "text", "characteristic_form") else "custom"
