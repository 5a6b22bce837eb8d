"""Run trees and chat completions as spans."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Kinds of run by kind of span.
RUN_KINDS = {"llm": "chat", "embedding": "embeddings", "tool": "tool", "retriever": "retrieval", "chain": "agent"}
SPAN = "span_id string, parent_id string, trace_id string, name string, kind string, status string, start_ms bigint, end_ms bigint, input string, output string"


def run_spans(runs: DataFrame) -> DataFrame:
    """runs: flat rows of id, parent_run_id, trace_id, name, run_type, start_ms, end_ms, inputs, outputs (JSON), error."""
    kinds = F.create_map(*[F.lit(x) for kv in RUN_KINDS.items() for x in kv])
    return runs.select(F.col("id").alias("span_id"), F.col("parent_run_id").alias("parent_id"), "trace_id", "name", F.coalesce(F.try_element_at(kinds, F.col("run_type")), F.lit("custom")).alias("kind"), F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), "start_ms", "end_ms", F.col("inputs").alias("input"), F.col("outputs").alias("output"))


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.S)
_FIELDS = ("id", "name", "run_type", "start_time", "end_time", "inputs", "outputs", "error")
FLAT = "id string, parent_run_id string, trace_id string, name string, run_type string, start_ms bigint, end_ms bigint, inputs string, outputs string, error string, place int, depth int"


def walk_runs(root: str | None) -> Iterator[tuple]:
    """The runs of one tree in pre-order: own text, number of the parent (None for the root), depth.

    One pass over the strings and brackets of the text, with the open runs as a stack; a run's own text is what is left of it
    without its children, so no text is parsed twice and no depth is too deep.
    """
    texts: list[list[str]] = []
    parents: list[int | None] = []
    depths: list[int] = []
    open_runs: list[list[int]] = []  # number, brackets open within it, where its own text goes on
    lists = 0  # lists of children that are open
    key = False
    for t in _TOKEN.finditer(root or ""):
        token = t.group()
        inside = open_runs and lists < len(open_runs)  # within a run's own text, not between children
        if not inside:
            if token == "{":
                texts.append([])
                parents.append(open_runs[-1][0] if open_runs else None)
                depths.append(len(open_runs))
                open_runs.append([len(texts) - 1, 0, t.start()])
            elif token == "]" and lists:
                lists -= 1
                open_runs[-1][2] = t.end()
            continue
        number, level, begun = open_runs[-1]
        if token == "[" and key and level == 0:
            texts[number] += [root[begun : t.start()], "null"]
            lists += 1
        elif token in "{[":
            open_runs[-1][1] += 1
        elif token in "}]" and level:
            open_runs[-1][1] -= 1
        elif token == "}":
            texts[number].append(root[begun : t.end()])
            open_runs.pop()
            if not open_runs:
                break
        key = token == '"child_runs"' and level == 0
    for text, parent, depth in zip(texts, parents, depths):
        yield "".join(text), parent, depth


def _number(x: object) -> int | None:
    try:
        return int(x) if isinstance(x, int) else int(float(x))
    except (TypeError, ValueError, OverflowError):
        return None


def _as_text(x: object) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _rows(trees: pd.Series) -> Iterator[tuple]:
    for root in trees:
        names: list[str | None] = []
        for place, (text, parent, depth) in enumerate(walk_runs(root)):
            try:
                run = json.loads(text, parse_float=str)
            except ValueError:
                run = {}
            f = {k: run.get(k) for k in _FIELDS}
            ms = [_number(f[k]) for k in ("start_time", "end_time")]
            names.append(_as_text(f["id"]))
            yield (names[-1], None if parent is None else names[parent], names[0], _as_text(f["name"]), _as_text(f["run_type"]), *ms, _as_text(f["inputs"]), _as_text(f["outputs"]), _as_text(f["error"]), place, depth)


def flatten_runs(trees: DataFrame, batch: int = 1000) -> DataFrame:
    """trees: root (JSON of a run with child_runs, of any depth). One row per run, with its place in pre-order and its depth.

    A run whose own text doesn't parse has nulls; text that holds no object has no rows.
    """

    def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FLAT.split(", ")]
        for trees in batches:
            rows = _rows(trees["root"])
            while part := list(islice(rows, batch)):
                out = pd.DataFrame(part, columns=names)
                out[["start_ms", "end_ms"]] = out[["start_ms", "end_ms"]].astype("Int64")
                yield out

    return trees.select("root").mapInPandas(flatten, FLAT)


def agent_run_spans(runs: DataFrame) -> DataFrame:
    """runs: run_id, name, start_ms, end_ms, calls (array of struct id, input, output, start_ms, end_ms), tools (array of struct id, name, arguments, output, ok, start_ms, end_ms)."""
    agent = runs.select(F.col("run_id").alias("span_id"), F.lit(None).cast("string").alias("parent_id"), F.col("run_id").alias("trace_id"), "name", F.lit("agent").alias("kind"), F.lit("ok").alias("status"), "start_ms", "end_ms", F.lit(None).cast("string").alias("input"), F.lit(None).cast("string").alias("output"))
    chat = runs.select("run_id", F.explode("calls").alias("c")).select(F.col("c.id").alias("span_id"), F.col("run_id").alias("parent_id"), F.col("run_id").alias("trace_id"), F.lit("model").alias("name"), F.lit("chat").alias("kind"), F.lit("ok").alias("status"), "c.start_ms", "c.end_ms", "c.input", "c.output")
    tool = runs.select("run_id", F.explode("tools").alias("t")).select(F.col("t.id").alias("span_id"), F.col("run_id").alias("parent_id"), F.col("run_id").alias("trace_id"), "t.name", F.lit("tool").alias("kind"), F.when(F.col("t.ok"), "ok").otherwise("error").alias("status"), "t.start_ms", "t.end_ms", F.col("t.arguments").alias("input"), "t.output")
    return agent.unionByName(chat).unionByName(tool)


#: What a span's kind and status may be.
SPAN_KINDS, SPAN_STATUSES = ("chat", "embeddings", "tool", "agent", "retrieval", "custom"), ("ok", "error")


def _kind_of(v: Column, field: str) -> Column:
    """The type of a field of a variant: STRING, BIGINT, OBJECT<...>; null where it is absent."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))


def _wrong(v: Column, field: str, needed: bool, what: str = "STRING") -> Column:
    """The reason why a field won't do, or null: absent, of another type, or an empty text that is needed."""
    kind = _kind_of(v, field)
    empty = (kind == "STRING") & (F.try_variant_get(v, f"$.{field}", "string") == "") if needed and what == "STRING" else F.lit(False)
    absent = F.when(kind.isNull(), F.lit(f"{field}:missing")) if needed else F.when(kind.isNull(), F.lit(None).cast("string"))
    return absent.when(~kind.startswith(what), F.lit(f"{field}:type")).when(empty, F.lit(f"{field}:empty"))


def _not_of(v: Column, field: str, values: tuple[str, ...], needed: bool) -> Column:
    text = F.try_variant_get(v, f"$.{field}", "string")
    return F.coalesce(_wrong(v, field, needed), F.when(text.isNotNull() & ~text.isin(*values), F.lit(f"{field}:value")))


def checked_traces(lines: DataFrame) -> DataFrame:
    """lines: value (a trace as JSON). value, v, reasons (empty: good). A trace is refused whole, with every reason and its span's number."""
    v = F.col("v")
    rows = lines.withColumn("v", F.try_parse_json("value"))
    spans = F.try_variant_get("v", "$.spans", "array<variant>")
    span = lambda s: F.array_compact(F.array(
        _wrong(s, "spanId", True), _wrong(s, "parentSpanId", False), _wrong(s, "name", True), _not_of(s, "kind", SPAN_KINDS, True), _wrong(s, "attributes", False, "OBJECT"),
        _wrong(s, "startTime", True), _wrong(s, "endTime", False), _not_of(s, "status", SPAN_STATUSES, False), _wrong(s, "error", False),
    ))
    of_spans = F.flatten(F.transform(spans, lambda s, i: F.transform(span(s), lambda x: F.concat(F.lit("spans["), i.cast("string"), F.lit("]."), x))))
    of_trace = F.array_compact(F.array(_wrong(v, "traceId", True), _wrong(v, "sessionId", False), _wrong(v, "userId", False), _wrong(v, "turnIndex", False, "BIGINT"), _wrong(v, "name", False), _wrong(v, "metadata", False, "OBJECT"), _wrong(v, "spans", False, "ARRAY")))
    reasons = F.when(v.isNull(), F.array(F.lit("json"))).when(~F.schema_of_variant(v).startswith("OBJECT"), F.array(F.lit("object"))).otherwise(F.concat(of_trace, F.coalesce(of_spans, F.array().cast("array<string>"))))
    return rows.withColumn("reasons", reasons)


def refused_traces(lines: DataFrame) -> DataFrame:
    """value, reasons of the traces that don't pass; batch or stream. Blank lines are none."""
    return checked_traces(lines.filter(F.trim("value") != "")).filter(F.size("reasons") > 0).select("value", "reasons")


def ingested_spans(lines: DataFrame, late: str = "1 hour") -> DataFrame:
    """The spans of the traces that pass, each span of a trace once; batch or stream.

    A stream remembers spans for as long as its watermark on their start allows (`late`), and then forgets them.
    """
    good = checked_traces(lines.filter(F.trim("value") != "")).filter(F.size("reasons") == 0)
    text = lambda v, f: F.try_variant_get(v, f"$.{f}", "string")
    as_json = lambda f: F.to_json(F.try_variant_get("s", f"$.{f}", "variant"))
    given = good.select(text(F.col("v"), "traceId").alias("traceId"), text(F.col("v"), "sessionId").alias("sessionId"), F.explode(F.try_variant_get("v", "$.spans", "array<variant>")).alias("s"))
    s, ms = F.col("s"), lambda f: F.unix_millis(F.try_to_timestamp(text(F.col("s"), f)))
    spans = given.select(text(s, "spanId").alias("span_id"), text(s, "parentSpanId").alias("parent_id"), F.coalesce("sessionId", "traceId").alias("trace_id"), text(s, "name").alias("name"), text(s, "kind").alias("kind"), F.coalesce(text(s, "status"), F.lit("ok")).alias("status"), ms("startTime").alias("start_ms"), ms("endTime").alias("end_ms"), as_json("input").alias("input"), as_json("output").alias("output"))
    if not spans.isStreaming:
        return spans.dropDuplicates(["trace_id", "span_id"])
    timed = spans.withColumn("started", F.coalesce(F.timestamp_millis("start_ms"), F.lit(0).cast("timestamp"))).withWatermark("started", late)
    return timed.dropDuplicatesWithinWatermark(["trace_id", "span_id"]).drop("started")


def ingest_stream(lines: DataFrame, folder: str, late: str = "1 hour") -> list[StreamingQuery]:
    """Takes in what there is: good spans to folder/spans, refused traces with their reasons to folder/refused, as Parquet."""
    tables = {"spans": ingested_spans(lines, late), "refused": refused_traces(lines)}
    return [df.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/_state/{name}").trigger(availableNow=True).start() for name, df in tables.items()]


def read_spans(spark, path: str) -> DataFrame:
    """The spans of traces as JSON lines; refused_traces tells of the lines that are left out."""
    return ingested_spans(spark.read.text(path))
