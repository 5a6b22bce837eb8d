"""Readers of conversation logs: every format becomes rows of session_id, ts_raw, role, content, ingest_seq.

A file is read in as many tasks as it has splits (`splits`). ingest_seq orders rows within a file; times that a source lacks are made from a fixed base and the place of the row, so the
same file gives the same rows on every run.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confera.sources.splits import KEY, carried_last, carried_sum, json_documents, numbered_lines, within_split

ROLES = ("user", "assistant", "system")
#: What other sources call the roles.
ROLE_ALIASES = {"user": "user", "human": "user", "customer": "user", "client": "user", "speaker": "user", "assistant": "assistant", "bot": "assistant", "agent": "assistant", "system": "system"}
BASE = "2020-01-01T00:00:00Z"
FORMATS = {"csv": "csv", "json": "json", "jsonl": "jsonl", "txt": "txt", "md": "md"}


def infer_format(name: str) -> str:
    return FORMATS.get(name.rpartition(".")[2].lower(), "txt")


def read_logs(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    kind = kind or infer_format(path)
    return {"csv": read_csv, "json": read_json, "jsonl": read_jsonl, "txt": read_text, "md": read_markdown}[kind](spark, path)


def default_time(seconds: Column) -> Column:
    """ISO time of BASE and so many seconds."""
    return F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(BASE).cast("timestamp")) + seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def canonical_role(role: Column) -> Column:
    pairs = [F.lit(x) for kv in ROLE_ALIASES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(role)))


#: Different header lines of the files read at once; more are refused with an error.
MOST_HEADERS = 1000


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A row is a line; columns by name in any order, by the header of the row's own file; one that lacks sessionId, timestamp,
    role or content gives no rows. An empty session stays empty, and a row too short to have one is of session "unknown".
    """
    lines = numbered_lines(spark, path).select("file", "n", F.trim(F.regexp_replace("line", "[\r\ufeff]", "")).alias("line")).filter("line <> ''")
    headers = lines.groupBy("file").agg(F.min(F.struct("n", "line")).alias("h")).select("file", F.col("h.n").alias("header_n"), F.col("h.line").alias("header"))
    known = [r["header"] for r in headers.select("header").distinct().limit(MOST_HEADERS + 1).collect()]
    if len(known) > MOST_HEADERS:
        raise ValueError(f"over {MOST_HEADERS} different headers")
    needed = ("sessionId", "timestamp", "role", "content")
    cells = F.regexp_count(F.regexp_replace("line", '"([^"]|"")*"', ""), F.lit(",")) + 1
    row = None
    for header in known:
        names = [c.strip() for c in next(csv.reader([header]))]
        if not set(needed) <= set(names):
            continue
        at = {c: names.index(c) for c in needed}
        parsed = F.from_csv("line", ", ".join(f"c{k} string" for k in range(len(names))), {"escape": '"'})
        found = lambda c: F.coalesce(parsed[f"c{at[c]}"], F.lit(""))  # noqa: E731, B023
        session = F.when(cells <= at["sessionId"], F.lit("unknown")).otherwise(found("sessionId"))
        one = F.struct(session.alias("session_id"), found("timestamp").alias("ts_raw"), F.lower(F.trim(found("role"))).alias("role"), found("content").alias("content"))
        row = F.when(F.col("header") == header, one) if row is None else row.when(F.col("header") == header, one)
    if row is None:
        return spark.createDataFrame([], "session_id string, ts_raw string, role string, content string, ingest_seq bigint")
    rows = lines.join(headers, "file").filter("n > header_n").select(row.alias("r"), "n").select("r.*", F.col("n").alias("ingest_seq"))
    return rows.filter(F.col("role").isin(*ROLES))


_MESSAGE = "struct<sessionId:string,timestamp:string,role:string,content:string>"


def _messages(records: DataFrame) -> DataFrame:
    """records: m (message struct), ingest_seq, nth (place in its file)."""
    rows = records.select(F.coalesce("m.sessionId", F.lit("json_session_001")).alias("session_id"), F.coalesce("m.timestamp", default_time(F.col("nth"))).alias("ts_raw"), F.lower("m.role").alias("role"), F.coalesce("m.content", F.lit("")).alias("content"), "ingest_seq")
    return rows.filter(F.col("role").isin(*ROLES))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A document that is a list of messages or holds one under messages; falls back to a message per line.

    A list at the top is read in as many tasks as its file has splits; a document of another form is one text.
    """
    elements, others = json_documents(spark, path)
    listed = elements.select(F.from_json("value", _MESSAGE).alias("m"), F.col("nth").cast("int").alias("nth"))
    docs = others.withColumn("messages", F.from_json("value", f"struct<messages:array<{_MESSAGE}>>")["messages"])
    good = docs.filter("messages is not null").select(F.posexplode("messages").alias("nth", "m"))
    many = F.col("messages").isNull() & F.trim("value").rlike(r"(?s)\}\s*\n\s*\{")
    lined = docs.filter(many).select(F.posexplode(F.split("value", r"\r?\n")).alias("nth", "line")).filter(F.trim("line") != "").select("nth", F.from_json("line", _MESSAGE).alias("m"))
    return _messages(listed.unionByName(good).unionByName(lined).withColumn("ingest_seq", F.col("nth").cast("bigint")))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    lines = numbered_lines(spark, path).filter(F.trim("line") != "")
    return _messages(lines.select(F.from_json("line", _MESSAGE).alias("m"), F.col("n").alias("nth"), F.col("n").alias("ingest_seq")))


_TIMED = r"(?i)^\[?(\d{4}-\d{2}-\d{2}T[\d:.+-]+Z?)\]?\s*(user|assistant|system)[:：]\s*(.+)$"
_SAID = r"(?i)^(user|assistant|system)[:：]\s*(.+)$"
_SESSION = r"^(?:## session:|\[session:)\s*(.*?)\]?\s*$"


def _text(spark: SparkSession, path: str, alternate: bool) -> DataFrame:
    """Headings hold until the next one: within a split by a window over it, at its start by what earlier splits of the file left."""
    lines = numbered_lines(spark, path).withColumn("line", F.trim(F.regexp_replace("line", "\r$", ""))).filter("line <> ''")
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]+$", "")
    named = F.when(F.col("line").rlike(_SESSION), F.trim(F.regexp_extract("line", _SESSION, 1)))
    here = F.last(named, ignorenulls=True).over(within_split().rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("here", here).join(carried_last(lines, named, "left"), KEY)
    lines = lines.withColumn("session_id", F.coalesce("here", "left", F.concat(stem, F.lit("_session")))).filter(~F.col("line").rlike(_SESSION))
    timed, said = F.col("line").rlike(_TIMED), F.col("line").rlike(_SAID)
    pick = lambda i, j: F.when(timed, F.regexp_extract("line", _TIMED, i)).when(said, F.regexp_extract("line", _SAID, j))
    rows = lines.select(*KEY, "at", "session_id", "n", "line", F.when(timed, F.regexp_extract("line", _TIMED, 1)).otherwise(default_time(F.col("n"))).alias("ts_raw"), F.lower(pick(2, 1)).alias("role"), pick(3, 2).alias("content"))
    if alternate:  # a file without a single marked line: its lines alternate between user and assistant
        marked = rows.groupBy("file").agg(F.max(F.col("role").isNotNull()).alias("marked"))
        nth = F.row_number().over(within_split()) - 1
        rows = rows.withColumn("nth", nth).join(carried_sum(rows, F.lit(1), "before"), KEY).join(marked, "file")
        turn = F.when(F.pmod(F.col("nth") + F.col("before"), F.lit(2)) == 0, "user").otherwise("assistant")
        rows = rows.withColumns({"role": F.when(F.col("marked"), F.col("role")).otherwise(turn), "content": F.when(F.col("marked"), F.col("content")).otherwise(F.col("line"))})
    return rows.filter("role is not null").select("session_id", "ts_raw", "role", "content", F.col("n").alias("ingest_seq"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return _text(spark, path, True)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    return _text(spark, path, False)


_DIALOGUE = "struct<dialogue_id:string,services:array<string>,turns:array<struct<speaker:string,utterance:string,frames:array<struct<service:string,actions:array<struct<act:string,slot:string>>,slots:array<struct<slot:string,start:int,exclusive_end:int>>,state:struct<active_intent:string,slot_values:map<string,array<string>>,requested_slots:array<string>>,service_call:struct<method:string,parameters:map<string,string>>,service_results:array<map<string,string>>>>>>>"


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """Schema-guided dialogues, as a list, under dialogues, or one at the root: dialogue struct and its place in its file."""
    elements, others = json_documents(spark, path)
    listed = elements.select("nth", F.from_json("value", _DIALOGUE).alias("dialogue"))
    one = F.from_json("value", _DIALOGUE)
    wrapped = F.from_json("value", f"struct<dialogues:array<{_DIALOGUE}>>")["dialogues"]
    rest = others.select(F.posexplode(F.coalesce(wrapped, F.when(one["dialogue_id"].isNotNull(), F.array(one)))).alias("nth", "dialogue"))
    found = listed.unionByName(rest.withColumn("nth", F.col("nth").cast("bigint")))
    return found.filter(F.col("dialogue.dialogue_id").isNotNull() & F.col("dialogue.turns").isNotNull())


def dialogue_turns(dialogues: DataFrame) -> DataFrame:
    """Turns of dialogues: SYSTEM speaks as assistant, empty utterances go, dialogue i is on day i and turn k in second k."""
    turns = dialogues.select("nth", "dialogue.dialogue_id", F.posexplode("dialogue.turns").alias("k", "t"))
    role = F.when(F.upper("t.speaker") == "USER", "user").when(F.upper("t.speaker") == "SYSTEM", "assistant")
    rows = turns.select(F.col("dialogue_id").alias("session_id"), default_time(F.col("nth") * 86_400 + F.col("k")).alias("ts_raw"), role.alias("role"), F.trim("t.utterance").alias("content"), (F.col("nth").cast("bigint") * 100_000 + F.col("k")).alias("ingest_seq"))
    return rows.filter("role is not null and coalesce(content, '') <> ''")


def dialogue_frames(dialogues: DataFrame) -> DataFrame:
    """Frames as the dialogue operators take them; turns count from 1."""
    turns = dialogues.select(F.col("dialogue.dialogue_id").alias("case_id"), F.posexplode("dialogue.turns").alias("k", "t"))
    f = turns.select("case_id", (F.col("k") + 1).alias("turn_index"), F.when(F.upper("t.speaker") == "USER", "user").otherwise("assistant").alias("role"), F.col("t.utterance").alias("utterance"), F.explode("t.frames").alias("f"))
    empty = lambda c: F.coalesce(F.col(c), F.array())
    params = F.transform_values(F.coalesce("f.service_call.parameters", F.create_map().cast("map<string,string>")), lambda _, v: F.coalesce(F.from_json(v, "array<string>"), F.array(v)))
    state = F.when(F.col("f.state").isNotNull(), F.struct(F.col("f.state.active_intent").alias("active_intent"), F.coalesce("f.state.slot_values", F.create_map().cast("map<string,array<string>>")).alias("slot_values"), F.coalesce("f.state.requested_slots", F.array().cast("array<string>")).alias("requested_slots")))
    return f.select("case_id", "turn_index", "role", "utterance", F.col("f.service").alias("service"), empty("f.actions").alias("actions"), empty("f.slots").alias("slots"), state.alias("state"), F.when(F.col("f.service_call").isNotNull(), F.struct(F.col("f.service_call.method").alias("method"), params.alias("parameters"))).alias("call"), F.coalesce(F.size("f.service_results"), F.lit(0)).alias("results"))


_SERVICE = "array<struct<service_name:string,description:string,intents:array<struct<name:string>>,slots:array<struct<name:string>>>>"


def read_schema(spark: SparkSession, path: str) -> DataFrame:
    """service, seq, description, intents, slots of the services in a file: under schema, schema.services or services, or a bare list.

    The first of these places that holds a service counts; a record without name, intents or slots is none. Of a service
    that comes again the first record stays.
    """
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"), F.input_file_name().alias("file"))
    at = lambda place: F.filter(F.from_json(F.to_json(F.try_variant_get("v", place, "variant")), _SERVICE), lambda s: s["service_name"].isNotNull() & s["intents"].isNotNull() & s["slots"].isNotNull())
    places = F.array(*[at(p) for p in ("$", "$.schema", "$.schema.services", "$.services")])
    found = F.get(F.filter(places, lambda x: F.size(F.coalesce(x, F.array().cast(_SERVICE))) > 0), F.lit(0))
    rows = whole.select("file", F.posexplode(found).alias("at", "s")).select("file", "at", F.col("s.service_name").alias("service"), "s.description", F.transform("s.intents", lambda x: x["name"]).alias("intents"), F.transform("s.slots", lambda x: x["name"]).alias("slots"))
    first = rows.groupBy("service").agg(F.min_by(F.struct("at", "description", "intents", "slots"), F.struct("file", "at")).alias("r"))
    return first.select("service", F.col("r.at").alias("seq"), "r.description", "r.intents", "r.slots")


def used_schema(schema: DataFrame, dialogues: DataFrame) -> DataFrame:
    return schema.join(dialogues.select(F.explode("dialogue.services").alias("service")).distinct(), "service", "left_semi")


_TURN_LINE = r"^\[turn (\d+)\] \[(user|assistant|system)\] (.*)$"


def reparse_transcripts(cases: DataFrame, mode: str = "skip") -> DataFrame:
    """cases: case_id, transcript, case_index. Rows of '[turn n] [role] text' lines.

    mode: skip (other lines go, a minute a line), replay (they go; the case's own minute), or user (they are user lines).
    """
    lines = cases.select("case_id", "case_index", F.posexplode(F.split("transcript", "\n")).alias("k", "line")).filter(F.trim("line") != "")
    fits = F.col("line").rlike(_TURN_LINE)
    lines = lines if mode == "user" else lines.filter(fits)
    minute = F.col("case_index") if mode == "replay" else F.col("k")
    return lines.select(F.col("case_id").alias("session_id"), default_time(minute * 60 + (F.col("k") if mode == "replay" else F.lit(0))).alias("ts_raw"), F.when(fits, F.regexp_extract("line", _TURN_LINE, 2)).otherwise("user").alias("role"), F.when(fits, F.regexp_extract("line", _TURN_LINE, 3)).otherwise(F.col("line")).alias("content"), F.col("k").cast("bigint").alias("ingest_seq"))
