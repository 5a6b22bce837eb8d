"""Queries of readers, writers and stores: the driver tables are written in a format to the shared folder and read back."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from confera.functions.lexicon import SYNTHETIC
from confera.operators import dialogue, store, traces
from confera.plans.evaluate import Evaluation, enrich
from confera.plans.registry import query, r, raw_turns, scratch, table, unit
from confera.sources import mapping, readers, runs

#: The day and second that a dialogue and its turn stand at, in the SQL.
_ISO = "strftime(make_timestamp((1577836800 + {}) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
_TURNS = "t as (select conv_id, turn, conv_id::varchar as session_id, role, trim(text) as content from conversations)"
_LINES = _TURNS.replace("trim(text)", "replace(trim(text), chr(10), ' ')")


def said(spark, sf_dir):
    """conversations as canonical rows, with a time of a second a turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_seq"), F.col("conv_id").cast("string").alias("session_id"), (F.col("turn") + 1).cast("int").alias("turn_index"), readers.default_time(F.col("turn")).alias("timestamp"), "role", F.trim("text").alias("content"))


def on_one_line(turns):
    """For formats of a line a turn."""
    return turns.withColumn("content", F.translate("content", "\n", " "))


def framed(lines, head=None, between="", tail=None):
    """value: the lines of each partition, which becomes a file, between a first and a last line; `between` starts all lines but the first."""

    def frame(batches):
        if head is not None:
            yield pd.DataFrame({"value": [head]})
        first = True
        for batch in batches:
            if len(batch):
                out = (between + batch["value"]).where([False] * first + [True] * (len(batch) - first), batch["value"])
                first = False
                yield pd.DataFrame({"value": out})
        if tail is not None:
            yield pd.DataFrame({"value": [tail]})

    return lines.select("value").mapInPandas(frame, "value string")


@query(f"""with {_LINES} select case when conv_id % 2 = 1 and conv_id % 5 = 1 then 'unknown' when conv_id % 2 = 1 and conv_id % 5 = 2 then '' else session_id end as session_id,
    {_ISO.format('turn')} as ts_raw, role, content from t""")
def read_csv_turns(spark, sf_dir):
    """A row is a line. Even sessions as the canonical CSV; odd ones in files of other headers, by column order, with cells
    after the session or not, with sessions that are empty and rows that end before the session's cell."""
    path = scratch(spark)
    rows = on_one_line(said(spark, sf_dir))
    store.write_canonical_csv(rows.filter("session_seq % 2 = 0"), f"{path}/even.csv")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    odd, k = rows.filter("session_seq % 2 = 1"), F.col("session_seq") % 5
    name = F.when(k == 2, "").otherwise(F.col("session_id"))
    plain = odd.filter(k <= 2).select("session_seq", "turn_index", F.concat_ws(",", quoted(F.col("content")), F.concat(F.lit(" "), F.upper("role")), "timestamp", F.when(k != 1, name)).alias("value"))
    more = odd.filter(k > 2).select("session_seq", "turn_index", F.concat_ws(",", "timestamp", F.lit("extra"), quoted(F.col("session_id")), "role", quoted(F.col("content"))).alias("value"))
    for part, lines, head in (("short", plain, "content, role,timestamp,sessionId"), ("long", more, "\ufefftimestamp,note,sessionId,role,content")):
        framed(lines.repartition("session_seq").sortWithinPartitions("session_seq", "turn_index"), head).write.text(f"{path}/{part}.csv")
    return readers.read_logs(spark, f"{path}/*.csv").select("session_id", "ts_raw", "role", "content")


def _message():
    return F.struct(F.col("session_id").alias("sessionId"), "timestamp", F.upper("role").alias("role"), "content")


@query(f"with {_TURNS} select session_id, {_ISO.format('turn')} as ts_raw, role, content from t")
def read_jsonl_turns(spark, sf_dir):
    path = scratch(spark) + ".jsonl"
    store.write_jsonl(said(spark, sf_dir).select(F.col("session_id").alias("sessionId"), "timestamp", F.upper("role").alias("role"), "content"), path)
    return readers.read_logs(spark, path).select("session_id", "ts_raw", "role", "content")


def _in_order(rows):
    """rows with nth: their place in their session."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("session_id").orderBy("ingest_seq")))


@query(f"with {_TURNS} select session_id, {_ISO.format('turn')} as ts_raw, role, content, (row_number() over (partition by conv_id order by turn))::int as nth from t")
def read_json_turns(spark, sf_dir):
    """Files of many sessions: those of even ones a list of messages each, the others an object that holds the list."""
    path = scratch(spark)
    rows = said(spark, sf_dir).select("session_seq", "turn_index", F.to_json(_message()).alias("value"))
    for odd, head, tail in ((0, "[", "]"), (1, '{"made by": {"a": ["}"]}, "messages": [', "]}")):
        mine = rows.filter(F.col("session_seq") % 2 == odd).repartition("session_seq").sortWithinPartitions("session_seq", "turn_index")
        framed(mine, head, ",", tail).write.text(f"{path}/{odd}.json")
    return _in_order(readers.read_json(spark, f"{path}/*.json")).select("session_id", "ts_raw", "role", "content", "nth")


@query(f"""with {_LINES}, k as (select *, (row_number() over (partition by conv_id order by turn))::int as nth from t)
select 'named ' || session_id as session_id, nth, case when nth % 2 = 1 then {_ISO.format('turn')} end as ts_raw, role, content from k""")
def read_text_turns(spark, sf_dir):
    """Texts of many sessions: a heading, then lines with and without a time in turn; times that a line lacks are left out here."""
    path = scratch(spark)
    nth = F.row_number().over(Window.partitionBy("session_seq").orderBy("turn_index"))
    turns = on_one_line(said(spark, sf_dir)).withColumn("nth", nth)
    line = F.when(F.col("nth") % 2 == 1, F.concat(F.lit("["), "timestamp", F.lit("] "), "role", F.lit(": "), "content")).otherwise(F.concat(F.upper("role"), F.lit("： "), "content"))
    head = F.concat(F.when(F.col("session_seq") % 2 == 0, "## session: named ").otherwise("[session: named "), F.col("session_seq").cast("string"), F.when(F.col("session_seq") % 2 == 1, "]").otherwise(""))
    # A heading comes from the row of its first line: of a union, repartition() may leave the sides in partitions of their own.
    ordered = turns.repartition("session_seq").sortWithinPartitions("session_seq", "nth")
    ordered.select(F.explode(F.when(F.col("nth") == 1, F.array(head, line)).otherwise(F.array(line))).alias("value")).write.text(path)
    back = _in_order(readers.read_text(spark, path))
    return back.select("session_id", "nth", F.when(F.col("nth") % 2 == 1, F.col("ts_raw")).alias("ts_raw"), "role", "content")


@query(f"with {_TURNS} select session_id, {_ISO.format('turn')} as ts_raw, role, content from t")
def mapped_turns(spark, sf_dir):
    """An upload of other column names: the mapping is found from the schema and applied."""
    other = said(spark, sf_dir).select(F.col("session_id").alias("conversationId"), F.col("timestamp").alias("createdAt"), F.when(F.col("role") == "user", "Customer").when(F.col("role") == "assistant", "BOT").otherwise(F.col("role")).alias("speaker"), F.col("content").alias("utterance"))
    return mapping.apply_mapping(other, mapping.infer_mapping(other.schema)).select("session_id", "ts_raw", "role", "content")


@query(f"with {_TURNS} select session_id, {_ISO.format('turn')} as ts_raw, role, content from t")
def mapped_messages(spark, sf_dir):
    """An upload of nested messages, whose session stands in the record above them."""
    nested = said(spark, sf_dir).groupBy(F.col("session_id").alias("thread_id")).agg(F.array_sort(F.collect_list(F.struct("turn_index", F.col("role").alias("sender"), F.col("content").alias("body")))).alias("messages"))
    return mapping.apply_mapping(nested, mapping.infer_mapping(nested.schema)).select("session_id", "ts_raw", "role", "content")


@query("""with t as (select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as k, role, replace(text, chr(10), ' ') as text from conversations where trim(text) <> '')
select 'case ' || conv_id as session_id, role, text as content, k as ingest_seq, strftime(make_timestamp((1577836800 + k * 60) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as ts_raw from t""")
def reparsed_transcripts(spark, sf_dir):
    """Transcripts of stored cases, read back as turns."""
    line = F.concat(F.lit("[turn "), "turn_index", F.lit("] ["), "role", F.lit("] "), "content")
    cases = on_one_line(raw_turns(spark, sf_dir)).filter(F.trim("content") != "").groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", line.alias("l")))), lambda x: x["l"]), "\n").alias("transcript"))
    return readers.reparse_transcripts(cases.select(F.concat(F.lit("case "), "session_id").alias("case_id"), F.lit(0).alias("case_index"), "transcript")).select("session_id", "role", "content", "ingest_seq", "ts_raw")


# ---- dialogues -------------------------------------------------------------------------------------------------------


def dialogues(spark, sf_dir):
    """conversations as schema-guided dialogues, written as JSON in files of many sessions, lists and lists within an object, and read back.

    By a fixed rule a turn is a frame of service s<conv mod 3>, with an action, the span of its first word as a slot, a state
    at users' turns, and at every other assistant's turn a call with a result in two of three.
    """
    n, k = F.col("conv_id"), F.col("turn")
    service = F.concat(F.lit("s"), (n % 3).cast("string"))
    word = F.regexp_extract("text", r"^(\S*)", 1)
    user = F.col("role") == "user"
    slot = F.concat(F.lit("slot"), (k % 3).cast("string"))
    act = F.when(user, "INFORM").when(k % 4 == 1, "OFFER").otherwise("REQUEST")
    state = F.when(user, F.struct(F.when(n % 4 != 0, F.lit("FindThing")).otherwise("NONE").alias("active_intent"), F.map_from_arrays(F.array(slot), F.array(F.array(word))).alias("slot_values"), F.array(F.lit("price")).alias("requested_slots")))
    called = ~user & (F.floor(k / 2) % 2 == 1)
    call = F.when(called, F.struct(F.when(n % 2 == 0, "ReserveThing").otherwise("FindThing").alias("method"), F.map_from_arrays(F.array(F.concat(F.lit("slot"), ((k - 1) % 3).cast("string"))), F.array(F.lit("x"))).alias("parameters")))
    results = F.when(called & (n % 3 != 0), F.array(F.create_map(F.lit("a"), F.lit("b"))))
    frame = F.struct(service.alias("service"), F.array(F.struct(act.alias("act"), slot.alias("slot"))).alias("actions"), F.array(F.struct(slot.alias("slot"), F.lit(0).alias("start"), F.length(word).alias("exclusive_end"))).alias("slots"), state.alias("state"), call.alias("service_call"), results.alias("service_results"))
    turn = F.struct(F.when(user, "USER").otherwise("SYSTEM").alias("speaker"), F.col("text").alias("utterance"), F.array(frame).alias("frames"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", service.alias("service"), turn.alias("t"))
    whole = rows.groupBy("conv_id", "service").agg(F.array_sort(F.collect_list(F.struct("turn", F.to_json("t").alias("j")))).alias("l"))
    text = F.concat(F.lit('{"dialogue_id": "d'), F.col("conv_id").cast("string"), F.lit('", "services": ["'), "service", F.lit('"], "turns": ['), F.array_join(F.transform("l", lambda x: x["j"]), ","), F.lit("]}"))
    path = scratch(spark)
    for odd, head, tail in ((0, "[", "]"), (1, '{"dialogues": [', "]}")):
        mine = whole.filter(F.col("conv_id") % 2 == odd).select("conv_id", text.alias("value")).repartition("conv_id")
        framed(mine, head, ",", tail).write.text(f"{path}/{odd}")
    return readers.read_dialogues(spark, f"{path}/*").checkpoint()  # scratch() has set the folder; several operators read it


_SGD = """c as (select 'd' || conv_id as case_id, conv_id as n, turn as k, row_number() over (partition by conv_id order by turn)::int as turn_index, 's' || (conv_id % 3) as service, role = 'user' as u, text, regexp_extract(text, '^(\\S*)', 1) as word from conversations),
f as (select *, 'slot' || (k % 3) as slot, case when u then 'INFORM' when k % 4 = 1 then 'OFFER' else 'REQUEST' end as act, not u and (k // 2) % 2 = 1 as called, case when n % 2 = 0 then 'ReserveThing' else 'FindThing' end as method, 'slot' || ((k - 1) % 3) as param from c)"""


@query(f"with {_SGD} select case_id as session_id, case when u then 'user' else 'assistant' end as role, trim(text) as content from f where trim(text) <> ''")
def dialogue_turns(spark, sf_dir):
    return readers.dialogue_turns(dialogues(spark, sf_dir)).select("session_id", "role", "content")


@query(f"with {_SGD} select case_id, turn_index, case when u then 'user' else 'assistant' end as role, service, act, slot from f")
def dialogue_actions(spark, sf_dir):
    return dialogue.actions(readers.dialogue_frames(dialogues(spark, sf_dir)))


@query(f"with {_SGD} select case_id, turn_index, service, slot, word as value from f where word <> ''")
def dialogue_slot_mentions(spark, sf_dir):
    return dialogue.slot_mentions(readers.dialogue_frames(dialogues(spark, sf_dir)))


@query(f"with {_SGD} select case_id, turn_index, service, case when n % 4 <> 0 then 'FindThing' else 'NONE' end as active_intent, slot as state_slot, word as state_value from f where u")
def dialogue_states(spark, sf_dir):
    s = dialogue.states(readers.dialogue_frames(dialogues(spark, sf_dir)))
    return s.select("case_id", "turn_index", "service", "active_intent", F.explode("slot_values").alias("state_slot", "v")).select("case_id", "turn_index", "service", "active_intent", "state_slot", F.col("v")[0].alias("state_value"))


@query(f"with {_SGD} select case_id, turn_index, service, method, exists (select 1 from f g where g.case_id = f.case_id and g.service = f.service and not g.u and g.act = 'OFFER' and g.turn_index < f.turn_index) as confirmed from f where called and method = 'ReserveThing'")
def confirmed_calls(spark, sf_dir):
    """Transactional calls, and whether the assistant had offered or confirmed before."""
    frames = readers.dialogue_frames(dialogues(spark, sf_dir))
    return dialogue.confirmed_calls(dialogue.calls(frames), frames).select("case_id", "turn_index", "service", "method", "confirmed")


_SCHEMA = [("s0", ["FindThing"], ["slot0", "slot1", "price"]), ("s1", ["ReserveThing"], ["slot0", "slot2", "price"]), ("s0", ["Other"], ["none"])]


def schema_rows(spark):
    """The services that the dialogues may name, as a file under schema.services, read back."""
    path = scratch(spark)
    text = json.dumps({"schema": {"services": [{"service_name": s, "description": "d", "intents": [{"name": i} for i in intents], "slots": [{"name": x} for x in slots]} for s, intents, slots in _SCHEMA] + [{"service_name": "broken"}]}})
    spark.range(1).select(F.lit(text).alias("value")).write.text(path)
    return readers.read_schema(spark, path)


@query("""with s as (select s_suppkey as k, s_suppkey % 4 as form, s_suppkey // 400 as part, row_number() over (partition by s_suppkey % 4, s_suppkey // 400 order by s_suppkey) as i from supplier),
a as (select *, sum((k % 10 = 0)::int) over (partition by form, part order by i rows between unbounded preceding and 1 preceding) as again from s)
select 's' || k as service, (i - 1 + coalesce(again, 0))::int as seq, 'Find' || k % 5 as intents, 'slot' || k % 3 || ',price' as slots from a""")
def schema_locations(spark, sf_dir):
    """suppliers as services, in files of each place where a schema may stand; every tenth comes twice, the second one other."""
    k = F.col("s_suppkey")
    one = lambda name: F.struct(F.concat(F.lit("s"), k.cast("string")).alias("service_name"), F.lit("d").alias("description"), F.array(F.struct(F.concat(F.lit(name), (k % 5).cast("string")).alias("name"))).alias("intents"), F.array(F.struct(F.concat(F.lit("slot"), (k % 3).cast("string")).alias("name")), F.struct(F.lit("price").alias("name"))).alias("slots"))
    rows = table(spark, sf_dir, "supplier").select(k, F.explode(F.when(k % 10 == 0, F.array(one("Find"), one("Other"))).otherwise(F.array(one("Find")))).alias("s"))
    rows = rows.withColumn("nth", (F.col("s.intents")[0]["name"].startswith("Other")).cast("int"))
    files = rows.groupBy((k % 4).alias("form"), F.floor(k / 400).alias("part")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "nth", "s"))), lambda x: x["s"])).alias("j"))
    around = lambda head, tail: F.concat(F.lit(head), "j", F.lit(tail))
    text = F.when(F.col("form") == 0, F.col("j")).when(F.col("form") == 1, around('{"schema": ', "}")).when(F.col("form") == 2, around('{"schema": {"services": ', "}}")).otherwise(around('{"services": ', "}"))
    path = scratch(spark)
    files.select("form", "part", text.alias("value")).write.partitionBy("form", "part").text(path)
    return readers.read_schema(spark, path).select("service", "seq", F.array_join("intents", ",").alias("intents"), F.array_join("slots", ",").alias("slots"))


@query(f"""with {_SGD} select unnest(['basic_chat', 'schema_aware', 'slot_eval', 'state_tracking', 'service_call_eval', 'service_result_grounding', 'actual_tool_trace_eval', 'benchmark_gold_eval']) as capability,
    unnest([count(*) > 0, false, count(*) > 0, coalesce(bool_or(u), false), coalesce(bool_or(called), false), coalesce(bool_or(called and n % 3 <> 0), false), false, coalesce(bool_or(called), false)]) as enabled from f""")
def capabilities(spark, sf_dir):
    """What the dialogues can be evaluated for, by the annotations that any of their frames has."""
    f = readers.dialogue_frames(dialogues(spark, sf_dir))
    held = {"messages.role": F.col("role"), "messages.content": F.col("utterance"), "annotations.dialogueStates": F.col("state"), "annotations.serviceCalls": F.col("call"), "annotations.serviceResults": F.when(F.col("results") > 0, 1), "annotations.slotMentions": F.when(F.size("slots") > 0, 1)}
    counts = f.agg(*[F.count(c).alias(name) for name, c in held.items()]).first()
    found, _, _ = mapping.capability_report({name for name in held if counts[name]})
    return spark.createDataFrame(list(found.items()), "capability string, enabled boolean")


_REFS = """refs as (select case_id, service, slot from f union all select case_id, service, slot from f where word <> '' union all select case_id, service, slot from f where u union all select case_id, service, 'price' from f where u union all select case_id, service, param from f where called)"""
_KNOWN = "known as (select * from (values ('s0', 'slot0'), ('s0', 'slot1'), ('s0', 'price'), ('s1', 'slot0'), ('s1', 'slot2'), ('s1', 'price')) v(service, slot))"


@query(f"with {_SGD}, {_REFS} select service, slot, count(*) as mentions from refs group by 1, 2")
def slot_references(spark, sf_dir):
    refs = dialogue.slot_references(readers.dialogue_frames(dialogues(spark, sf_dir)))
    return refs.groupBy("service", "slot").agg(F.count(F.lit(1)).alias("mentions"))


@query(f"""with {_SGD}, {_REFS}, {_KNOWN}, sv as (select distinct service from f), st as (select * from f where u), ca as (select * from f where called), inn as (select * from st where n % 4 <> 0),
gr as (select ca.*, (select arg_max(struct_pack(s := st.slot, w := st.word), st.turn_index) from st where st.case_id = ca.case_id and st.service = ca.service and st.turn_index <= ca.turn_index) as s from ca),
cf as (select exists (select 1 from f g where g.case_id = ca.case_id and g.service = ca.service and not g.u and g.act = 'OFFER' and g.turn_index < ca.turn_index) as ok from ca where method = 'ReserveThing'),
res as (select distinct turn_index, service from f where called and n % 3 <> 0),
o as (select 'case_count' as metric, count(distinct case_id)::double as value from f union all select 'service_count', count(distinct service) from f union all select 'frame_count', count(*) from f union all select 'action_count', count(*) from f
    union all select 'dialogue_state_count', count(*) from st union all select 'service_call_count', count(*) from ca union all select 'service_result_count', count(*) from f where called and n % 3 <> 0 union all select 'slot_mention_count', count(*) from f where word <> ''
    union all select 'schema_service_count', 2 union all select 'schema_intent_count', 2 union all select 'schema_slot_count', 6
    union all select 'schema_service_coverage_rate', {r("coalesce(avg((service in ('s0', 's1'))::int), 1)", 4)} from sv union all select 'unknown_schema_service_references', count(*) from sv where service not in ('s0', 's1')
    union all select 'schema_intent_coverage_rate', {r("coalesce(avg((service = 's0')::int), 1)", 4)} from inn union all select 'unknown_schema_intent_references', count(*) from inn where service <> 's0'
    union all select 'schema_slot_coverage_rate', {r("coalesce(avg((k.slot is not null)::int), 1)", 4)} from refs left join known k using (service, slot) union all select 'unknown_schema_slot_references', count(*) from refs left join known k using (service, slot) where k.slot is null
    union all select 'intent_coverage_rate', {r("coalesce(avg((n % 4 <> 0)::int), 0)", 4)} from st union all select 'state_slot_coverage_rate', case when count(*) > 0 then 1 else 0 end from st
    union all select 'service_call_grounding_rate', {r("coalesce(avg(case when s is not null and s.s = param and s.w = 'x' then 1 else 0 end), 0)", 4)} from gr
    union all select 'service_result_availability_rate', {r("coalesce(avg((exists (select 1 from res where res.turn_index = ca.turn_index and res.service = ca.service))::int), 0)", 4)} from ca
    union all select 'transactional_confirmation_rate', {r("coalesce(avg(ok::int), 1)", 4)} from cf)
select * from o""")
def structured_metrics(spark, sf_dir):
    """Every count and rate of the dialogues, against a schema that lacks a service, intents and slots."""
    return dialogue.structured_metrics(readers.dialogue_frames(dialogues(spark, sf_dir)), schema_rows(spark))


# ---- runs and traces -------------------------------------------------------------------------------------------------


def run_trees(spark, sf_dir):
    """events of ten minutes of a user as a tree: the first is the root, the others its children, the last a grandchild."""
    e = table(spark, sf_dir, "events").withColumn("tree", F.concat_ws("-", "user_id", F.floor(F.col("event_id") / 50)))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("llm", "tool", "retriever", "chain", "odd")]), (F.col("event_id") % 5 + 1).cast("int"))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    run = F.to_json(F.struct(F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("name"), kind.alias("run_type"), ms.alias("start_time"), (ms + 5).alias("end_time"), F.when(F.col("event_id") % 7 == 0, "boom").alias("error")))
    l = e.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("event_id", run.alias("j")))).alias("l"))  # noqa: E741
    child = lambda x, kids: F.concat(F.substr(x, F.lit(1), F.length(x) - 1), F.lit(', "child_runs": ['), kids, F.lit("]}"))
    last = F.when(F.size("l") > 2, F.col("l")[F.size("l") - 1]["j"]).otherwise("")
    middle = F.transform(F.slice("l", 2, F.when(F.size("l") > 2, F.size("l") - 2).otherwise(F.size("l"))), lambda x: x["j"])
    kids = F.transform(middle, lambda x, i: F.when((i == 0) & (last != ""), child(x, last)).otherwise(x))
    return l.select(child(F.col("l")[0]["j"], F.array_join(kids, ",")).alias("root"))


@query("""with e as (select *, user_id || '-' || (event_id // 50) as tree from events), k as (select *, row_number() over (partition by tree order by event_id) as i, count(*) over (partition by tree) as n from e),
p as (select *, first_value(event_id) over (partition by tree order by i) as root, max(case when i = 2 then event_id end) over (partition by tree) as second from k)
select 'r' || event_id as span_id, case when i = 1 then null when i = n and n > 2 then 'r' || second else 'r' || root end as parent_id, 'r' || root as trace_id, event_type as name,
    case event_id % 5 when 0 then 'chat' when 1 then 'tool' when 2 then 'retrieval' when 3 then 'agent' else 'custom' end as kind, case when event_id % 7 = 0 then 'error' else 'ok' end as status, epoch_us(ts) // 1000 as start_ms, epoch_us(ts) // 1000 + 5 as end_ms from p""")
def flattened_runs(spark, sf_dir):
    """Run trees as spans."""
    return runs.run_spans(runs.flatten_runs(run_trees(spark, sf_dir))).drop("input", "output")


@query("""with e as (select *, user_id || '-' || (event_id // 50) as tree from events), k as (select *, row_number() over (partition by tree order by event_id) as i, count(*) over (partition by tree) as n from e)
select 'r' || event_id as id, (case when i <= 2 then i - 1 when i = n then 2 else i end)::int as place, (case when i = 1 then 0 when i = n and n > 2 then 2 else 1 end)::int as depth from k""")
def run_order(spark, sf_dir):
    """Where the runs of a tree stand in pre-order, and how deep."""
    return runs.flatten_runs(run_trees(spark, sf_dir)).select("id", "place", "depth")


@query("""with k as (select *, row_number() over (partition by user_id order by event_id) as i from events)
select 'r' || event_id as id, 'r' || lag(event_id) over w as parent_run_id, 'r' || first_value(event_id) over w as trace_id, event_type as name, (i - 1)::int as depth, event_id % 3 || '{"[' as outputs from k window w as (partition by user_id order by i)""")
def run_chains(spark, sf_dir):
    """All events of a user as one chain of runs, each the only child of the one before."""
    e = table(spark, sf_dir, "events")
    out = F.concat((F.col("event_id") % 3).cast("string"), F.lit('{"['))
    head = F.to_json(F.struct(F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("name"), out.alias("outputs")))
    opened = F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(', "child_runs": ['))
    l = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", opened.alias("j")))).alias("l"))  # noqa: E741
    root = F.concat(F.array_join(F.transform("l", lambda x: x["j"]), ""), F.repeat(F.lit("]}"), F.size("l")))
    return runs.flatten_runs(l.select(root.alias("root"))).select("id", "parent_run_id", "trace_id", "name", "depth", "outputs")


def trace_lines(spark, sf_dir):
    """events as traces of one span, a JSON line each; by fixed rules some are broken, and every seventh comes twice."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    name = lambda p: F.concat(F.lit(p), n.cast("string"))
    time = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    kind = F.when(n % 13 == 0, "odd").when(n % 2 == 0, "chat").otherwise("tool")
    span = F.struct(F.when(n % 11 != 0, name("s")).alias("spanId"), F.col("event_type").alias("name"), kind.alias("kind"), time.alias("startTime"), F.when(n % 5 == 0, "error").alias("status"), F.struct(F.col("value").alias("value")).alias("input"))
    trace = F.to_json(F.struct(name("t").alias("traceId"), F.when(n % 3 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("sessionId"), F.array(span).alias("spans")))
    line = F.when(n % 17 == 0, F.substr(trace, F.lit(1), F.length(trace) - 3)).when(n % 19 == 0, F.replace(trace, F.lit('"traceId":"'), F.lit('"traceId":7,"was":"'))).otherwise(trace)
    return e.select(F.explode(F.when(n % 7 == 0, F.array(line, line)).otherwise(F.array(line))).alias("value"))


def taken_in(spark, sf_dir, name):
    """Traces written as files, taken in by a stream that ends with them."""
    path = scratch(spark)
    trace_lines(spark, sf_dir).write.text(f"{path}/in")
    for stream in runs.ingest_stream(spark.readStream.text(f"{path}/in"), path, late="30 days"):
        stream.awaitTermination()
    return spark.read.parquet(f"{path}/{name}")


@query("""select 's' || event_id as span_id, case when event_id % 3 = 0 then 'u' || user_id else 't' || event_id end as trace_id, event_type as name, case when event_id % 2 = 0 then 'chat' else 'tool' end as kind,
    case when event_id % 5 = 0 then 'error' else 'ok' end as status, epoch_us(date_trunc('second', ts)) // 1000 as start_ms from events where event_id % 11 <> 0 and event_id % 13 <> 0 and event_id % 17 <> 0 and event_id % 19 <> 0""")
def streamed_spans(spark, sf_dir):
    """Spans that pass, each once."""
    return taken_in(spark, sf_dir, "spans").select("span_id", "trace_id", "name", "kind", "status", "start_ms")


@query("""with r as (select event_id, case when event_id % 17 = 0 then 'json' else concat_ws(',', case when event_id % 19 = 0 then 'traceId:type' end, case when event_id % 11 = 0 then 'spans[0].spanId:missing' end, case when event_id % 13 = 0 then 'spans[0].kind:value' end) end as reasons from events)
select reasons, sum(case when event_id % 7 = 0 then 2 else 1 end)::bigint as lines from r where reasons <> '' group by 1""")
def refused_traces(spark, sf_dir):
    """Lines that don't pass, by all that is wrong with them."""
    return taken_in(spark, sf_dir, "refused").groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("lines"))


def mixed_records(spark, sf_dir):
    """conversations as JSON records of mixed types, a few of them broken, by fixed rules."""
    c, n = table(spark, sf_dir, "conversations"), F.col("conv_id") + F.col("turn")
    at = F.when(n % 3 == 0, F.to_json(F.struct(F.col("turn").alias("x")))).when(n % 3 == 1, F.col("turn").cast("string")).otherwise(F.concat(F.lit('"t'), F.col("turn").cast("string"), F.lit('"')))
    said = F.to_json(F.struct("role", F.array(F.struct(F.col("text").alias("part"), F.lit(None).cast("boolean").alias("last")), F.struct(F.lit(None).cast("string").alias("part"), F.lit(True).alias("last"))).alias("content"), F.when(n % 5 == 0, F.lit("x")).alias("note")))
    record = F.concat(F.lit('{"at": '), at, F.lit(', "said": '), said, F.when(n % 4 == 0, F.lit(', "gone": null')).otherwise(""), F.lit("}"))
    return c.select(F.when(n % 50 == 7, F.lit("{broken")).otherwise(record).alias("value"))


@query(f"""with c as (select conv_id + turn as n from conversations), g as (select * from c where n % 50 <> 7), total as (select count(*) as t from g),
p as (select unnest([{{'p': '$', 't': 'object'}}, {{'p': '$.at', 't': case n % 3 when 0 then 'object' when 1 then 'number' else 'string' end}}, {{'p': case when n % 3 = 0 then '$.at.x' end, 't': 'number'}}, {{'p': '$.said', 't': 'object'}}, {{'p': '$.said.role', 't': 'string'}},
    {{'p': '$.said.content', 't': 'array'}}, {{'p': '$.said.content[*]', 't': 'object'}}, {{'p': '$.said.content[*].part', 't': 'string'}}, {{'p': '$.said.content[*].last', 't': 'boolean'}}, {{'p': case when n % 5 = 0 then '$.said.note' end, 't': 'string'}}, {{'p': case when n % 4 = 0 then '$.gone' end, 't': 'null'}}]) as x from g)
select x.p as path, x.t as type, count(*) as records, {r('count(*) / any_value(t)::double', 4)} as coverage from p, total where x.p is not null group by 1, 2 union all select '', 'unparsed', count(*), null from c where n % 50 = 7 having count(*) > 0""")
def profiled_values(spark, sf_dir):
    """Paths of the records, with the types that their values have and how many hold them."""
    return mapping.value_profile(mixed_records(spark, sf_dir))


def chats(spark, sf_dir):
    """Each conversation as a trace: a retrieval, then a chat of each user's turn with the answer after it, then a tool."""
    c = table(spark, sf_dir, "conversations")
    after = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumns({"next_role": F.lead("role").over(after), "next_text": F.lead("text").over(after)}).filter("role = 'user'")
    n, k = F.col("conv_id"), F.col("turn")
    ms = n * 100_000 + k * 1000
    name = lambda p: F.concat(F.lit(p), F.concat_ws("-", "conv_id", "turn"))
    ask = F.when(k % 2 == 0, F.to_json(F.struct(F.array(F.struct(F.col("role"), F.col("text").alias("content"))).alias("messages")))).otherwise(F.to_json(F.struct(F.col("text").alias("input"))))
    answer = F.when(F.col("next_role") == "assistant", F.to_json(F.struct(F.array(F.struct(F.struct(F.col("next_text").alias("content")).alias("message"))).alias("choices"))))
    none = F.lit(None).cast("string")
    span = lambda p, kind, at, i, o, status: F.struct(name(p).alias("span_id"), n.cast("string").alias("trace_id"), F.lit(f"{kind}-name").alias("name"), F.lit(kind).alias("kind"), at.alias("start_ms"), (at + 10).alias("end_ms"), i.alias("input"), o.alias("output"), status.alias("status"))
    docs = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("page_content")), F.struct(F.concat(F.lit("about "), "text").alias("page_content"))).alias("documents")))
    ok = F.when(k % 3 == 0, "error").when(k % 3 == 1, "warning").otherwise("ok")
    spans = F.array(span("r", "retrieval", ms, none, docs, F.lit("ok")), span("c", "chat", ms + 100, ask, answer, F.lit("ok")), span("t", "tool", ms + 200, F.to_json(F.struct(F.struct(k.cast("string").alias("q")).alias("arguments"))), none, ok))
    return c.select(F.explode(spans).alias("s")).select("s.*")


_CHATS = """c as (select conv_id as n, turn as k, role, text, lead(role) over w as nr, lead(text) over w as nt from conversations window w as (partition by conv_id order by turn)),
u as (select *, n::varchar as trace_id, 'c' || n || '-' || k as chat, n * 100000 + k * 1000 as ms, nr = 'assistant' and nt <> '' and text <> '' as pair from c where role = 'user'),
b as (select *, coalesce(sum(coalesce(pair, false)::int) over (partition by n order by k rows between unbounded preceding and 1 preceding), 0)::bigint as before from u)"""


@query(f"with {_CHATS} select trace_id as session_id, ms + 100 as ts_ms, 'user' as role, text as content, chat as span_id from u where text <> '' union all select trace_id, ms + 110, 'assistant', nt, chat from u where nr = 'assistant' and nt <> ''")
def projected_rows(spark, sf_dir):
    """Chat spans as turns."""
    return traces.project(chats(spark, sf_dir))["rows"].drop("pos")


@query(f"""with {_CHATS} select b.trace_id, b.chat as span_id, b.before as turn_index, md5(b.text) as query, md5(b.nt) as response,
    (select count(*) * 2 from u d where d.n = b.n and d.ms + 10 <= b.ms + 100)::bigint as documents from b where pair""")
def projected_contexts(spark, sf_dir):
    """Each answered chat with the number of documents that its trace had retrieved before: the first so many of the trace."""
    c = traces.project(chats(spark, sf_dir))["contexts"]
    return c.select("trace_id", "span_id", "turn_index", F.md5("query").alias("query"), F.md5("response").alias("response"), "documents")


@query(f"""with {_CHATS}, d as (select n, k, ms, unnest([0, 1]) as pos, unnest([text, 'about ' || text]) as text from u)
select trace_id, row_number() over (partition by n order by ms, k, pos) as place, text from (select d.*, n::varchar as trace_id from d)""")
def trace_documents(spark, sf_dir):
    """The documents of each trace, once each, in the order in which they had come."""
    return traces.project(chats(spark, sf_dir))["documents"].select("trace_id", "place", "text")


@query(f"""with {_CHATS} select b.chat as span_id, (select string_agg(md5(x), '' order by d.ms, d.k, i) from (select n, ms, k, unnest([0, 1]) as i, unnest([text, 'about ' || text]) as x from u) d where d.n = b.n and d.ms + 10 <= b.ms + 100) as contexts from b where pair""")
def expanded_contexts(spark, sf_dir):
    """The documents themselves of each answered chat, as the metrics take them."""
    out = traces.expand_contexts(traces.project(chats(spark, sf_dir)))
    return out.select("span_id", F.array_join(F.transform("contexts", lambda x: F.md5(x)), "").alias("contexts"))


@query(f"""with {_CHATS} select trace_id, 't' || n || '-' || k as span_id, before + coalesce(pair, false)::int as turn_index, 'tool-name' as tool_name, '{{"q":"' || k || '"}}' as arguments, k % 3 = 2 as succeeded from b""")
def projected_tool_calls(spark, sf_dir):
    return traces.project(chats(spark, sf_dir))["tool_calls"]


@query(f"with {_CHATS} select trace_id, 'r' || n || '-' || k as span_id, unnest([text, 'about ' || text]) as text from u")
def retrieved_documents(spark, sf_dir):
    return traces.retrieval_documents(chats(spark, sf_dir)).select("trace_id", "span_id", "text")


@query(f"with {_CHATS}, s as (select trace_id, 3 * count(*) as spans, count(*) filter (k % 3 = 0) as errors, count(*) filter (k % 3 = 1) as warned from u group by 1) select trace_id, spans, errors, {unit('(spans - errors)::double / spans - warned * 0.08::double')} as value from s")
def step_efficiency(spark, sf_dir):
    return traces.step_efficiency(chats(spark, sf_dir))


@query("select user_id, max(ts) as ingested_at from events group by 1 order by 2 desc, 1 desc limit 200")
def kept_traces(spark, sf_dir):
    """The 200 latest traces of a buffer: its size is the feature."""
    latest = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("ingested_at"))
    return traces.evict(latest.withColumnRenamed("user_id", "trace_id")).withColumnRenamed("trace_id", "user_id")


# ---- stores ----------------------------------------------------------------------------------------------------------


def _by_row_sql(tail: str) -> str:
    from confera.plans import oracle

    return oracle.chain(*oracle.ALL) + tail


def enriched_csv_rows(spark, sf_dir):
    """The enriched table as its CSV of 33 columns, read back as text; those columns that the SQL has."""
    path = scratch(spark)
    store.write_enriched_csv(enrich(raw_turns(spark, sf_dir), SYNTHETIC), path)
    kept = [c for c in store.ENRICHED_CSV if c in _CSV_SQL]
    read = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    if read.columns != list(store.ENRICHED_CSV):
        raise ValueError("the header isn't the fixed one")
    return read.select(*[F.coalesce(c, F.lit("")).alias(c) for c in kept])


_NUMBER = "regexp_replace({}::varchar, '\\.0$', '')"
_CSV_SQL = {
    "sessionId": "session_id", "role": "role", "turnIndex": "turn_index::varchar", "topicSegmentIndex": "seg::varchar", "topicSegmentId": "session_id || '_topic_' || seg", "topicStartTurn": "seg_start::varchar", "topicEndTurn": "seg_end::varchar",
    "emotionPolarity": "polarity", "emotionIntensity": "intensity", "emotionBaseScore": _NUMBER.format("base"), "emotionScore": _NUMBER.format("emotion"), "emotionValenceWeight": _NUMBER.format("valence"), "emotionLengthWeight": _NUMBER.format("len_w"), "emotionStyleWeight": _NUMBER.format("style"),
    "emotionGapWeight": _NUMBER.format("gap_w"), "emotionRecoveryWeight": _NUMBER.format("rec"), "emotionRiskPenalty": _NUMBER.format("risk"), "responseGapSec": "coalesce(gap::varchar, '')", "isDropoffTurn": "is_dropoff::varchar", "isQuestion": "is_question::varchar", "isTopicSwitch": "is_switch::varchar",
    "activeHour": "active_hour::varchar", "tokenCountEstimate": "token_estimate::varchar",
}


@query("select event_type, count(*) as rows, max(event_id) as last_id from events where event_id % 3 = 1 group by 1")
def run_tables(spark, sf_dir):
    """events as the result tables of three runs, one of them written twice; read back by run."""
    path, e = scratch(spark), table(spark, sf_dir, "events")
    for k in (0, 1, 2, 1):
        store.write_results({"events": e.filter(F.col("event_id") % 3 == k).select("event_id", "event_type")}, path, f"run{k}")
    kept = spark.read.parquet(f"{path}/events").filter("run_id = 'run1'")
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.max("event_id").alias("last_id"))


@query("select event_id, event_type, ts as updated_at from events where event_type = 'click' order by ts desc limit 50")
def stored_listing(spark, sf_dir):
    """The 50 latest stored rows of a kind: a list as users see it."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").alias("updated_at"))
    return store.listing(e, 50, event_type="click")


@query("with k as (select user_id, event_type, event_id, row_number() over (partition by user_id, event_type order by event_id desc) as k from events) select user_id, event_type, event_id from k where k = 1")
def upserted(spark, sf_dir):
    """events stored in two parts, the later replacing the earlier by key."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return store.upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


def stored_cases(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("c"), (F.col("doc_id") % 400).cast("string")).alias("case_id"), F.when(F.col("doc_id") % 400 % 3 == 0, "goodcase").otherwise("badcase").alias("case_set_type"), F.coalesce("source", F.lit("none")).alias("topic_label"), ((F.col("doc_id") % 100) / 100).alias("baseline_case_score"), F.lit("v1").alias("baseline_version"), F.when(F.col("doc_id") % 5 > 0, F.col("lang")).alias("duplicate_group_key"), F.col("doc_id").alias("created_at"))


_STORED = "sc as (select 'c' || (doc_id % 400) as case_id, case when doc_id % 400 % 3 = 0 then 'goodcase' else 'badcase' end as case_set_type, coalesce(source, 'none') as topic_label, (doc_id % 100) / 100.0::double as baseline_case_score, 'v1' as baseline_version, case when doc_id % 5 > 0 then lang end as duplicate_group_key, doc_id as created_at from documents)"


def _registry(spark, sf_dir):
    path, cases = scratch(spark), stored_cases(spark, sf_dir)
    store.append_cases(cases.filter("created_at % 2 = 0"), path)
    store.append_cases(cases.filter("created_at % 2 = 1"), path)
    return spark.read.parquet(path)


@query(f"with {_STORED} select case_id, case_set_type, topic_label, baseline_case_score, baseline_version, coalesce(duplicate_group_key, '') as duplicate_group_key, created_at from (select *, row_number() over (partition by case_id order by created_at desc) as k from sc) where k = 1")
def case_index(spark, sf_dir):
    """The index of a registry that cases were added to twice."""
    return store.case_index(_registry(spark, sf_dir))


@query(f"with {_STORED} select case_set_type, count(distinct case_id) as case_count, max(created_at) as updated_at from sc group by 1")
def case_manifest(spark, sf_dir):
    return store.case_manifest(_registry(spark, sf_dir))


def _baselines(spark, sf_dir):
    path = scratch(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("created_at"), F.col("lang").alias("label"))
    for customer, run, n in (("acme", "run 1", 0), ("acme", "run/2", 1), ("客户", "run 1", 2), ("acme", "run 1", 3)):
        store.save_baseline(d.filter(F.col("doc_id") % 4 == n), path, customer, run)
    return store.read_baselines(spark, path)


@query("select doc_id, 'acme' as customer, 'run-1' as run from documents where doc_id % 4 = 3")
def found_baseline(spark, sf_dir):
    """A run by its id alone, of the first customer that has it; what was stored again is replaced."""
    return store.find_baseline(_baselines(spark, sf_dir), "run 1").select("doc_id", F.col("customer").cast("string").alias("customer"), F.col("run").cast("string").alias("run"))


@query("select case doc_id % 4 when 3 then 'run-1' else 'run-2' end as run, max(doc_id) as created_at, max(lang) as label from documents where doc_id % 4 in (1, 3) group by 1")
def baseline_list(spark, sf_dir):
    return store.baseline_list(_baselines(spark, sf_dir), "acme").withColumn("run", F.col("run").cast("string"))


def projected_tables(spark, sf_dir):
    """The seven tables of an evaluation: rows and distinct ids of each."""
    tables = store.project_evaluation("run", Evaluation(raw_turns(spark, sf_dir), SYNTHETIC).keep())
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def register_later() -> None:
    """Queries whose SQL is made of the pieces of the evaluation's SQL."""
    from confera.plans import oracle

    csv = ", ".join(f'{sql} as "{c}"' for c, sql in _CSV_SQL.items())
    query(oracle.chain(*oracle.ALL) + f", y as (select x.*, e.* exclude (session_id, seg, emotion, n_rows), min(x.turn_index) over (partition by x.session_id, x.seg) as seg_start from x join e using (session_id, seg)) select {csv} from y")(enriched_csv_rows)
    query(oracle.chain(*oracle.FULL) + """ select 'evaluation_runs' as name, 1 as rows union all select 'topic_segments', count(distinct (session_id, seg)) from x union all select 'objective_signals', 9 union all select 'subjective_signals', count(*) from d
union all select 'business_kpi_signals', count(*) from kpis union all select 'evidence_spans', count(*) from s union all select 'risk_tags', coalesce(sum(len(tags)), 0)::bigint from cases""")(projected_tables)
