"""Readers, mapping, dialogues, traces, extended metrics and streams on small files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from confera.operators import dialogue, extended, sessionize, traces
from confera.sources import mapping, readers, runs
from confera.streaming import turns as streaming


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def said(df):
    return [(r.session_id, r.role, r.content) for r in df.orderBy("ingest_seq").collect()]


def test_csv(spark, tmp_path):
    p = put(tmp_path / "a.csv", 'timestamp,role,content,sessionId\n2026-01-01T00:00:00Z,User,"你好, ""朋友""",s1\n\n2026-01-01T00:00:01Z,robot,x,s1\n2026-01-01T00:00:02Z,assistant,short\n')
    assert said(readers.read_logs(spark, p)) == [("s1", "user", '你好, "朋友"'), ("unknown", "assistant", "short")]
    assert readers.read_csv(spark, put(tmp_path / "b.csv", "a,b\n1,2\n")).count() == 0


def test_json(spark, tmp_path):
    messages = [{"role": "USER", "content": "hi", "sessionId": "z"}, {"role": "tool", "content": "x"}, {"role": "assistant", "content": "yo", "timestamp": "t"}]
    for name, body in (("a.json", json.dumps(messages)), ("b.json", json.dumps({"messages": messages})), ("c.json", "\n".join(map(json.dumps, messages))), ("d.jsonl", "\n".join(map(json.dumps, messages)))):
        assert said(readers.read_logs(spark, put(tmp_path / name, body))) == [("z", "user", "hi"), ("json_session_001", "assistant", "yo")], name


def test_text(spark, tmp_path):
    p = put(tmp_path / "log.txt", "user: 一\n## session: s2\n[2026-01-01T00:00:00Z] assistant：二\n[session: s3]\nsystem: 三\nnoise\n")
    assert said(readers.read_logs(spark, p)) == [("log_session", "user", "一"), ("s2", "assistant", "二"), ("s3", "system", "三")]
    plain = put(tmp_path / "plain.txt", "one\n\ntwo\nthree\n")
    assert [r[1:] for r in said(readers.read_logs(spark, plain))] == [("user", "one"), ("assistant", "two"), ("user", "three")]
    assert readers.read_logs(spark, put(tmp_path / "p.md", "one\ntwo\n")).count() == 0


def test_mapping(spark):
    df = spark.createDataFrame([("c1", [("human", "hello"), ("bot", "hi"), ("x", "no"), ("human", " ")])], "conversation_id string, turns array<struct<speaker:string,utterance:string>>")
    plan = mapping.infer_mapping(df.schema)
    assert plan.path == ("turns",) and plan.fields == {"role": "speaker", "content": "utterance"} and plan.parents == {"session_id": "conversation_id"}
    assert said(mapping.apply_mapping(df, plan)) == [("c1", "user", "hello"), ("c1", "assistant", "hi")]
    flat = spark.createDataFrame([("agent", "ok", "s", "2026")], "Sender string, message_text string, chat_id string, created_at string")
    assert said(mapping.apply_mapping(flat, mapping.infer_mapping(flat.schema))) == [("s", "assistant", "ok")]
    nothing = spark.createDataFrame([(1,)], "n int")
    assert mapping.apply_mapping(nothing, mapping.infer_mapping(nothing.schema)).count() == 0
    assert mapping.detect_source(df.schema) == "custom" and "$.turns[*].speaker" in mapping.sample_paths(df.schema)


def test_transcripts(spark):
    df = spark.createDataFrame([("c", "[turn 1] [user] a\njunk\n[turn 2] [assistant] b", 3)], "case_id string, transcript string, case_index int")
    assert [r.role for r in readers.reparse_transcripts(df).orderBy("ingest_seq").collect()] == ["user", "assistant"]
    assert [r.content for r in readers.reparse_transcripts(df, "user").orderBy("ingest_seq").collect()] == ["a", "junk", "b"]
    assert readers.reparse_transcripts(df, "replay").orderBy("ingest_seq").head().ts_raw == "2020-01-01T00:03:00Z"


DIALOGUE = {
    "dialogue_id": "d1", "services": ["Hotels_1"],
    "turns": [
        {"speaker": "USER", "utterance": "book in Rome", "frames": [{"service": "Hotels_1", "actions": [{"act": "INFORM", "slot": "city"}, {"act": "INFORM_INTENT", "slot": "intent"}], "slots": [{"slot": "city", "start": 8, "exclusive_end": 12}, {"slot": "bad", "start": 9, "exclusive_end": 99}], "state": {"active_intent": "ReserveHotel", "slot_values": {"city": ["Rome", "rome"]}, "requested_slots": ["price"]}}]},
        {"speaker": "SYSTEM", "utterance": "Rome, ok?", "frames": [{"service": "Hotels_1", "actions": [{"act": "CONFIRM", "slot": "city"}], "slots": []}]},
        {"speaker": "USER", "utterance": "", "frames": []},
        {"speaker": "SYSTEM", "utterance": "done", "frames": [{"service": "Hotels_1", "actions": [], "slots": [], "service_call": {"method": "ReserveHotel", "parameters": {"city": "Rome", "night": "2"}}, "service_results": [{"a": "1"}]}]},
    ],
}


def test_dialogues(spark, tmp_path):
    for name, body in (("a", [DIALOGUE]), ("b", {"dialogues": [DIALOGUE]}), ("c", DIALOGUE)):
        d = readers.read_dialogues(spark, put(tmp_path / f"{name}.json", json.dumps(body)))
        assert [r[1:] for r in said(readers.dialogue_turns(d))] == [("user", "book in Rome"), ("assistant", "Rome, ok?"), ("assistant", "done")]
    frames = readers.dialogue_frames(d)
    assert [(r.slot, r.value) for r in dialogue.slot_mentions(frames).collect()] == [("city", "Rome")]
    schema = spark.createDataFrame([("Hotels_1", 1, ["ReserveHotel"], ["city"]), ("Hotels_1", 2, [], []), ("Other", 1, [], [])], "service string, seq int, intents array<string>, slots array<string>")
    assert readers.used_schema(schema, d).count() == 2
    m = {r.metric: r.value for r in dialogue.structured_metrics(frames, schema).collect()}
    assert (m["case_count"], m["frame_count"], m["service_call_count"], m["service_call_grounding_rate"], m["service_result_availability_rate"], m["transactional_confirmation_rate"]) == (1, 3, 1, 0.5, 1.0, 1.0)
    assert m["schema_intent_coverage_rate"] == 1.0 and m["unknown_schema_slot_references"] == 2 and m["schema_service_count"] == 2


def test_asof_edges(spark):
    state = spark.createDataFrame([("c", "s", 5, {"a": ["1"]}), ("c", "s", 2, {"a": ["2"]})], "case_id string, service string, turn_index int, slot_values map<string,array<string>>")
    call = spark.createDataFrame([("c", "s", 1, {"a": ["1"]}), ("c", "s", 5, {"a": ["1"]}), ("c", "s", 4, {"a": ["1"]}), ("c", "x", 9, {})], "case_id string, service string, turn_index int, parameters map<string,array<string>>")
    got = {(r.service, r.turn_index): (r.state_turn, r.grounded) for r in dialogue.call_grounding(call, state).collect()}
    assert got == {("s", 1): (None, 0.0), ("s", 5): (5, 1.0), ("s", 4): (2, 0.0), ("x", 9): (None, 1.0)}
    assert dialogue.confirmed_calls(spark.createDataFrame([], "case_id string, service string, turn_index int, method string"), spark.createDataFrame([], "case_id string, turn_index int, role string, service string, actions array<struct<act:string,slot:string>>")).count() == 0


SPAN = "span_id string, trace_id string, name string, kind string, status string, start_ms bigint, end_ms bigint, input string, output string"


def test_traces(spark):
    rows = [
        ("r1", "t", "ret", "retrieval", "ok", 1, 5, "{}", json.dumps({"documents": ["doc a", {"page_content": "doc b"}]})), ("c1", "t", "llm", "chat", "ok", 10, 20, json.dumps({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": [{"text": "q1"}]}]}), json.dumps({"choices": [{"message": {"content": "a1"}}]})),
        ("r2", "t", "ret", "retrieval", "ok", 12, 30, "{}", json.dumps([{"text": "doc c"}])), ("w1", "t", "search", "tool", "error", 25, 26, json.dumps({"arguments": {"x": 1}}), None), ("c2", "t", "llm", "chat", "ok", 40, None, json.dumps([{"role": "user", "content": "q2"}]), json.dumps("a2")), ("w2", "t", "raw", "tool", "ok", 50, 51, "not json", None),
    ]
    out = traces.project(spark.createDataFrame(rows, SPAN))
    assert [(r.role, r.content) for r in out["rows"].orderBy("ts_ms", "pos").collect()] == [("system", "s"), ("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("assistant", "a2")]
    assert [(r["query"], r.response, r.contexts, r.turn_index) for r in traces.expand_contexts(out).orderBy("turn_index").collect()] == [("q1", "a1", ["doc a", "doc b"], 0), ("q2", "a2", ["doc a", "doc b", "doc c"], 1)]
    tools = {r.tool_name: (r.turn_index, r.succeeded, r.arguments) for r in out["tool_calls"].collect()}
    assert tools["search"] == (1, False, '{"x":1}') and tools["raw"][:2] == (2, True) and "not json" in tools["raw"][2]


def test_run_trees(spark, tmp_path):
    child = {"id": "b", "name": "llm", "run_type": "llm", "start_time": 2, "inputs": "{}", "outputs": "{}", "child_runs": []}
    root = {"id": "a", "name": "chain", "run_type": "chain", "start_time": 1, "child_runs": [child, {**child, "id": "c", "run_type": "odd", "error": "e"}]}
    flat = runs.flatten_runs(spark.createDataFrame([(json.dumps(root),)], "root string"))
    got = {r.span_id: (r.parent_id, r.kind, r.status) for r in runs.run_spans(flat).collect()}
    assert got == {"a": (None, "agent", "ok"), "b": ("a", "chat", "ok"), "c": ("a", "custom", "error")}
    line = json.dumps({"traceId": "t", "spans": [{"spanId": "s", "name": "n", "kind": "chat", "startTime": "2026-01-01T00:00:00Z", "input": "x"}]})
    assert [(r.trace_id, r.start_ms) for r in runs.read_spans(spark, put(tmp_path / "t.jsonl", line + "\nbroken\n")).collect()] == [("t", 1767225600000)]


def test_headings_stand_before_their_lines(spark, tmp_path):
    from confera.plans.source_queries import read_text_turns

    rng = random.Random(5)
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}.{t} {rng.getrandbits(2000):x}") for c in range(300) for t in range(6)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    small = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        got = sorted((r.session_id, r.nth, r.content) for r in read_text_turns(spark, str(tmp_path)).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted((f"named {c}", t + 1, text) for c, t, _, text in rows)


def test_extended(spark):
    facts = spark.createDataFrame([("s", 1, "my name is Ann"), ("s", 3, "gone")], "session_id string, introduced int, fact string")
    talk = spark.createDataFrame([("s", 1, "assistant", "my name is X"), ("s", 2, "assistant", "so my name is Ann"), ("s", 4, "assistant", "bye")], "session_id string, turn_index int, role string, content string")
    kept = extended.knowledge_retention(facts, talk)
    assert {r.introduced: r.retained for r in kept.collect()} == {1: True, 3: False}
    assert extended.retention_score(kept).head().score == 0.5
    tox = {r.id: r.score for r in extended.toxicity_by_lexicon(spark.createDataFrame([(1, "You IDIOT, stupid"), (2, "fine")], "id int, t string"), "id", F.col("t")).collect()}
    assert tox == {1: 0.4, 2: 1.0}
    calls = spark.createDataFrame([("a", "a", {"x": "1"}, {"x": "1"}, True), ("a", "b", {}, {"x": "1"}, False)], "tool_name string, expected_tool string, arguments map<string,string>, expected_arguments map<string,string>, succeeded boolean")
    assert extended.tool_correctness(calls).head().score == pytest.approx(0.55) and extended.task_completion(calls).head().score == 0.5
    ctx = spark.createDataFrame([("red fish", "a red fish", ["red sea"], 0)], "query string, response string, contexts array<string>, turn_index int")
    assert {r.metric: r.score for r in extended.context_scores(ctx).collect()} == {"answer_relevancy": 1.0, "contextual_relevancy": 0.5, "faithfulness": 0.5, "hallucination": 0.5}
    assert extended.role_adherence(spark).head().success is None


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(f"s{k % 3}", k % 3, k // 3 + 1, "user" if k % 2 else "assistant", "为什么？" if k % 4 == 0 else "好", 1_700_000_000 + 60 * k) for k in range(60)]
    df = spark.createDataFrame(rows, "session_id string, session_seq bigint, turn_index int, role string, content string, s bigint").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = streaming.turn_stream(spark, f"{tmp_path}/in", files=1)
    flags = lambda t: sessionize.flag_turns(t.withColumn("ts_ms", F.unix_millis("ts"))).groupBy("session_id").agg(F.count_if("is_question").alias("q"))
    streaming.evaluate_batches(stream, flags, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    summed = spark.read.parquet(f"{tmp_path}/out").groupBy("session_id").agg(F.sum("q").alias("q"))
    assert sorted(map(tuple, summed.collect())) == sorted(map(tuple, flags(df).collect()))
    q = streaming.activity_by_window(streaming.turn_stream(spark, f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("by_window").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from by_window").collect())) == sorted(map(tuple, streaming.activity_by_window(df).collect()))
    assert streaming.session_activity(df).count() == 3


def test_streamed_segments_are_those_of_the_batch(spark, tmp_path):
    import random

    from confera.functions.lexicon import SYNTHETIC
    from confera.operators import segment

    rng = random.Random(2)
    said = ["erin", "than", "thre", "tion", "are", "this", "from", "for", "thst", "erst", "plain"]
    rows = [(f"s{k % 4}", k % 4, k // 4 + 1, rng.choice(["user", "assistant"]), " ".join(rng.sample(said, 2))) for k in range(160)]
    turns = spark.createDataFrame(rows, "session_id string, session_seq bigint, turn_index int, role string, content string")
    for n in range(4):  # a session's turns in four files, in order
        turns.filter(f"turn_index > {10 * n} and turn_index <= {10 * n + 10}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = streaming.turn_stream(spark, f"{tmp_path}/in", schema="session_id string, session_seq bigint, turn_index int, role string, content string", files=1)
    q = streaming.segment_stream(stream, SYNTHETIC).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").start()
    assert q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("session_id", "turn_index", "topic_segment_index").collect()))
    want = sorted(map(tuple, segment.topic_segments(turns, SYNTHETIC).select("session_id", "turn_index", "topic_segment_index").collect()))
    assert got == want and max(x[2] for x in want) > 3


def test_mapping_review(spark):
    from confera.sources import mapping

    plan = mapping.infer_mapping(spark.createDataFrame([("a", "b")], "speaker string, text string").schema)
    assert plan.confidence == 0.78 and plan.capabilities["basic_chat"] and not plan.capabilities["slot_eval"]
    done = mapping.review_mapping(plan, lambda p: {"confidence": 2.0, "warnings": [" odd ", "odd", ""], "questions": ["which?"]})
    assert (done.confidence, done.warnings, done.questions, done.review) == (0.89, ["odd"], ["which?"], "completed")
    failed = mapping.review_mapping(done, lambda p: 1 / 0)
    assert failed.review == "degraded" and failed.confidence == 0.89 and failed.warnings == ["odd", "review failed: division by zero"]
    _, enabled, disabled = mapping.capability_report({"messages.role", "messages.content", "schema.services"})
    assert enabled == ["basic_chat_eval", "schema_aware_eval"] and ("slot_eval", "slots or dialogue states") in disabled
