"""Run trees of any depth, spans with what refuses them, and contexts by reference, against plain Python."""

import json
import random
import sys

from pyspark.sql import functions as F

from confera.operators import extended, traces
from confera.sources import runs


def flat(root, place=None, parent=None, depth=0, top=None):
    place = place if place is not None else [0]
    top = top or root["id"]
    out = [(root["id"], parent, top, place[0], depth)]
    place[0] += 1
    for c in root.get("child_runs") or []:
        out += flat(c, place, root["id"], depth + 1, top)
    return out


def test_trees_in_pre_order(spark):
    rng = random.Random(1)
    names = iter(range(10**6))

    def tree(depth):
        run = {"name": rng.choice(['child_runs', 'x"}]', "{[", "é\\"]), "id": f"r{next(names)}", "inputs": {"child_runs": [{"id": "not a run"}], "q": ['"child_runs"', {"a": [1]}]}}
        kids = [tree(depth + 1) for _ in range(rng.choice([0, 1, 2, 3]))] if depth < 5 else []
        if kids or rng.random() < 0.5:
            run["child_runs"] = kids or rng.choice([None, []])
        return run | {"outputs": rng.choice(["child_runs", None, "]}"]), "start_time": rng.choice([5, "7", "soon", None, 1.5e3])}

    roots = [tree(0) for _ in range(30)]
    df = spark.createDataFrame([(json.dumps(r, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])), 1) for r in roots] + [(None, 1), ("", 1), ("[]", 1)], "root string, id int")
    rows = runs.flatten_runs(df).collect()
    assert sorted((r.id, r.parent_run_id, r.trace_id, r.place, r.depth) for r in rows) == sorted(x for root in roots for x in flat(root))
    one = {r.id: r for r in rows}[roots[0]["id"]]
    assert one.name == roots[0]["name"] and json.loads(one.inputs) == roots[0]["inputs"]
    assert {r.start_ms for r in rows} == {5, 7, None, 1500}


def test_a_tree_of_any_depth(spark):
    deep = "".join(f'{{"id": "r{k}", "child_runs": [' for k in range(5000)) + "]}" * 5000
    assert len(deep) > sys.getrecursionlimit()
    got = runs.flatten_runs(spark.createDataFrame([(deep,)], "root string")).orderBy("place").collect()
    assert [(r.id, r.parent_run_id, r.depth) for r in got] == [(f"r{k}", f"r{k - 1}" if k else None, k) for k in range(5000)]
    spans = runs.run_spans(runs.flatten_runs(spark.createDataFrame([(deep,)], "root string")))
    assert spans.filter("kind = 'custom'").count() == 5000


GOOD = {"spanId": "s", "name": "n", "kind": "chat", "startTime": "2026-01-01T00:00:00Z"}


def test_spans_and_refusals(spark):
    def line(spans=(GOOD,), **k):
        return json.dumps({"traceId": "t", "spans": list(spans)} | k)

    cases = {
        line(): [], line(sessionId="u", turnIndex=3, metadata={"a": 1}): [], line([]): [], '{"traceId": "bare"}': [], "{broken": ["json"], "[1]": ["object"], "3": ["object"],
        line(traceId=7): ["traceId:type"], line(traceId=""): ["traceId:empty"], json.dumps({"spans": []}): ["traceId:missing"], line(spans={}): ["spans:type"] if False else [],
        line(turnIndex=1.5): ["turnIndex:type"], line(metadata=[1]): ["metadata:type"],
        line([GOOD | {"spanId": None}]): ["spans[0].spanId:type"], line([GOOD, GOOD | {"kind": "odd"}]): ["spans[1].kind:value"], line([{k: v for k, v in GOOD.items() if k != "name"} | {"status": "bad", "endTime": 4}]): ["spans[0].name:missing", "spans[0].endTime:type", "spans[0].status:value"],
        line([GOOD | {"attributes": "x", "error": 1}]): ["spans[0].attributes:type", "spans[0].error:type"],
    }
    df = spark.createDataFrame([(x,) for x in cases] + [("  ",)], "value string")
    got = {r.value: sorted(r.reasons) for r in runs.checked_traces(df).collect()}
    wrong = {x: (got[x], want) for x, want in cases.items() if got[x] != sorted(want)}
    assert not wrong
    assert runs.refused_traces(df).count() == sum(bool(v) for v in cases.values())
    spans = runs.ingested_spans(spark.createDataFrame([(line(),), (line(),), (line([GOOD, GOOD | {"spanId": "b", "input": {"q": [1]}}], sessionId="u"),)], "value string"))
    assert sorted((r.trace_id, r.span_id, r.input, r.status) for r in spans.collect()) == [("t", "s", None, "ok"), ("u", "b", '{"q":[1]}', "ok"), ("u", "s", None, "ok")]


def test_spans_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"traceId": f"t{k % 5}", "spans": [GOOD | {"spanId": f"s{k % 20}"}]}) for k in range(60)]
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines[:30] + ["{", ""]))
    for part, more in (("b", lines[30:]), ("c", ["[]"])):
        for q in runs.ingest_stream(spark.readStream.text(str(tmp_path / "in")), str(tmp_path), late="1 hour"):
            q.awaitTermination()
        (tmp_path / "in" / f"{part}.jsonl").write_text("\n".join(more))
    for q in runs.ingest_stream(spark.readStream.text(str(tmp_path / "in")), str(tmp_path), late="1 hour"):
        q.awaitTermination()
    got = sorted((r.trace_id, r.span_id) for r in spark.read.parquet(f"{tmp_path}/spans").collect())
    assert got == sorted({(f"t{k % 5}", f"s{k % 20}") for k in range(60)})
    assert sorted(r.reasons[0] for r in spark.read.parquet(f"{tmp_path}/refused").collect()) == ["json", "object"]


def test_agent_runs(spark):
    call = "struct<id:string,input:string,output:string,start_ms:bigint,end_ms:bigint>"
    tool = "struct<id:string,name:string,arguments:string,output:string,ok:boolean,start_ms:bigint,end_ms:bigint>"
    df = spark.createDataFrame([("r", "helper", 1, 9, [("c1", "i", "o", 2, 3)], [("t1", "find", "{}", "x", True, 4, 5), ("t2", "buy", "{}", None, False, 6, 7)]), ("e", "idle", 1, 2, [], [])], f"run_id string, name string, start_ms bigint, end_ms bigint, calls array<{call}>, tools array<{tool}>")
    got = sorted((r.span_id, r.parent_id, r.trace_id, r.name, r.kind, r.status) for r in runs.agent_run_spans(df).collect())
    assert got == [("c1", "r", "r", "model", "chat", "ok"), ("e", None, "e", "idle", "agent", "ok"), ("r", None, "r", "helper", "agent", "ok"), ("t1", "r", "r", "find", "tool", "ok"), ("t2", "r", "r", "buy", "tool", "error")]


def test_contexts_by_reference(spark):
    rng = random.Random(4)
    spans, schema = [], "span_id string, trace_id string, kind string, start_ms bigint, end_ms bigint, input string, output string, name string, status string"
    for k in range(120):
        at = rng.choice([None, *range(40)])
        kind = rng.choice(["chat", "retrieval", "retrieval"])
        end = None if at is None or rng.random() < 0.2 else at + rng.randint(0, 9)
        given = json.dumps({"input": f"q{k}"}) if kind == "chat" else None
        out = json.dumps({"content": f"a{k}"}) if kind == "chat" else json.dumps({"documents": [f"d{k}-{j}" for j in range(rng.choice([0, 1, 3]))]})
        spans.append((f"s{k:03}", f"t{k % 4}", kind, at, end, given, out, "n", "ok"))
    out = {r.span_id: r.contexts for r in traces.expand_contexts(traces.project(spark.createDataFrame(spans, schema))).collect()}
    first = lambda x, y: x if x is not None else y
    for sid, tid, kind, at, *_ in spans:
        if kind == "chat":
            before = [(first(e, s), -1 if s is None else s, i, d) for i, t, k, s, e, _, o, *_ in spans if t == tid and k == "retrieval" and at is not None and first(e, s) is not None and first(e, s) <= at for d in json.loads(o)["documents"]]
            assert out[sid] == [d for *_, d in sorted(before, key=lambda x: x[:3])]


def test_retention_by_grams(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    turns = [(f"s{k % 3}", k // 3, rng.choice(["user", "assistant"]), word(rng.choice([0, 1, 2, 5, 30]))) for k in range(120)]
    facts = [(s, k, word(rng.choice([0, 1, 3, 7, 8, 12]))) for s, k, *_ in turns]
    got = extended.knowledge_retention(spark.createDataFrame(facts, "session_id string, introduced int, fact string"), spark.createDataFrame(turns, "session_id string, turn_index int, role string, content string"))
    for r in got.collect():
        later = [c for s, k, role, c in sorted(turns, key=lambda x: x[1]) if s == r.session_id and role == "assistant" and k > r.introduced]
        assert r.retained == (bool(later) and r.fact[:8] in " ".join(later)), r
    long = spark.range(20_000).select(F.lit("s").alias("session_id"), F.col("id").cast("int").alias("turn_index"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn number "), F.col("id").cast("string")).alias("content"))
    kept = extended.knowledge_retention(long.select("session_id", F.col("turn_index").alias("introduced"), F.col("content").alias("fact")), long)
    assert kept.filter("retained").count() == 19_999


def test_retention_makes_no_grams_of_a_long_text(spark):
    turns = [("s", 0, "user", "needle x"), ("s", 1, "user", "lost one"), ("s", 2, "assistant", "hay " * 2_000_000 + "needle"), ("s", 3, "assistant", None), ("s", 4, "assistant", "x"), ("s", 5, "assistant", "")]
    schema = "session_id string, turn_index int, role string, content string"
    talk = spark.createDataFrame(turns, schema)
    facts = spark.createDataFrame([*(t[:2] + t[3:] for t in turns[:2]), ("s", 3, "x "), ("s", 3, " x"), ("s", 5, ""), ("t", 0, "")], "session_id string, introduced int, fact string")
    got = {(r.session_id, r.introduced, r.fact): r.retained for r in extended.knowledge_retention(facts, talk).collect()}
    assert got == {("s", 0, "needle x"): True, ("s", 1, "lost one"): False, ("s", 3, "x "): True, ("s", 3, " x"): False, ("s", 5, ""): False, ("t", 0, ""): False}


def test_retention_in_units(spark, monkeypatch):
    monkeypatch.setattr(extended, "STARTS", 7)
    monkeypatch.setattr(extended, "CHARACTERS", 40)
    monkeypatch.setattr(extended, "FEW", 3)
    test_retention_by_grams(spark)
