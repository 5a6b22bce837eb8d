"""Sessions, segments, emotion, signals and outcomes on small Chinese conversations."""

import random

import pytest
from pyspark.sql import functions as F

from confera.functions.lexicon import ZH
from confera.operators import metrics, order, outcomes, segment, sessionize, signals
from confera.plans.evaluate import Evaluation, enrich

RAW = "session_id string, ts_raw string, role string, content string, ingest_seq bigint"
TALK = [
    ("a", "2026-01-01T10:00:00Z", "user", "我的方案被老板否定了，很难受"), ("a", "2026-01-01T10:00:30Z", "assistant", "我理解，辛苦了"), ("a", "2026-01-01T10:02:30Z", "user", "这个怎么办？"), ("a", "2026-01-01T10:02:40Z", "assistant", "我们练习一次台词"),
    ("a", "2026-01-01T10:03:00Z", "user", "谢谢，很清楚"), ("b", "2026-01-01T11:00:00Z", "user", "为什么还没退款？"), ("b", "2026-01-01T11:05:00Z", "assistant", "您应该等待"), ("b", "bad", "user", "没解决，转人工"), ("b", "2026-01-01T11:04:00Z", "user", "为什么还没退款？"), ("c", "", "assistant", "你好"),
]


def turns_of(spark, rows, shuffle=None):
    rows = [(*r, i) for i, r in enumerate(rows)]
    if shuffle is not None:
        random.Random(shuffle).shuffle(rows)
    t = sessionize.number_turns(spark.createDataFrame(rows, RAW).repartition(3))
    return t.withColumn("session_seq", F.min("ingest_seq").over(sessionize.session()))


def test_turn_order_puts_unreadable_times_last(spark):
    got = turns_of(spark, TALK).filter("session_id = 'b'").orderBy("turn_index").collect()
    assert [r.content for r in got] == ["为什么还没退款？", "为什么还没退款？", "您应该等待", "没解决，转人工"]
    assert got[3].ts_ms is None and got[3].active_hour is None


def test_gaps_and_flags(spark):
    got = {(r.session_id, r.turn_index): r for r in sessionize.flag_turns(turns_of(spark, TALK)).collect()}
    assert [got["a", k].response_gap_sec for k in range(1, 6)] == [None, 30, 120, 10, 20]
    assert got["b", 4].response_gap_sec is None
    assert got["c", 1].is_dropoff and not got["a", 5].is_dropoff
    assert got["a", 3].is_question and not got["a", 1].is_question


def segments(spark, rows, **options):
    return {(r.session_id, r.turn_index): r.topic_segment_index for r in segment.topic_segments(turns_of(spark, rows), ZH, **options).collect()}


def test_segmentation_modes(spark):
    rows = [("s", f"2026-01-01T10:00:{k:02d}Z", r, c) for k, (r, c) in enumerate([("user", "工作汇报"), ("user", "这个项目"), ("user", "刚才的项目"), ("assistant", "好"), ("user", "我失眠"), ("user", "换个话题")])]
    eager = segments(spark, rows)
    assert [eager["s", k] for k in range(1, 7)] == [1, 2, 2, 2, 3, 4]  # 刚才 continues although it is a switch word too
    assert segments(spark, rows, honor_continuation=False)["s", 3] == 3
    lazy = segments(spark, rows, eager_user_breaks=False)
    assert [lazy["s", k] for k in range(1, 7)] == [1, 1, 1, 1, 2, 2]


def test_segments_do_not_depend_on_partitions_or_order(spark):
    base = segments(spark, TALK * 1)
    t = turns_of(spark, TALK, shuffle=3)
    again = {(r.session_id, r.turn_index): r.topic_segment_index for r in segment.topic_segments(t.repartition(5), ZH).collect()}
    assert again == base


def test_keyword_is_first_in_the_list(spark):
    got = spark.createDataFrame([("投诉，不对",), ("没事",)], "content string").select(ZH.keyword(F.col("content")).alias("k")).collect()
    assert tuple(got[0].k) == ("不对", 0.32) and got[1].k is None


def test_enriched_emotion_is_per_segment(spark):
    e = enrich(turns_of(spark, TALK))
    assert e.groupBy("session_id", "topic_segment_index").agg(F.count_distinct("emotion_score").alias("n")).filter("n > 1").count() == 0
    assert e.count() == len(TALK)
    assert e.filter("emotion_score < 0 or emotion_score > 100").count() == 0


def test_goals_and_recovery(spark):
    ev = Evaluation(turns_of(spark, TALK))
    goals = {r.session_id: r for r in ev.goals.collect()}
    assert goals["a"].status == "achieved" and "user-appreciation-close" in goals["a"].triggered_rules
    assert goals["b"].status == "failed" and goals["b"].score == 1
    assert goals["c"].status == "unclear"
    traces = {r.session_id: r for r in ev.recoveries.collect()}
    assert traces["c"].status == "none" and traces["c"].quality_score == 0.0
    assert set(traces) == {"a", "b", "c"}
    evidence = outcomes.trace_evidence(ev.enriched, ev.recoveries)
    assert evidence.groupBy("session_id").count().filter("count > 5").count() == 0


def test_recovery_completes_with_an_apology(spark):
    rows = [("s", f"2026-01-01T10:00:{k:02d}Z", r, c) for k, (r, c) in enumerate([("user", "什么意思"), ("assistant", "抱歉，我换个方式说"), ("user", "好的")])]
    r = Evaluation(turns_of(spark, rows)).recoveries.head()
    assert (r.status, r.failure_turn, r.recovery_turn, r.span_turns, r.strategy) == ("completed", 1, 2, 1, "apologise-and-rephrase")
    assert r.quality_score == 5.0 and r.triggered_rules == ["user-confusion-expression", "assistant-apology"]


def test_signals_on_empty_and_full(spark):
    ev = Evaluation(turns_of(spark, TALK))
    got = {r.signal_key: r for r in ev.signals.collect()}
    assert set(got) == {"interest_decline", "understanding_barrier", "recovery_failure"}
    assert "repeated_question" in got["understanding_barrier"].triggered_rules
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = Evaluation(turns_of(spark, TALK).limit(0))
    assert empty.goals.count() == 0 and empty.bad_cases.count() == 0 and empty.objective.count() == 1


def test_unresolved_low_window(spark):
    rows = [("s", k, 30.0 if k == 1 else 70.0 if k == 6 else 50.0, 0) for k in range(1, 8)] + [("t", 1, 20.0, 1), ("t", 2, 60.0, 1), ("u", 1, 40.0, 2)]
    df = spark.createDataFrame(rows, "session_id string, turn_index int, emotion_score double, session_seq bigint")
    assert sorted(r.session_id for r in signals.unresolved_low(df).filter("unresolved").collect()) == ["s", "u"]


def test_dataset_index_is_global(spark):
    rows = [(s, t) for s in range(40) for t in range(1, 4)]
    df = spark.createDataFrame(rows, "session_seq bigint, turn_index int")
    got = sorted((r.session_seq, r.turn_index, r.dataset_index) for r in metrics.dataset_index(df.repartition(4)).collect())
    assert [g[2] for g in got] == list(range(len(rows)))


def test_order_and_running_totals(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 1.5, 2.5, 3.5, -1.0]), k) for k in range(300)]
    df = spark.createDataFrame(rows, "k string, v double, place_ int")
    got = order.numbered(df.repartition(5), F.desc("v"), "place_").orderBy("place").collect()
    assert [r.place for r in got] == list(range(300))
    assert [(r.v, r.place_) for r in got] == [(v, n) for _, v, n in sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))]
    assert order.numbered(df.filter("place_ < 0"), "v").count() == 0
    values = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    before = {(r.k, r.v): r.before for r in order.running_totals(values, ["k"], "v", "n").collect()}
    rank = lambda v: (v is not None, v or 0)
    assert before == {(k, v): sum(1 for a, b, _ in rows if a == k and rank(b) < rank(v)) for k, v, _ in rows}


def test_bad_cases(spark):
    ev = Evaluation(turns_of(spark, TALK))
    cases = ev.bad_cases.collect()
    b = [c for c in cases if c.session_id == "b"]
    assert any("escalation_keyword" in c.tags and "goal_failed" in c.tags for c in b)
    assert all(c.tags == sorted(c.tags) and 0 <= c.severity <= 1 for c in cases)
    assert all(c.transcript.startswith("[turn ") for c in cases)


def test_kpis_and_registry(spark):
    ev = Evaluation(turns_of(spark, TALK)).keep()
    kpis = ev.kpis.collect()
    assert len(kpis) == 3 and all(0 <= k.score <= 1 and len(k.weakest) == 2 for k in kpis)
    registry = {r.metric: r for r in ev.registry.collect()}
    assert registry["service_call_grounding"].success is None and registry["resolution_rate"].success is not None
    assert ev.sessions.count() == 3


@pytest.mark.parametrize("n, want", [(3, "1-3"), (8, "4-8"), (9, "9+")])
def test_depth(spark, n, want):
    df = spark.createDataFrame([("s", k) for k in range(1, n + 1)], "session_id string, turn_index int")
    assert metrics.depth_histogram(df).head().bucket == want


def test_evidence_meets_its_turn(spark):
    from confera.operators.badcase import match_evidence

    t = spark.createDataFrame([("s", 1, "user", "hello there"), ("s", 2, "user", "hello"), ("s", 3, "user", "x" * 40)], "session_id string, turn_index int, role string, content string")
    e = spark.createDataFrame([("s", "turn 2 said: hello"), ("s", "quote: " + "x" * 20 + "…"), ("s", "ell"), ("s", "nothing")], "session_id string, said string")
    assert {r.said[:4]: r.turn_index for r in match_evidence(e, t).collect()} == {"turn": 2, "quot": 3, "ell": 1}


def test_retention_queries_agree_with_sql_on_odd_turns(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from confera.plans.oracle import SQL
    from confera.plans.queries import QUERIES

    turns = [(1, 0, "user", " x"), (1, 1, "user", "y "), (1, 2, "assistant", None), (1, 3, "assistant", "x"), (1, 4, "assistant", "y"), (1, 5, "assistant", ""), (2, 0, "user", ""), (2, 1, "assistant", None), (3, 0, "user", None), (3, 1, "assistant", "z")]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("retention_score", "fact_retention"):
        df = QUERIES[name](spark, str(tmp_path))
        want = con.sql(SQL[name])
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(want.select(*[f'"{c}"' for c in df.columns]).fetchall(), key=repr), name
