"""Objective metrics, charts, summary cards and trends over enriched turns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confera.functions.lexicon import ZH, Lexicon
from confera.functions.text import depth_bucket, js_round, question_fingerprint, ratio
from confera.operators.order import numbered

def dataset_index(rows: DataFrame, name: str = "dataset_index") -> DataFrame:
    """rows (session_seq, turn_index) numbered from 0 in dataset order, by range partitions that number their own rows."""
    return numbered(rows, "session_seq", "turn_index", name=name)


def depth_histogram(turns: DataFrame) -> DataFrame:
    return turns.groupBy("session_id").agg(F.max("turn_index").alias("depth")).groupBy(depth_bucket(F.col("depth")).alias("bucket")).agg(F.count(F.lit(1)).alias("sessions"))


def dropoff_histogram(turns: DataFrame) -> DataFrame:
    return turns.filter("is_dropoff").groupBy("turn_index").agg(F.count(F.lit(1)).alias("sessions"))


def active_hours(turns: DataFrame, *by: str) -> DataFrame:
    return turns.groupBy(F.coalesce(F.col("active_hour").cast("string"), F.lit("unknown")).alias("hour"), *by).agg(F.count(F.lit(1)).alias("turns"))


def session_facts(turns: DataFrame, lexicon: Lexicon = ZH) -> DataFrame:
    """Per session what the session-level rates are made of, in one aggregation."""
    text = F.col("content")
    return turns.groupBy("session_id").agg(
        F.count_distinct("topic_segment_index").alias("segments"), F.max((F.col("role") == "assistant") & text.rlike(lexicon.resolution_signal)).alias("resolved"), F.max(text.rlike(lexicon.escalation_signal)).alias("escalated"),
        F.sum("response_gap_sec").alias("gap_sum"), F.count("response_gap_sec").alias("gap_count"), F.count_if((F.col("role") == "user")).alias("n_user"), F.count_if(F.col("role") == "assistant").alias("n_assistant"),
        F.count_if((F.col("role") == "user") & F.col("is_question")).alias("n_questions"), F.sum(F.when(F.col("role") == "user", F.col("content_length"))).alias("user_length"), F.sum(F.when(F.col("role") == "assistant", F.col("content_length"))).alias("assistant_length"),
    )


def repeat_rate(turns: DataFrame, size: int = 18, *scope: str) -> DataFrame:
    """Share of questions that repeat an earlier one of the scope, by fingerprint; one row per scope."""
    asked = turns.filter((F.col("role") == "user") & F.col("is_question")).withColumn("fp", question_fingerprint(F.col("content"), size)).filter("fp <> ''")
    per = asked.groupBy(*scope, "fp").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy(*scope).agg(js_round(ratio(F.sum(F.col("c") - 1), F.sum("c")), 4).alias("repeat_rate"), F.max("c").alias("most"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("repeats"))


def length_trend(turns: DataFrame) -> DataFrame:
    """Slope of the length of user messages over their dataset order."""
    users = dataset_index(turns.filter("role = 'user'").select("session_seq", "turn_index", "content_length"))
    x, y, n = F.col("dataset_index").cast("double"), F.col("content_length").cast("double"), F.count(F.lit(1)).cast("double")
    return users.agg(js_round(F.coalesce(F.try_divide(n * F.sum(x * y) - F.sum(x) * F.sum(y), n * F.sum(x * x) - F.sum(x) * F.sum(x)), F.lit(0.0)), 4).alias("length_trend"))


def objective_metrics(turns: DataFrame, lexicon: Lexicon = ZH) -> DataFrame:
    """One row of scalars. turns: enriched, with topic_segment_index."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    facts = session_facts(turns, lexicon).agg(
        js_round(ratio(total("gap_sum"), total("gap_count")), 2).alias("avg_response_gap_sec"), js_round(F.coalesce(F.avg(F.col("segments") - 1), F.lit(0.0)), 4).alias("topic_switch_rate"),
        js_round(F.coalesce(F.avg(F.col("resolved").cast("int")), F.lit(0.0)), 4).alias("resolution_rate"), js_round(F.coalesce(F.avg(F.col("escalated").cast("int")), F.lit(0.0)), 4).alias("escalation_rate"),
        js_round(ratio(total("n_questions"), total("n_user")), 4).alias("user_question_rate"), js_round(ratio(total("user_length"), total("n_user")), 2).alias("avg_user_length"), js_round(ratio(total("assistant_length"), total("n_assistant")), 2).alias("avg_assistant_length"),
    )
    repeats = repeat_rate(turns).select(F.coalesce("repeat_rate", F.lit(0.0)).alias("question_repeat_rate"))
    return facts.join(repeats).join(length_trend(turns))  # one row each


def metrics_long(one_row: DataFrame) -> DataFrame:
    """metric, value of a one-row frame of numbers."""
    return one_row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one_row.columns])).alias("x")).select("x.*")


def emotion_curve(turns: DataFrame) -> DataFrame:
    return turns.select("session_id", "turn_index", "emotion_score")


def switch_counts(turns: DataFrame) -> DataFrame:
    """Topic switches per session, sessions without one included."""
    return turns.groupBy("session_id").agg(F.count_if("is_topic_switch").alias("switches"))


def percent(x: Column) -> Column:
    return F.concat(js_round(x * 100).cast("int").cast("string"), F.lit("%"))


def summary_cards(turns: DataFrame, goals: DataFrame, metrics: DataFrame) -> DataFrame:
    """key, value (text) of the headline numbers."""
    base = turns.agg(F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("turns"), js_round(F.coalesce(F.avg("emotion_score"), F.lit(0.0)), 1).alias("avg_emotion"))
    reached = goals.agg(F.coalesce(F.avg((F.col("status") == "achieved").cast("int")), F.lit(0.0)).alias("reached"))
    row = base.join(reached).join(metrics)
    text = lambda c: F.col(c).cast("string")
    cards = {"sessions": text("sessions"), "turns": text("turns"), "avg_emotion": text("avg_emotion"), "goal_completion": percent(F.col("reached")), "avg_gap": F.concat(text("avg_response_gap_sec"), F.lit("s")), "topic_switch_rate": percent(F.col("topic_switch_rate")), "question_rate": percent(F.col("user_question_rate"))}
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in cards.items()])).alias("x")).select("x.*")


#: The advice of a report, with the facts that it names in braces.
ADVICE = [
    "P0: the mean emotion score is {avg_emotion}, and {low_turns} turns lie at 40 or below. Look at these turns first and soften the wording around them.",
    "P0: {goal_percent} % of the sessions reach their goal and {failed_goals} fail. Go through the failed ones and say which step was missing.",
    "P1: an answer takes {gap} seconds on average. Send a short receipt where the full answer takes longer.",
    "P1: the topic changes {switches} times. Ask whether the old topic is settled before a new one begins.",
    "P1: users ask {questions} questions, and the risk that they don't follow is {understanding_barrier}. Answer the question before adding to it.",
    "P1: {recovered} failures were repaired and {unrecovered} were not. Keep the wording of the repairs, and write a fix for the rest.",
    "P1: interest fades at risk {interest_decline}, and moods stay low at risk {recovery_failure}. Let these signals start an intervention.",
    "P2: empathy is rated {empathy} of 5. Keep the turns that speak for and against that rating as evidence.",
]


def report_facts(turns: DataFrame, metrics: DataFrame, dimensions: DataFrame, signals: DataFrame, goals: DataFrame, recoveries: DataFrame) -> DataFrame:
    """One row of what the advice names. Without rows counts are 0, risks low and empathy 1."""
    c = F.col
    base = turns.agg(js_round(F.coalesce(F.avg("emotion_score"), F.lit(0.0)), 1).alias("avg_emotion"), F.count_if(c("emotion_score") <= 40).alias("low_turns"), F.count_if("is_topic_switch").alias("switches"), F.count_if(c("is_question") & (c("role") == "user")).alias("questions"))
    reached = goals.agg(js_round(F.coalesce(F.avg((c("status") == "achieved").cast("int")), F.lit(0.0)) * 100).cast("int").alias("goal_percent"), F.count_if(c("status") == "failed").alias("failed_goals"))
    traces = recoveries.agg(F.count_if(c("status") == "completed").alias("recovered"), F.count_if(c("status") == "failed").alias("unrecovered"))
    risks = signals.agg(*[F.coalesce(F.max(F.when(c("signal_key") == k, c("severity"))), F.lit("low")).alias(k) for k in ("interest_decline", "understanding_barrier", "recovery_failure")])
    kind = dimensions.agg(F.coalesce(F.max(F.when(c("dimension") == "empathy", c("score"))), F.lit(1)).alias("empathy"))
    gap = metrics.select(js_round(c("avg_response_gap_sec")).cast("int").alias("gap"))
    return base.join(reached).join(traces).join(risks).join(kind).join(gap)  # one row each


def suggestions(facts: DataFrame, texts: list[str] = ADVICE) -> DataFrame:
    """seq, text of every line of advice, with the facts put in. Whole numbers show no places."""
    plain = {f: F.regexp_replace(F.col(f).cast("string"), r"\.0$", "") for f in facts.columns}
    filled = []
    for text in texts:
        parts = re.split(r"\{(\w+)\}", text)
        filled.append(F.concat(*[plain[x] if k % 2 else F.lit(x) for k, x in enumerate(parts)]))
    return facts.select(F.posexplode(F.array(*filled)).alias("seq", "text"))


def trend_points(runs: DataFrame, last: int = 20) -> DataFrame:
    """runs: run_id, generated_at, emotion (per row), achieved, bad_cases, kpi. The latest `last` runs, ascending."""
    per = runs.groupBy("run_id", "generated_at").agg(js_round(F.avg("emotion"), 2).alias("avg_emotion"), js_round(F.avg(F.col("achieved").cast("int")) * 100, 1).alias("goal_percent"), F.sum("bad_cases").alias("bad_cases"), js_round(F.avg("kpi") * 100, 1).alias("kpi_percent"))
    return per.orderBy(F.desc("generated_at"), F.desc("run_id")).limit(last).orderBy("generated_at", "run_id")
