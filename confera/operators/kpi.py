"""Business KPIs from weighted metrics, and the registry of metrics with thresholds and a gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confera.functions.text import js_round, ratio, unit4

# KPI, thresholds (success, degraded), and (source, metric, weight); a negative weight counts 1 - value.
CUSTOMER_SUPPORT = [
    ("resolution_rate", 0.75, 0.5, [("subjective", "goal_completion", 0.5), ("objective", "resolution_rate", 0.3), ("objective", "question_repeat_rate", -0.2), ("signal", "understanding_barrier", -0.2)]),
    ("escalation_control", 0.72, 0.48, [("objective", "escalation_rate", -0.45), ("subjective", "on_topic", 0.35), ("signal", "recovery_failure", -0.2), ("objective", "avg_response_gap_sec", -0.1)]),
    ("service_efficiency", 0.7, 0.45, [("objective", "avg_response_gap_sec", -0.35), ("objective", "topic_switch_rate", -0.25), ("objective", "resolution_rate", 0.2), ("signal", "understanding_barrier", -0.1), ("subjective", "empathy", 0.1)]),
]
NEUTRAL = 0.5


def kpi_references(spark, template: list = CUSTOMER_SUPPORT) -> DataFrame:
    rows = [(k, success, degraded, source, metric, float(w)) for k, success, degraded, refs in template for source, metric, w in refs]
    return spark.createDataFrame(rows, "kpi string, success double, degraded double, source string, metric string, weight double")


def metric_values(objective: DataFrame, dimensions: DataFrame, signals: DataFrame, goals: DataFrame, recoveries: DataFrame) -> DataFrame:
    """source, metric, value: every metric on a scale from 0 to 1."""
    o = F.col
    scaled = {
        "resolution_rate": unit4(o("resolution_rate")), "escalation_rate": unit4(o("escalation_rate")), "question_repeat_rate": unit4(o("question_repeat_rate")), "topic_switch_rate": unit4(o("topic_switch_rate") / 3),
        "user_question_rate": unit4(o("user_question_rate")), "avg_response_gap_sec": unit4(o("avg_response_gap_sec") / 120),
    }
    long = objective.select(F.explode(F.array(*[F.struct(F.lit("objective").alias("source"), F.lit(k).alias("metric"), v.alias("value")) for k, v in scaled.items()])).alias("x")).select("x.*")
    judged = dimensions.select(F.lit("subjective").alias("source"), F.col("dimension").alias("metric"), unit4(F.col("score") / 5).alias("value"))
    risks = signals.select(F.lit("signal").alias("source"), F.col("signal_key").alias("metric"), F.col("score").alias("value"))
    goal = goals.agg(F.coalesce(F.avg(F.col("score") / 5), F.lit(0.0)).alias("v")).select(F.lit("subjective").alias("source"), F.lit("goal_completion").alias("metric"), unit4(F.col("v")).alias("value"))
    tried = recoveries.filter("status <> 'none'").agg(F.coalesce(F.avg((F.col("status") == "completed").cast("int")), F.lit(NEUTRAL)).alias("v")).select(F.lit("subjective").alias("source"), F.lit("recovery_rate").alias("metric"), unit4(F.col("v")).alias("value"))
    return long.unionByName(judged).unionByName(risks).unionByName(goal).unionByName(tried)


def scenario_kpis(values: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """kpi, score, status, weakest (the two least aligned metrics). A metric without a value counts as neutral."""
    references = references or kpi_references(values.sparkSession)
    met = references.join(values, ["source", "metric"], "left").withColumn("value", F.coalesce("value", F.lit(NEUTRAL)))
    met = met.withColumn("aligned", unit4(F.when(F.col("weight") >= 0, F.col("value")).otherwise(1 - F.col("value"))))
    scored = met.groupBy("kpi", "success", "degraded").agg(unit4(ratio(F.sum(F.col("aligned") * F.abs("weight")), F.sum(F.abs("weight")))).alias("score"), F.slice(F.array_sort(F.collect_list(F.struct("aligned", "metric"))), 1, 2).alias("w"))
    status = F.when(F.col("score") >= F.col("success"), "healthy").when(F.col("score") >= F.col("degraded"), "degraded").otherwise("at_risk")
    return scored.select("kpi", "score", status.alias("status"), F.transform("w", lambda x: x["metric"]).alias("weakest"))


# Metric, source, whether more is better (else 1 - value counts), least score that passes.
REGISTRY = [
    ("avg_response_gap_sec", "objective", False, 0.78), ("topic_switch_rate", "objective", False, 0.72), ("resolution_rate", "objective", True, 0.68), ("goal_completion", "subjective", True, 0.7), ("empathy", "subjective", True, 0.68), ("on_topic", "subjective", True, 0.68),
    ("service_call_grounding", "structured", True, 0.85), ("service_result_availability", "structured", True, 0.95), ("schema_slot_compliance", "structured", True, 0.95), ("trace_step_efficiency", "trace", True, 0.72), ("synthetic_coverage", "synthetic", True, 0.5),
]


def metric_registry(values: DataFrame, definitions: list = REGISTRY) -> DataFrame:
    """metric, source, score, threshold, success: true, false, or null where the metric has no value (skipped)."""
    defined = values.sparkSession.createDataFrame([(m, s, b, float(t)) for m, s, b, t in definitions], "metric string, source string, more_is_better boolean, threshold double")
    met = defined.join(values, ["source", "metric"], "left").withColumn("score", unit4(F.when(F.col("more_is_better"), F.col("value")).otherwise(1 - F.col("value"))))
    met = met.withColumn("score", F.when(F.col("value").isNotNull(), F.col("score")))
    return met.select("metric", "source", "score", "threshold", (F.col("score") >= F.col("threshold")).alias("success"))


def pass_rate(results: DataFrame, least: float = 0.6) -> DataFrame:
    """passed, failed, skipped, pass_rate (skipped ones left out) and the gate."""
    return results.agg(F.count_if("success").alias("passed"), F.count_if(~F.col("success")).alias("failed"), F.count_if(F.col("success").isNull()).alias("skipped"), js_round(F.coalesce(F.avg(F.col("success").cast("int")), F.lit(0.0)), 4).alias("pass_rate")).withColumn("gate", F.when(F.col("pass_rate") >= least, "passed").otherwise("failed"))


# Metrics that a scenario declares: name, least score that passes, base metric whose result it takes over.
SCENARIO_METRICS = [("issue_resolution", 0.7, "goal_completion"), ("kind_tone", 0.68, "empathy"), ("stays_on_task", 0.68, "on_topic"), ("tool_grounding", 0.85, "service_call_grounding")]


def scenario_registry(values: DataFrame, kpis: DataFrame, references: DataFrame | None = None, scenario: str = "customer_support", proxies: list = SCENARIO_METRICS, definitions: list = REGISTRY) -> DataFrame:
    """Base metrics, then business.<kpi> of every KPI, then scenario.<scenario>.<metric> by proxy.

    seq, metric, category, score, threshold, success (null: skipped), status (ready or skipped), in the order of definition.
    """
    spark = values.sparkSession
    references = references or kpi_references(spark)
    place = spark.createDataFrame([(m, k) for k, (m, *_) in enumerate(definitions)], "metric string, seq int")
    base = metric_registry(values, definitions).withColumnRenamed("source", "category").join(place, "metric")
    order = references.withColumn("at", F.monotonically_increasing_id()).groupBy("kpi").agg(F.min("at").alias("at"), F.max("success").alias("threshold"))
    nth = F.row_number().over(Window.orderBy("at")) - 1  # as many rows as a template has KPIs
    business = order.withColumn("seq", (F.lit(len(definitions)) + nth).cast("int")).join(kpis.select("kpi", "score"), "kpi", "left")
    business = business.select(F.concat(F.lit("business."), "kpi").alias("metric"), F.lit("business").alias("category"), "score", "threshold", (F.col("score") >= F.col("threshold")).alias("success"), "seq")
    rows = [(f"scenario.{scenario}.{m}", float(t), p, k) for k, (m, t, p) in enumerate(proxies)]
    own = spark.createDataFrame(rows, "name string, least double, metric string, k int").join(base.select("metric", "category", "score"), "metric", "left")
    own = own.join(references.agg(F.count_distinct("kpi").alias("n")))  # one row
    own = own.select(F.col("name").alias("metric"), "category", "score", F.col("least").alias("threshold"), (F.col("score") >= F.col("least")).alias("success"), (F.lit(len(definitions)) + F.col("n") + F.col("k")).cast("int").alias("seq"))
    out = base.select(*own.columns).unionByName(business).unionByName(own)
    return out.select("seq", "metric", "category", "score", "threshold", "success", F.when(F.col("success").isNull(), "skipped").otherwise("ready").alias("status"))


def registry_gate(results: DataFrame, least: float = 0.6, named: int = 3) -> DataFrame:
    """One row: pass_rate (skipped ones left out), gate (failed, warning or passed) and its reasons."""
    fails = F.array_sort(F.collect_list(F.when(~F.col("success") & (F.col("category") != "synthetic"), F.struct("seq", "metric"))))
    out = results.agg(js_round(F.coalesce(F.avg(F.col("success").cast("int")), F.lit(0.0)), 4).alias("pass_rate"), F.slice(fails, 1, named).alias("fails"), F.max((F.col("metric") == "trace_step_efficiency") & F.col("success").isNull()).alias("untraced"), F.count_if(F.col("success").isNull()).alias("skipped"), F.count_if(F.col("success").isNotNull()).alias("ready"))
    low = F.col("pass_rate") < least
    reasons = F.concat(F.when(low, F.array(F.lit("FAILED:pass_rate"))).otherwise(F.array().cast("array<string>")), F.transform("fails", lambda x: F.concat(F.lit("WARNING:"), x["metric"])), F.when(F.col("untraced"), F.array(F.lit("INFO:no_trace"))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("reasons", reasons)
    return out.select("pass_rate", "ready", "skipped", F.when(low, "failed").when(F.size("reasons") > 0, "warning").otherwise("passed").alias("gate"), "reasons")


def eval_cases(turns: DataFrame) -> DataFrame:
    """A case per session: first user input, last assistant output, turns; and what the case has to offer."""
    user, assistant = F.when(F.col("role") == "user", F.col("turn_index")), F.when(F.col("role") == "assistant", F.col("turn_index"))
    cases = turns.groupBy("session_id").agg(F.min_by("content", user).alias("input"), F.max_by("content", assistant).alias("actual_output"), F.count(F.lit(1)).alias("turn_count"), F.array_sort(F.collect_list(F.struct("turn_index", "role", "content"))).alias("turns"), F.count("ts_ms").alias("timed"))
    return cases.withColumn("available", F.create_map(F.lit("input"), F.col("input").isNotNull(), F.lit("actual_output"), F.col("actual_output").isNotNull(), F.lit("turns"), F.col("turn_count") > 0, F.lit("timestamps"), F.col("timed") > 0)).drop("timed")


def capability_report(cases: DataFrame) -> DataFrame:
    """field, available_in (cases), available (any)."""
    return cases.select(F.explode("available").alias("field", "has")).groupBy("field").agg(F.count_if("has").alias("available_in"), F.max("has").alias("available"))
