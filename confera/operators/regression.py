"""Remediation packages, replay and offline regression gates, release readiness and synthesis plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confera.functions.text import js_round, unit4

EPSILON = 0.03
#: Fixed values.
HARD_TAGS = ("goal_failed", "recovery_failed", "escalation_keyword")
EVOLUTIONS = ("add_constraint", "switch_tone", "inject_noise", "multi_turn", "missing_context", "contradict")
PERSONAS = ("impatient", "novice", "expert", "anxious", "loyal")


# The layer that each tag asks to edit, in the order in which layers are named.
EDIT_SCOPE = {
    "prompt": ("goal_failed", "goal_partial", "goal_unclear", "off_topic_shift"),
    "policy": ("escalation_keyword",),
    "orchestration": ("recovery_failed", "question_repeat", "understanding_barrier"),
    "code": ("long_response_gap",),
}
# Metric, tags that make it a target, direction, step from the current value, bound of the target, least and
# most value, places of rounding. None for the tags: a target whenever its value is below the bound.
TARGETS = [
    ("goal_completion_rate", ("goal_failed", "goal_partial"), "increase", 0.15, 0.7, 0, 1, 4),
    ("recovery_completion_rate", ("recovery_failed",), "increase", 0.2, 0.6, 0, 1, 4),
    ("emotion_recovery_score", ("recovery_failed",), "increase", 1.0, 4.0, 1, 5, 2),
    ("user_question_repeat_rate", ("question_repeat", "understanding_barrier"), "decrease", 0.08, 0.05, 0, 1, 4),
    ("empathy_score", ("question_repeat", "understanding_barrier"), "increase", 1.0, 4.0, 1, 5, 2),
    ("off_topic_score", ("off_topic_shift",), "increase", 1.0, 4.0, 1, 5, 2),
    ("escalation_keyword_hit_rate", ("escalation_keyword",), "decrease", 0.1, 0.0, 0, 1, 4),
    ("avg_response_gap_sec", ("long_response_gap",), "decrease", 10.0, 10.0, 0, 1e9, 0),
    ("scenario_average_score", None, "increase", 0.1, 0.75, 0, 1, 4),
]
MOST_CASES, MOST_TAGS, MIN_WIN_RATE = 5, 5, 0.65


def _tagged(tags: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tags, F.array(*[F.lit(n) for n in names]))


def priority(tags: Column, severity: Column) -> Column:
    return F.when(_tagged(tags, HARD_TAGS) | (severity >= 0.72), "P0").when(severity >= 0.48, "P1").otherwise("P2")


def edit_scope(tags: Column) -> Column:
    named = F.array_compact(F.array(*[F.when(_tagged(tags, names), layer) for layer, names in EDIT_SCOPE.items()]))
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("prompt"), F.lit("orchestration")))


def select_cases(cases: DataFrame, most: int = MOST_CASES) -> DataFrame:
    """The worst cases of a package, with priority and the layers to edit of each."""
    ordered = [F.desc("severity"), *(c for c in ("session_seq", "topic_segment_index") if c in cases.columns)]
    return cases.withColumns({"priority": priority(F.col("tags"), F.col("severity")), "edit_scope": edit_scope(F.col("tags"))}).orderBy(*ordered).limit(most)


def remediation_package(selected: DataFrame) -> DataFrame:
    """One row for the cases of a package: cases, priority, edit_scope, dominant_tags (by frequency, then by name)."""
    head = selected.agg(F.count(F.lit(1)).alias("cases"), F.max("severity").alias("severity"), F.array_distinct(F.flatten(F.collect_list("tags"))).alias("tags"))
    counted = selected.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    top = counted.agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "tag"))), 1, MOST_TAGS), lambda x: x["tag"]).alias("dominant_tags"))
    return head.filter("cases > 0").join(top).select("cases", priority(F.col("tags"), F.col("severity")).alias("priority"), edit_scope(F.col("tags")).alias("edit_scope"), "dominant_tags", F.array_sort("tags").alias("tags"))


def target_metrics(package: DataFrame, values: DataFrame) -> DataFrame:
    """values: metric, value. metric, direction, current and target of what the tags of the package ask to move.

    A metric without a value counts as 0, as no rate can be shown for it.
    """
    spark = values.sparkSession
    rule = "metric string, tags array<string>, direction string, step double, bound double, low double, high double, places int"
    rules = spark.createDataFrame([(m, None if t is None else list(t), d, x, b, float(lo), float(hi), n) for m, t, d, x, b, lo, hi, n in TARGETS], rule).withColumnRenamed("tags", "asked")
    met = rules.join(package.select(F.col("tags")), F.coalesce(F.arrays_overlap("asked", "tags"), F.lit(True))).join(values, "metric", "left").withColumn("current", F.coalesce("value", F.lit(0.0)))
    met = met.filter(F.col("asked").isNotNull() | (F.col("value") < F.col("bound")))
    moved = F.when(F.col("direction") == "increase", F.greatest(F.col("current") + F.col("step"), F.col("bound"))).otherwise(F.greatest(F.col("current") - F.col("step"), F.col("bound")))
    scale = F.pow(F.lit(10.0), F.col("places"))
    return met.select("metric", "direction", "current", F.greatest("low", F.least("high", F.floor(moved * scale + 0.5) / scale)).alias("target"))


def acceptance_guards(package: DataFrame, targets: DataFrame) -> DataFrame:
    """guard, metric, comparator (lte or gte), threshold of the gate that a package sets."""
    fixed = package.select(F.explode(F.array_compact(F.array(F.struct(F.lit("dangerous_reply_count").alias("guard"), F.lit(0.0).alias("threshold")), F.struct(F.lit("max_regressions").alias("guard"), F.lit(0.0).alias("threshold")), F.when(F.array_contains("tags", "long_response_gap"), F.struct(F.lit("avg_latency_regression_max_ratio").alias("guard"), F.lit(1.2).alias("threshold")))))).alias("x"))
    up = F.col("direction") == "increase"
    own = targets.select(F.concat("metric", F.when(up, "_min").otherwise("_max")).alias("guard"), "metric", F.when(up, "gte").otherwise("lte").alias("comparator"), js_round(F.col("target"), 4).alias("threshold"))
    return fixed.select("x.guard", F.lit(None).cast("string").alias("metric"), F.lit("lte").alias("comparator"), "x.threshold").unionByName(own)


def case_score(dimension: Column, goal: Column, recovery: Column, worst: Column) -> Column:
    return unit4(dimension / 5 * 0.35 + goal * 0.3 + recovery * 0.15 + (1 - worst) * 0.2)


def case_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both: case_id, score. delta, improved, regressed, skipped (no score after)."""
    delta = js_round(F.col("after") - F.col("before"), 4)
    met = before.select("case_id", F.col("score").alias("before")).join(after.select("case_id", F.col("score").alias("after")), "case_id", "left").withColumn("delta", delta)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return met.withColumns({"improved": yes(F.col("delta") >= EPSILON), "regressed": yes(F.col("delta") <= -EPSILON), "skipped": F.col("after").isNull()})


def offline_regression(before: DataFrame, after: DataFrame, max_regressions: int = 0) -> DataFrame:
    d = case_deltas(before, after)
    out = d.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("skipped")).alias("executed"), F.count_if("skipped").alias("skipped"), F.count_if("improved").alias("improved"), F.count_if("regressed").alias("regressed"), js_round(F.avg("delta"), 4).alias("avg_delta"))
    return out.withColumn("passed", (F.col("executed") > 0) & (F.col("regressed") <= max_regressions))


def replay_targets(targets: DataFrame, current: DataFrame) -> DataFrame:
    """targets: metric, direction, current, target; current: metric, value of the replay. Adds now, improved, passed."""
    met = targets.join(current.select("metric", F.col("value").alias("now")), "metric", "left")
    up = F.col("direction") == "increase"
    improved = F.when(up, F.col("now") > F.col("current")).otherwise(F.col("now") < F.col("current"))
    passed = F.when(up, F.col("now") >= F.col("target")).otherwise(F.col("now") <= F.col("target"))
    return met.withColumns({"improved": F.coalesce(improved, F.lit(False)), "passed": F.coalesce(passed, F.lit(False))})


def guard_results(guards: DataFrame, results: DataFrame, baseline: DataFrame, current: DataFrame) -> DataFrame:
    """guard, comparator, threshold, value, passed. Without a value a metric's guard fails, a ratio to nothing passes."""
    gap = lambda df, name: df.agg(F.max(F.when(F.col("metric") == "avg_response_gap_sec", F.col("value"))).alias(name))
    facts = results.agg(F.count_if(~F.col("improved") & ~F.col("passed")).cast("double").alias("regressed")).join(gap(baseline, "gap_before")).join(gap(current, "gap_now"))  # one row each
    met = guards.join(current.select("metric", "value"), "metric", "left").join(facts)
    value = F.when(F.col("guard") == "max_regressions", F.col("regressed")).when(F.col("guard") == "dangerous_reply_count", 0.0).when(F.col("guard") == "avg_latency_regression_max_ratio", F.when(F.col("gap_before") > 0, F.try_divide("gap_now", "gap_before"))).otherwise(F.col("value"))
    met = met.withColumn("v", value)
    ok = F.when(F.col("comparator") == "gte", F.col("v") >= F.col("threshold")).otherwise(F.col("v") <= F.col("threshold"))
    return met.select("guard", "comparator", "threshold", js_round(F.col("v"), 4).alias("value"), F.coalesce(ok, F.col("guard") == "avg_latency_regression_max_ratio").alias("passed"))


def replay_validation(results: DataFrame, guards: DataFrame | None = None, win_rate: float = MIN_WIN_RATE) -> DataFrame:
    """results: of replay_targets; guards: of guard_results. One row; without targets the win rate is 1."""
    out = results.agg(F.count(F.lit(1)).alias("metrics"), F.count_if("improved").alias("improved"), F.count_if("passed").alias("passed"), F.count_if(~F.col("improved") & ~F.col("passed")).alias("regressed"))
    out = out.withColumn("win_rate", js_round(F.coalesce(F.try_divide(F.col("improved").cast("double"), F.col("metrics").cast("double")), F.lit(1.0)), 4))
    held = F.lit(True)
    if guards is not None:
        out, held = out.join(guards.agg(F.coalesce(F.every("passed"), F.lit(True)).alias("held"))), F.col("held")
    return out.withColumn("gate", F.when((F.col("win_rate") >= win_rate) & held, "passed").otherwise("failed")).drop("held")


def release_readiness(links: DataFrame, validations: DataFrame, last: int = 5) -> DataFrame:
    """links: run_id, validation_id, baseline_status; validations: validation_id, status. The latest runs and how each moved."""
    rank = lambda c: F.when(c == "passed", 2).when(c == "partial", 1).otherwise(0)
    met = links.join(validations.select("validation_id", "status"), "validation_id", "left")
    kind = F.when(F.col("validation_id").isNull(), "not_linked").when(F.col("status").isNull(), "missing").when(rank(F.col("status")) > rank(F.col("baseline_status")), "improved").when(rank(F.col("status")) < rank(F.col("baseline_status")), "regressed").otherwise("unchanged")
    return met.withColumn("delta", kind).orderBy(F.desc("run_id")).limit(last)


def readiness_status(deltas: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("delta") == k)
    out = deltas.agg(n("improved").alias("improved"), n("regressed").alias("regressed"), n("missing").alias("missing"), n("not_linked").alias("not_linked"), n("unchanged").alias("unchanged"))
    return out.withColumn("status", F.when(F.col("regressed") > 0, "blocked").when(F.col("missing") + F.col("not_linked") > 0, "pending").otherwise("ready"))


def workflow_status(steps: DataFrame, most: int = 3) -> DataFrame:
    """steps: scope, item, passed (null: not run). Status of each scope and its first failing items."""
    failing = steps.filter(~F.col("passed")).withColumn("k", F.row_number().over(Window.partitionBy("scope").orderBy("item"))).filter(F.col("k") <= most).groupBy("scope").agg(F.array_sort(F.collect_list("item")).alias("blockers"))
    out = steps.groupBy("scope").agg(F.count_if("passed").alias("p"), F.count_if(~F.col("passed")).alias("f"), F.count_if(F.col("passed").isNull()).alias("u"))
    status = F.when((F.col("f") == 0) & (F.col("u") == 0), "passed").when((F.col("f") > 0) & (F.col("p") == 0), "failed").when((F.col("p") == 0) & (F.col("f") == 0), "ready").otherwise("partial")
    return out.join(failing, "scope", "left").select("scope", status.alias("status"), F.coalesce("blockers", F.array().cast("array<string>")).alias("blockers"))


def package_values(evaluation) -> DataFrame:  # noqa: ANN001
    """metric, value of one evaluation, under the names that packages use. Rates without a case are 0."""
    e = evaluation
    o = e.objective.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(c).cast("double").alias("value")) for k, c in {"user_question_repeat_rate": "question_repeat_rate", "escalation_keyword_hit_rate": "escalation_rate", "avg_response_gap_sec": "avg_response_gap_sec"}.items()])).alias("x")).select("x.*")
    names = F.create_map(*[F.lit(x) for kv in {"empathy": "empathy_score", "on_topic": "off_topic_score", "recovery": "emotion_recovery_score"}.items() for x in kv])
    d = e.dimensions.select(F.try_element_at(names, F.col("dimension")).alias("metric"), F.col("score").cast("double").alias("value")).filter("metric is not null")
    g = e.goals.agg(F.coalesce(F.avg((F.col("status") == "achieved").cast("int")), F.lit(0.0)).alias("value")).select(F.lit("goal_completion_rate").alias("metric"), "value")
    r = e.recoveries.filter("status <> 'none'").agg(F.coalesce(F.avg((F.col("status") == "completed").cast("int")), F.lit(0.0)).alias("value")).select(F.lit("recovery_completion_rate").alias("metric"), "value")
    k = e.kpis.agg(js_round(F.avg("score"), 4).alias("value")).select(F.lit("scenario_average_score").alias("metric"), "value")
    return o.unionByName(d).unionByName(g).unionByName(r).unionByName(k)


def run_values(evaluation) -> DataFrame:  # noqa: ANN001
    """metric, value that two runs are compared by: KPI mean, bad cases, response gap, escalation."""
    own = package_values(evaluation).filter(F.col("metric").isin("scenario_average_score", "avg_response_gap_sec", "escalation_keyword_hit_rate"))
    return own.unionByName(evaluation.bad_cases.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("bad_case_count").alias("metric"), "value"))


def compare_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """metric, left, right, delta of two runs."""
    return left.select("metric", F.col("value").alias("left")).join(right.select("metric", F.col("value").alias("right")), "metric", "full").withColumn("delta", js_round(F.col("right") - F.col("left"), 4))


def batch_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("cases"), js_round(F.avg("before"), 4).alias("avg_before"), js_round(F.avg("after"), 4).alias("avg_after"))


def synthesis_plan(spark, count: int, modes: tuple[str | None, ...] = ("goal_failed", "off_topic_shift", "recovery_failed"), strategy: str = "long_tail", anchored: bool = False) -> DataFrame:
    """count coverage cells: failure mode, persona, operators, rarity and difficulty, by position alone."""
    return plan_cells(spark.range(count), modes, strategy, anchored)


def plan_cells(places: DataFrame, modes: tuple[str | None, ...] = ("goal_failed", "off_topic_shift", "recovery_failed"), strategy: str = "long_tail", anchored: bool = False) -> DataFrame:
    """places: id (from 0), such as the numbers of seed cases. A coverage cell for each."""
    modes = (None, *modes) if strategy == "balanced" or not modes else modes
    i, n = F.col("id"), len(modes)
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))
    mode = pick(modes, i)
    if strategy == "long_tail" and n > 1:
        mode = F.when(i % 5 != 0, F.element_at(F.array(*[F.lit(v).cast("string") for v in modes]), (F.pmod(i, F.lit(n - 1)) + 2).cast("int"))).otherwise(mode)
    shift = i + F.coalesce(F.length("failure_mode"), F.lit(1))
    base = {"long_tail": 0.68, "regression": 0.58}.get(strategy, 0.36) + (0.08 if anchored else 0.0)
    rarity = js_round(F.greatest(F.lit(0.12), F.least(F.lit(0.95), F.lit(base) + F.when(F.col("failure_mode").isNotNull(), 0.12).otherwise(-0.08) + (i % 4) * 0.04)), 2)
    out = places.select("id").withColumn("failure_mode", mode).withColumns({"persona": pick(PERSONAS, i), "operator_1": pick(EVOLUTIONS, shift), "operator_2": pick(EVOLUTIONS, shift + 3), "rarity": rarity})
    return out.select((i + 1).alias("cell"), "failure_mode", "persona", "operator_1", "operator_2", "rarity", F.when(F.col("rarity") >= 0.78, "hard").when(F.col("rarity") >= 0.52, "medium").otherwise("easy").alias("difficulty"))


def synthesis_quality(cases: DataFrame, turn_min: int, turn_max: int, accept: float = 0.62) -> DataFrame:
    """cases: case_id, seq, cell_mode and has_cell, failure_mode, n_turns, has_user, has_assistant, norm, covers, operators (count)."""
    again = F.row_number().over(Window.partitionBy("norm").orderBy("seq")) > 1
    mismatch = F.col("has_cell") & ~F.col("failure_mode").eqNullSafe(F.col("cell_mode"))
    parts = [(~F.col("has_cell"), 0.18), (mismatch, 0.22), ((F.col("n_turns") < turn_min) | (F.col("n_turns") > turn_max * 2), 0.12), (~(F.col("has_user") & F.col("has_assistant")), 0.28), (F.length("norm") < 80, 0.2), (F.col("again"), 0.4), (F.col("failure_mode").isNotNull() & ~F.col("covers"), 0.06), (F.col("operators") == 0, 0.08)]
    score = F.lit(1.0)
    for test, off in parts:
        score = score - F.when(test, off).otherwise(0.0)
    return cases.withColumn("again", again).withColumn("score", unit4(score)).withColumn("accepted", F.col("score") >= accept)


def synthesis_baseline(cases: DataFrame) -> DataFrame:
    """cases: failure_mode, difficulty, rarity, quality. Adds the score that a made case starts from; positive ones at 0.86."""
    hard = F.when(F.col("difficulty") == "hard", 0.2).when(F.col("difficulty") == "medium", 0.12).otherwise(0.06)
    rare = F.least(F.lit(0.16), F.coalesce("rarity", F.lit(0.5)) * 0.14)
    good = F.greatest(F.lit(0.0), (F.coalesce("quality", F.lit(0.7)) - 0.7) * 0.08)
    score = js_round(F.greatest(F.lit(0.18), F.least(F.lit(0.82), 0.68 - hard - rare + good)), 4)
    return cases.withColumn("baseline_score", F.when(F.col("failure_mode").isNull(), 0.86).otherwise(score))
