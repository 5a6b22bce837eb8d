"""Agreement of judges with gold labels and with each other, and the gates on both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confera.functions.text import context_id, js_round, ratio
from confera.operators.order import numbered, running_totals
from confera.operators.store import use_shared_folder


def score_pairs(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """labels, predictions: case_id, dimension, score (predictions also error). Inner by case and dimension, errors left out."""
    good = predictions.filter(F.col("error").isNull()) if "error" in predictions.columns else predictions
    return labels.select("case_id", "dimension", F.col("score").alias("gold")).join(good.select("case_id", "dimension", F.col("score").alias("predicted")), ["case_id", "dimension"])


def average_ranks(counts: DataFrame, by: list[str], value: str, amount: str = "n", name: str = "rank") -> DataFrame:
    """counts: by, value, amount (rows of that value). The rank of each value from 1: the mean of its rows' places.

    Ranks come from running totals over range partitions of the distinct values; no task sees all values of a key.
    """
    return running_totals(counts, by, value, amount, "__before").withColumn(name, F.col("__before") + (F.col(amount) + 1) / 2).drop("__before")


def score_bucket(x: Column) -> Column:
    return F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.floor(x + 0.5).cast("double")))


def kappa(pairs: DataFrame, gold: Column, predicted: Column, *scope: str) -> DataFrame:
    """Cohen's kappa per scope: 1 with one label only or certain agreement by chance. Marginals are counted per label."""
    both = pairs.select(*scope, gold.alias("g"), predicted.alias("p"))
    sides = both.select(*scope, F.explode(F.array(F.struct(F.col("g").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col("p").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")))).alias("x"))
    marginals = sides.groupBy(*scope, "x.label").agg(F.sum("x.g").alias("g"), F.sum("x.p").alias("p"))
    summed = marginals.groupBy(*scope).agg(F.count(F.lit(1)).alias("labels"), F.sum(F.col("g").cast("double") * F.col("p")).alias("cross"), F.sum("g").alias("n"))
    agreed = both.groupBy(*scope).agg(F.avg((F.col("g") == F.col("p")).cast("int")).alias("po"))
    met = agreed.join(summed, list(scope)) if scope else agreed.join(summed)
    pe = ratio(F.col("cross"), F.col("n") * F.col("n"))
    value = F.when((F.col("labels") <= 1) | (pe == 1), 1.0).otherwise(F.try_divide(F.col("po") - pe, 1 - pe))
    return met.select(*scope, js_round(value, 4).alias("kappa"))


def agreement(pairs: DataFrame) -> DataFrame:
    """pairs: dimension, gold, predicted. samples, mae, rmse, spearman, kappa by dimension.

    Rows become counted cells (dimension, gold, predicted) before anything is shuffled, and every statistic is a weighted sum
    over cells; the ranks of a cell's values are joined to it.
    """
    use_shared_folder(pairs.sparkSession)
    cells = pairs.groupBy("dimension", "gold", "predicted").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    ranks = lambda side, name: average_ranks(cells.groupBy("dimension", side).agg(F.sum("n").alias("n")), ["dimension"], side, name=name).select(F.col("dimension").alias("__k"), F.col(side).alias("__v"), name)
    ranked = cells
    for side, name in (("gold", "rg"), ("predicted", "rp")):
        ranked = ranked.join(ranks(side, name), F.col("dimension").eqNullSafe(F.col("__k")) & F.col(side).eqNullSafe(F.col("__v"))).drop("__k", "__v")
    off, w = F.col("predicted") - F.col("gold"), F.col("n")
    n, sx, sy, known = F.sum(w), F.sum(w * F.col("rg")), F.sum(w * F.col("rp")), F.sum(F.when(off.isNotNull(), w))
    cov = n * F.sum(w * F.col("rg") * F.col("rp")) - sx * sy
    spread = F.sqrt(F.greatest(F.lit(0.0), n * F.sum(w * F.col("rg") * F.col("rg")) - sx * sx)) * F.sqrt(F.greatest(F.lit(0.0), n * F.sum(w * F.col("rp") * F.col("rp")) - sy * sy))
    stats = ranked.groupBy("dimension").agg(n.alias("samples"), js_round(F.sum(w * F.abs(off)) / known, 4).alias("mae"), js_round(F.sqrt(F.sum(w * off * off) / known), 4).alias("rmse"), F.when(n > 1, js_round(F.coalesce(F.try_divide(cov, spread), F.lit(0.0)), 4)).alias("spearman"))
    return stats.join(kappa(pairs, score_bucket(F.col("gold")), score_bucket(F.col("predicted")), "dimension"), "dimension")


def overall_agreement(per_dimension: DataFrame) -> DataFrame:
    mean = lambda c: js_round(F.avg(c), 4).alias(c)
    return per_dimension.agg(F.coalesce(F.sum("samples"), F.lit(0)).alias("samples"), mean("mae"), mean("rmse"), mean("spearman"), mean("kappa"))


def status_agreement(pairs: DataFrame) -> DataFrame:
    """pairs: gold_status, predicted_status. samples, accuracy, kappa."""
    counts = pairs.agg(F.count(F.lit(1)).alias("samples"), js_round(F.coalesce(F.avg((F.col("gold_status") == F.col("predicted_status")).cast("int")), F.lit(0.0)), 4).alias("accuracy"))
    return counts.join(kappa(pairs, F.col("gold_status"), F.col("predicted_status")))


def judge_drift(baseline: DataFrame, candidate: DataFrame, warn: float = 0.4) -> DataFrame:
    """Both: case_id, dimension, score. Per dimension the mean and the largest move, and whether it warns."""
    move = F.col("candidate") - F.col("baseline")
    met = baseline.select("case_id", "dimension", F.col("score").alias("baseline")).join(candidate.select("case_id", "dimension", F.col("score").alias("candidate")), ["case_id", "dimension"])
    out = met.groupBy("dimension").agg(F.count(F.lit(1)).alias("cases"), js_round(F.avg(move), 4).alias("avg_delta"), js_round(F.max(F.abs(move)), 4).alias("max_delta"))
    return out.withColumn("warns", F.abs("avg_delta") >= warn)


def field_drift(baseline: DataFrame, candidate: DataFrame, warn: float = 0.4) -> DataFrame:
    """Both: case_id, goal_completion, recovery_trace (scores, null where a judge gave none). field, cases, avg_delta, warns."""
    fields = ("goal_completion", "recovery_trace")
    both = baseline.select("case_id", *[F.col(f).alias(f"b_{f}") for f in fields]).join(candidate.select("case_id", *[F.col(f).alias(f"c_{f}") for f in fields]), "case_id")
    moves = both.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f"c_{f}") - F.col(f"b_{f}")).alias("move")) for f in fields])).alias("x")).select("x.*")
    out = moves.groupBy("field").agg(F.count("move").alias("cases"), js_round(F.avg("move"), 4).alias("avg_delta"))
    return out.withColumn("warns", F.coalesce(F.abs("avg_delta") >= warn, F.lit(False)))


# Limits of the gate.
GATE = {"mae": 1.8, "goal_accuracy": 0.25, "recovery_accuracy": 0.25, "samples": 4, "drift": 0.4}


def judge_gate(overall: DataFrame, goal: DataFrame, recovery: DataFrame, drift: DataFrame | None = None, limits: dict = GATE) -> DataFrame:
    """check, value, limit, passed of every check; the gate passes if all do."""
    o = overall.select(F.col("mae").cast("double").alias("mae"), F.col("samples").cast("double").alias("samples")).join(goal.select(F.col("accuracy").alias("ga"))).join(recovery.select(F.col("accuracy").alias("ra")))
    checks = [("overall_mae", F.col("mae"), limits["mae"], F.col("mae") <= limits["mae"]), ("samples", F.col("samples"), limits["samples"], F.col("samples") >= limits["samples"]), ("goal_accuracy", F.col("ga"), limits["goal_accuracy"], F.col("ga") >= limits["goal_accuracy"]), ("recovery_accuracy", F.col("ra"), limits["recovery_accuracy"], F.col("ra") >= limits["recovery_accuracy"])]
    row = lambda name, value, limit, ok: F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"), F.lit(float(limit)).alias("limit"), F.coalesce(ok, F.lit(False)).alias("passed"))
    out = o.select(F.explode(F.array(*[row(*c) for c in checks])).alias("x")).select("x.*")
    if drift is not None:
        out = out.unionByName(drift.select(F.concat(F.lit("drift:"), "dimension").alias("check"), F.abs("avg_delta").alias("value"), F.lit(float(limits["drift"])).alias("limit"), (F.abs("avg_delta") <= limits["drift"]).alias("passed")))
    return out


def gold_coverage(tasks: DataFrame, *by: str) -> DataFrame:
    return tasks.groupBy(*by).agg(F.count(F.lit(1)).alias("tasks"), F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("assignee").isNull()).alias("unassigned"))


def coverage_gaps(coverage: DataFrame, wanted: int) -> DataFrame:
    return coverage.withColumn("missing", F.greatest(F.lit(0), F.lit(wanted) - F.col("approved")))


def count_by(rows: DataFrame, key: Column) -> DataFrame:
    """key, count: the commonest first, then by name; blank keys count as unassigned."""
    named = F.coalesce(F.nullif(F.trim(key.cast("string")), F.lit("")), F.lit("unassigned"))
    return rows.groupBy(named.alias("key")).count().orderBy(F.desc("count"), "key")


def coverage_readiness(cases: DataFrame, drafts: DataFrame, labels: DataFrame, target: int, approved_share: float = 0.8) -> DataFrame:
    """drafts: case_id, review_status, no_evidence. One row: counts, gaps to the target and what is ready."""
    wanted = F.ceil(F.lit(target * approved_share)).cast("bigint")
    n = cases.agg(F.count(F.lit(1)).alias("cases")).join(drafts.agg(F.count(F.lit(1)).alias("drafts"), F.count_if(F.col("review_status") == "approved").alias("approved"), F.count_if("no_evidence").alias("without_evidence"))).join(labels.agg(F.count(F.lit(1)).alias("labels")))  # one row each
    return n.select("*", F.greatest(F.lit(0), F.lit(target) - F.col("cases")).alias("case_gap"), F.greatest(F.lit(0), wanted - F.col("approved")).alias("approved_gap"), (F.col("cases") >= target).alias("pool_ready"), (F.col("approved") >= wanted).alias("labels_ready"), (F.col("labels") == F.col("approved")).alias("imported_all"), (F.col("without_evidence") == 0).alias("evidence_ready"))


def _turn(place: Column, people: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in people]), (F.pmod(place, F.lit(len(people))) + 1).cast("int")) if people else F.lit(None).cast("string")


def annotation_tasks(cases: DataFrame, version: str, assignees: list[str], reviewers: list[str], priority: str = "P1") -> DataFrame:
    """cases: case_id, rows (array of struct role, content), notes. A draft task each, with its counts and its people by turns.

    People take turns in the order of case_id, which range partitions number.
    """
    of = lambda role: F.size(F.filter("rows", lambda r: r["role"] == role))
    task = F.concat(F.lit(f"{version}_"), context_id(F.col("case_id").cast("string")), F.lit("_label"))
    narrow = cases.select(task.alias("task_id"), "case_id", F.size("rows").alias("messages"), of("user").alias("user_messages"), of("assistant").alias("assistant_messages"), (F.trim(F.coalesce("notes", F.lit(""))) != "").alias("has_notes"))
    n = F.col("__place")
    return numbered(narrow, "case_id", name="__place").select("task_id", "case_id", F.lit(priority).alias("priority"), F.lit("draft").alias("status"), _turn(n, assignees).alias("assignee"), _turn(n, reviewers).alias("reviewer"), "messages", "user_messages", "assistant_messages", "has_notes")


def assign_round_robin(cases: DataFrame, people: list[str], order: str = "case_id") -> DataFrame:
    """Each case gets the person whose turn it is in order of the cases, which range partitions number."""
    return numbered(cases, order, name="__place").withColumn("assignee", _turn(F.col("__place"), people)).drop("__place")


# Dimensions that a gold label must have, and the statuses that it may name.
GOLD_DIMENSIONS = ["empathy", "on_topic", "not_preachy", "recovery"]
GOAL_STATUSES, RECOVERY_STATUSES = ("achieved", "partial", "failed", "unclear"), ("none", "completed", "failed")


def validate_labels(labels: DataFrame, required: list[str] = GOLD_DIMENSIONS, cases: DataFrame | None = None) -> DataFrame:
    """labels: case_id, dimensions (array of struct dimension, score, evidence), status; and, where there are such columns,
    labeler, reviewer, reviewed_at, goal (struct status, score, evidence array), trace (struct status, quality).

    Adds errors and valid, which also asks for approval. cases: the known ones, else any case will do.
    """
    given = dict(labels.dtypes)
    blank = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""
    names = F.array(*[F.lit(r) for r in required])
    bad = F.filter("dimensions", lambda d: ~d["score"].between(1, 5) | d["score"].isNull())
    parts = [F.transform(F.array_except(names, F.transform("dimensions", lambda d: d["dimension"])), lambda d: F.concat(F.lit("missing:"), d)), F.transform(bad, lambda d: F.concat(F.lit("range:"), d["dimension"]))]
    if "evidence" in given["dimensions"]:
        parts.append(F.transform(F.filter("dimensions", lambda d: blank(d["evidence"])), lambda d: F.concat(F.lit("evidence:"), d["dimension"])))
    checks = [(blank(F.col(c)), c) for c in ("labeler", "reviewer", "reviewed_at") if c in given]
    if "goal" in given:
        good = F.col("goal.evidence")
        checks += [(~F.coalesce(F.col("goal.status").isin(*GOAL_STATUSES), F.lit(False)), "goal:status"), (~F.coalesce(F.col("goal.score").between(0, 5), F.lit(False)), "goal:score"), (F.coalesce((F.size(good) == 0) | F.exists(good, blank), F.lit(True)), "goal:evidence")]
    if "trace" in given:
        none = F.coalesce((F.col("trace.status") == "none") & (F.col("trace.quality") != 0), F.lit(False))
        checks += [(~F.coalesce(F.col("trace.status").isin(*RECOVERY_STATUSES), F.lit(False)), "trace:status"), (~F.coalesce(F.col("trace.quality").between(0, 5), F.lit(False)), "trace:quality"), (none, "trace:none")]
    if cases is not None:
        labels = labels.join(cases.select("case_id").distinct().withColumn("known", F.lit(True)), "case_id", "left")
        checks.append((F.col("known").isNull(), "unknown-case"))
    checks.append((F.coalesce(F.col("status") != "approved", F.lit(True)), "not-approved"))
    errors = F.concat(*parts, F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in checks])))
    return labels.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0).drop("known")


def import_labels(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The labels that come in: approved and without an error; and a row of counts (imported, skipped, failed)."""
    approved = F.col("status") == "approved"
    counts = validated.agg(F.count_if("valid").alias("imported"), F.count_if(~F.coalesce(approved, F.lit(False))).alias("skipped"), F.count_if(approved & ~F.col("valid")).alias("failed"))
    return validated.filter("valid").drop("errors", "valid"), counts


def prefill_labels(cases: DataFrame) -> DataFrame:
    """cases: case_id, tags. A first score by dimension from the tags of the case."""
    has = lambda t: F.array_contains("tags", t)
    scores = {"empathy": F.when(has("emotion_drop"), 2).otherwise(3), "on_topic": F.when(has("off_topic_shift") | has("understanding_barrier"), 2).otherwise(4), "not_preachy": F.lit(4), "recovery": F.when(has("recovery_failed"), 1).when(has("emotion_drop"), 2).otherwise(3)}
    return cases.select("case_id", F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("score")) for k, v in scores.items()])).alias("x")).select("case_id", "x.*")
