"""Implicit risk signals over all sessions: one row per signal, each from single-row aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confera.functions.lexicon import ZH, Lexicon
from confera.functions.text import band, clamp, question_fingerprint, ratio
from confera.operators.metrics import dataset_index
from confera.operators.sessionize import in_order, asked_then_switched

ORDER = ["session_seq", "turn_index"]


def _row(turns_columns: tuple[str, ...] = ("session_id", "turn_index", "content", "end_turn")) -> Column:
    return F.struct(*[F.col(c) for c in turns_columns])


def _signal(key: str, base: float, rules: list[tuple[str, float, Column]], evidence: Column, first: Column, last: Column, found: float, none: float) -> list[Column]:
    hit = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, _, test in rules]))
    score = reduce(lambda a, x: a + F.when(x[2], x[1]).otherwise(0.0), rules, F.lit(base))
    score = clamp(score, 0, 1, 2)
    return [
        F.lit(key).alias("signal_key"), score.alias("score"), band(score, 0.7, 0.4).alias("severity"), hit.alias("triggered_rules"),
        F.coalesce(F.concat(F.lit("[turn "), evidence["turn_index"].cast("string"), F.lit("] "), evidence["content"]), F.lit("none")).alias("evidence"),
        F.coalesce(F.concat(evidence["session_id"], F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string")), F.lit("unknown")).alias("evidence_turn_range"), F.when(F.size(hit) > 0, found).otherwise(none).alias("confidence"),
    ]


def interest_decline(turns: DataFrame) -> DataFrame:
    """Later user messages are shorter, slower, or ask less than earlier ones; halves of the dataset's user turns."""
    users = dataset_index(turns.filter("role = 'user'").select("session_seq", "turn_index", "content_length", "response_gap_sec", "is_question"))
    size = turns.agg(F.count_if(F.col("role") == "user").alias("n"))
    halves = users.join(F.broadcast(size)).withColumn("early", F.col("dataset_index") < F.greatest(F.lit(1), F.ceil(F.col("n") / 2)))
    gap = F.coalesce("response_gap_sec", F.lit(0))
    half = lambda x, early: F.avg(F.when(F.col("early") == early, x))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    stats = halves.agg(
        zero(half(F.col("content_length"), True)).alias("early_len"), zero(half(F.col("content_length"), False)).alias("late_len"), zero(half(gap, True)).alias("early_gap"), zero(half(gap, False)).alias("late_gap"),
        zero(half(F.col("is_question").cast("int"), True)).alias("early_q"), zero(half(F.col("is_question").cast("int"), False)).alias("late_q"),
    ).join(turns.agg(F.max_by(_row(), F.when(F.col("role") == "user", F.struct(*ORDER))).alias("e"), F.max_by(_row(), F.struct(*ORDER)).alias("any")))
    e = F.coalesce("e", "any")
    rules = [("shorter_replies", 0.26, F.col("late_len") < F.col("early_len") * 0.78), ("longer_gaps", 0.28, F.col("late_gap") > F.greatest(F.lit(30.0), F.col("early_gap") * 1.4)), ("fewer_questions", 0.18, (F.col("late_q") < F.col("early_q")) & (F.col("early_q") > 0))]
    return stats.select(*_signal("interest_decline", 0.22, rules, e, F.greatest(F.lit(1), e["turn_index"] - 2), e["turn_index"], 0.78, 0.62))


def understanding_barrier(turns: DataFrame, lexicon: Lexicon = ZH) -> DataFrame:
    user, place = F.col("role") == "user", F.struct(*ORDER)
    confused = user & F.col("content").rlike(lexicon.confusion)
    repeated = turns.filter(user & F.col("is_question")).groupBy(question_fingerprint(F.col("content")).alias("fp")).count().filter("fp <> ''").agg(F.coalesce(F.max("count") >= 2, F.lit(False)).alias("repeated"))
    stats = turns.agg(
        F.coalesce(F.max(confused), F.lit(False)).alias("confused"), F.coalesce(F.max(asked_then_switched()), F.lit(False)).alias("drifted"),
        F.coalesce(F.min_by(_row(), F.when(confused, place)), F.min_by(_row(), F.when(user & F.col("is_question"), place)), F.min_by(_row(), place)).alias("e"),
    ).join(repeated)
    rules = [("confusion", 0.3, F.col("confused")), ("repeated_question", 0.28, F.col("repeated")), ("drift_after_question", 0.18, F.col("drifted"))]
    return stats.select(*_signal("understanding_barrier", 0.2, rules, F.col("e"), F.col("e.turn_index"), F.col("e.turn_index"), 0.81, 0.6))


def unresolved_low(turns: DataFrame) -> DataFrame:
    """Turns with emotion of 40 or less, and whether none of the next four turns of the session reaches 60."""
    ahead = F.max("emotion_score").over(Window.partitionBy("session_id").orderBy("turn_index").rangeBetween(1, 4))
    return turns.withColumn("unresolved", (F.col("emotion_score") <= 40) & ~F.coalesce(ahead >= 60, F.lit(False)))


def recovery_failure(turns: DataFrame) -> DataFrame:
    place, low = F.struct(*ORDER), F.col("emotion_score") <= 40
    marked = unresolved_low(turns).withColumn("before", F.lag("emotion_score").over(in_order()))
    stats = marked.agg(
        F.coalesce(F.max("unresolved"), F.lit(False)).alias("unresolved"), F.coalesce(F.max(F.col("is_dropoff") & (F.col("before") <= 40)), F.lit(False)).alias("left_low"),
        F.coalesce(F.min_by(_row(), F.when(F.col("unresolved"), place)), F.min_by(_row(), F.when(low, place)), F.min_by(_row(), place)).alias("e"),
    )
    rules = [("low_persists", 0.34, F.col("unresolved")), ("left_while_low", 0.22, F.col("left_low"))]
    return stats.select(*_signal("recovery_failure", 0.22, rules, F.col("e"), F.col("e.turn_index"), F.least(F.col("e.turn_index") + 4, F.col("e.end_turn")), 0.83, 0.64))


def implicit_signals(turns: DataFrame, lexicon: Lexicon = ZH) -> DataFrame:
    return interest_decline(turns).unionByName(understanding_barrier(turns, lexicon)).unionByName(recovery_failure(turns))


def rule_dimensions(turns: DataFrame, signals: DataFrame, lexicon: Lexicon = ZH) -> DataFrame:
    """dimension, score (1 to 5): empathy, staying on topic, not preaching, recovery."""
    text, assistant = F.col("content"), F.col("role") == "assistant"
    stats = turns.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(assistant).alias("a"), F.count_if(assistant & text.rlike(lexicon.dimension_empathy)).alias("kind"), F.count_if(assistant & text.rlike(lexicon.dimension_preachy)).alias("preachy"),
        F.count_if("is_topic_switch").alias("switches"), F.count_if(F.col("emotion_score") <= 40).alias("low"), F.count_if(F.col("emotion_score") >= 65).alias("high"),
    )
    risk = lambda key: F.coalesce(F.max(F.when(F.col("signal_key") == key, F.col("score"))), F.lit(0.0))
    stats = stats.join(signals.agg(risk("understanding_barrier").alias("barrier"), risk("recovery_failure").alias("failure")))
    whole = lambda x: clamp(x, 1, 5, 0).cast("int")
    scores = {
        "empathy": F.when(F.col("a") == 0, 1).otherwise(whole(ratio(F.col("kind"), F.col("a")) * 5)),
        "on_topic": F.when(F.col("n") == 0, 1).otherwise(whole(5 - ratio(F.col("switches"), F.col("n")) * 8 - F.col("barrier") * 2)),
        "not_preachy": F.when(F.col("a") == 0, 1).otherwise(whole(5 - ratio(F.col("preachy"), F.col("a")) * 10)),
        "recovery": F.when(F.col("low") == 0, whole(4 - F.col("failure"))).otherwise(whole(ratio(F.col("high"), F.col("low")) * 2.5 + (1 - F.col("failure")))),
    }
    return stats.select(F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), v.cast("int").alias("score")) for k, v in scores.items()])).alias("x")).select("x.*")


def merge_dimensions(judged: DataFrame) -> DataFrame:
    """judged: dimension, score, rows of several judgements; their mean weighted by rows."""
    return judged.groupBy("dimension").agg(clamp(ratio(F.sum(F.col("score") * F.col("rows")), F.sum("rows")), 1, 5, 2).alias("score"))
