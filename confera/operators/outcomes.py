"""Outcomes of sessions: turning points, whether the goal was reached, and whether a failure was repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confera.functions.lexicon import ZH, Lexicon, any_of
from confera.functions.text import clamp, js_round, question_fingerprint, trimmed, truncated, utf16_length
from confera.operators.sessionize import in_order, asked_then_switched

ORDER = ["session_seq", "turn_index"]


def turning_points(turns: DataFrame, least: float = 12.0) -> DataFrame:
    delta = F.col("emotion_score") - F.lag("emotion_score").over(in_order())
    moved = turns.withColumn("delta", delta).filter(F.abs("delta") >= least)
    return moved.select("session_id", "turn_index", F.when(F.col("delta") > 0, "up").otherwise("down").alias("direction"), js_round(F.col("delta"), 1).alias("score_delta"))


def goal_completion(turns: DataFrame, lexicon: Lexicon = ZH) -> DataFrame:
    """Per session: status, score, confidence, triggered_rules, achievement_evidence, failure_reasons, from phrases and course."""
    text, user, turn = F.col("content"), F.col("role") == "user", F.col("turn_index")
    back = Window.partitionBy("session_id", "role").orderBy(F.desc("turn_index"))
    marked = turns.withColumns({"from_end": F.row_number().over(back), "session_rows": F.count(F.lit(1)).over(Window.partitionBy("session_id"))})
    place = F.struct("turn_index", truncated(text, 60).alias("said"))
    first = lambda test: F.min_by(place, F.when(test, turn))
    solved = (F.col("role") == "assistant") & any_of(text, lexicon.goal_resolution)
    third = F.greatest(F.lit(1), F.floor(F.col("session_rows") / 3))
    facts = marked.groupBy("session_id").agg(
        first(user & (F.col("from_end") <= 2) & any_of(text, lexicon.goal_give_up)).alias("give_up"), first(user & any_of(text, lexicon.goal_escalation)).alias("escalated"), first(user & any_of(text, lexicon.goal_failure)).alias("failure"),
        F.max_by(F.struct("turn_index", truncated(text, 80).alias("said")), F.when(solved, turn)).alias("solved"), F.max(F.when(user & F.col("is_question"), turn)).alias("last_question"),
        F.max_by(F.struct((any_of(text, lexicon.goal_appreciation) & (utf16_length(trimmed(text)) <= 20)).alias("ok"), truncated(text, 60).alias("said")), F.when(user, turn)).alias("closing"),
        F.max("session_rows").alias("n"), F.max_by("emotion_score", "turn_index").alias("last_emotion"), F.avg(F.when(turn <= third, F.col("emotion_score"))).alias("first_emotion"),
    )
    asked = turns.filter(user & F.col("is_question")).groupBy("session_id", question_fingerprint(text, 20).alias("fp")).count().filter("fp <> ''").groupBy("session_id").agg(F.max("count").alias("repeats"))
    facts = facts.join(asked, "session_id", "left")
    failing = [
        ("user-give-up", F.col("give_up").isNotNull(), F.concat(F.lit("gave up at turn "), F.col("give_up.turn_index").cast("string"), F.lit(": "), F.col("give_up.said"))),
        ("escalation-keyword", F.col("escalated").isNotNull(), F.concat(F.lit("escalated at turn "), F.col("escalated.turn_index").cast("string"), F.lit(": "), F.col("escalated.said"))),
        ("explicit-failure-phrase", F.col("failure").isNotNull(), F.concat(F.lit("unsolved at turn "), F.col("failure.turn_index").cast("string"), F.lit(": "), F.col("failure.said"))),
        ("user-repeat-question-3x", F.coalesce(F.col("repeats") >= 3, F.lit(False)), F.concat(F.lit("asked again, times: "), F.col("repeats").cast("string"))),
    ]
    reaching = [
        ("assistant-resolution-stated", F.col("solved").isNotNull() & ~F.coalesce(F.col("last_question") > F.col("solved.turn_index"), F.lit(False)), F.concat(F.lit("solved at turn "), F.col("solved.turn_index").cast("string"), F.lit(": "), F.col("solved.said"))),
        ("user-appreciation-close", F.coalesce(F.col("closing.ok"), F.lit(False)), F.concat(F.lit("closed with: "), F.col("closing.said"))),
        ("emotion-uplift-at-close", (F.col("n") >= 4) & (F.col("last_emotion") >= 65) & (F.col("last_emotion") - F.col("first_emotion") >= 15), F.concat(F.lit("emotion rose to "), F.col("last_emotion").cast("string"))),
    ]
    listed = lambda rules, k: F.array_compact(F.array(*[F.when(r[1], r[k] if k else F.lit(r[0])) for r in rules]))
    facts = facts.withColumns({"failure_reasons": listed(failing, 2), "achievement_evidence": listed(reaching, 2), "triggered_rules": F.concat(listed(failing, 0), listed(reaching, 0))})
    bad, good = F.size("failure_reasons"), F.size("achievement_evidence")
    status = F.when((bad > 0) & (good == 0), "failed").when((good > 0) & (bad == 0), "achieved").when(good > 0, "partial").otherwise("unclear")
    facts = facts.withColumn("status", status)
    score = F.when(status == "failed", F.when(bad >= 2, 1).otherwise(2)).when(status == "achieved", F.when(good >= 2, 5).otherwise(4)).otherwise(3)
    sure = F.when(status == "failed", 0.74).when(status == "achieved", 0.76).when(status == "partial", 0.6).otherwise(0.45)
    return facts.select("session_id", "status", score.alias("score"), sure.alias("confidence"), "triggered_rules", "achievement_evidence", "failure_reasons")


def failure_candidates(turns: DataFrame, lexicon: Lexicon = ZH) -> DataFrame:
    """Per session the earliest failure: turn, kind; of one turn low emotion before an ignored question before confusion."""
    turn = F.col("turn_index")
    low = F.min(F.when(F.col("emotion_score") <= 40, turn))
    ignored = F.min(F.when(asked_then_switched(), turn - 1))
    confused = F.min(F.when((F.col("role") == "user") & F.col("content").rlike(lexicon.confusion), turn))
    found = turns.groupBy("session_id").agg(low.alias("low"), ignored.alias("ignored"), confused.alias("confused"))
    kinds = [("low", 0, "emotion-drop", "emotion-score-drop"), ("ignored", 1, "ignore", "question-followed-by-topic-switch"), ("confused", 2, "understanding-barrier", "user-confusion-expression")]
    options = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("turn"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.lit(rule).alias("rule"))) for c, rank, kind, rule in kinds]))
    return found.select("session_id", F.array_min(options).alias("c")).filter("c is not null").select("session_id", F.col("c.turn").alias("failure_turn"), F.col("c.kind").alias("failure_kind"), F.col("c.rule").alias("failure_rule"))


def _repair(row: Column, lexicon: Lexicon) -> tuple[Column, Column, Column]:
    return any_of(row, lexicon.apology), any_of(row, lexicon.rephrase), any_of(row, lexicon.clarification)


def recovery_traces(turns: DataFrame, goals: DataFrame, lexicon: Lexicon = ZH, reach: int = 4) -> DataFrame:
    """Per session: none, failed or completed; where it failed and recovered, by which strategy and how well."""
    sorry, again, clear = _repair(F.col("content"), lexicon)
    failures = failure_candidates(turns, lexicon)
    rows = turns.join(failures, "session_id")
    at_failure = F.max(F.when(F.col("turn_index") == F.col("failure_turn"), F.col("emotion_score"))).over(Window.partitionBy("session_id"))
    near = rows.withColumn("failure_score", F.coalesce(at_failure, F.lit(40.0))).filter((F.col("role") == "assistant") & (F.col("turn_index") > F.col("failure_turn")) & (F.col("turn_index") <= F.col("failure_turn") + reach))
    repaired = (F.col("emotion_score") >= 60) | (F.col("emotion_score") - F.col("failure_score") >= 20) | sorry | again | clear
    strategy = F.when(sorry & again, "apologise-and-rephrase").when(clear, "clarify-and-continue").when(sorry, "apologise").when(F.col("is_question"), "ask-back").when(F.col("failure_kind") == "emotion-drop", "soothe").when(F.col("failure_kind") == "ignore", "return-to-question").otherwise("explain-again")
    trigger = F.when(sorry, "assistant-apology").when(again, "assistant-rephrase").when(clear, "assistant-clarification").when(F.col("emotion_score") >= 60, "emotion-score-recovered").otherwise("recovery-window-hit")
    point = F.struct(F.col("turn_index").alias("turn"), strategy.alias("strategy"), trigger.alias("rule"))
    points = near.groupBy("session_id").agg(F.min_by(point, F.when(repaired, F.col("turn_index"))).alias("first"), F.max_by(point, "turn_index").alias("last"))
    out = turns.groupBy("session_id").agg(F.max("turn_index").alias("n")).join(failures, "session_id", "left").join(points, "session_id", "left").join(goals.select("session_id", F.col("status").alias("goal")), "session_id", "left")
    chosen = F.coalesce("first", F.when(F.col("goal").isin("achieved", "partial"), F.col("last")))
    out = out.withColumn("r", chosen).withColumn("span", F.col("r.turn") - F.col("failure_turn"))
    status = F.when(F.col("failure_turn").isNull(), "none").when(F.col("r").isNull(), "failed").otherwise("completed")
    bonus = F.when(F.col("goal") == "achieved", 1.0).when(F.col("goal") == "partial", 0.5).when(F.col("goal") == "failed", -0.6).otherwise(0.0)
    quality = F.when(status == "none", 0.0).when(status == "failed", 1.6).otherwise(clamp(5 - F.col("span") * 0.5 + bonus, 0, 5, 1))
    rules = F.when(status == "none", F.array().cast("array<string>")).otherwise(F.array(F.col("failure_rule"), F.coalesce("r.rule", F.lit("recovery-not-found"))))
    return out.select("session_id", status.alias("status"), "failure_turn", F.col("r.turn").alias("recovery_turn"), F.col("span").alias("span_turns"), F.coalesce("failure_kind", F.lit("unknown")).alias("failure_kind"), F.col("r.strategy").alias("strategy"), quality.alias("quality_score"), rules.alias("triggered_rules"), F.when(status == "none", 0.45).when(status == "failed", 0.72).otherwise(0.79).alias("confidence"))


def trace_evidence(turns: DataFrame, traces: DataFrame, most: int = 5) -> DataFrame:
    """Up to five turns around each failure: from the turn before it to the recovery, or two after it."""
    last = Window.partitionBy("session_id")
    span = turns.withColumn("n", F.max("turn_index").over(last)).join(traces.filter("failure_turn is not null").select("session_id", "failure_turn", "recovery_turn"), "session_id")
    end = F.coalesce("recovery_turn", F.least(F.col("failure_turn") + 2, F.col("n")))
    inside = span.filter((F.col("turn_index") >= F.greatest(F.lit(1), F.col("failure_turn") - 1)) & (F.col("turn_index") <= end))
    ranked = inside.withColumn("k", F.row_number().over(in_order())).filter(F.col("k") <= most)
    return ranked.select("session_id", "turn_index", "role", truncated(F.col("content"), 120).alias("content"))
