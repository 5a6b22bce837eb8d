"""Bad cases: topics that show signs of failure, harvested, tagged and rated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confera.functions.lexicon import ZH, Lexicon
from confera.functions.text import js_round, question_fingerprint, transcript_hash, truncated, unit4
from confera.operators.sessionize import asked_then_switched

KEY = ["session_id", "topic_segment_index"]


def topic_facts(turns: DataFrame, lexicon: Lexicon = ZH) -> DataFrame:
    """Everything that harvest and rating need of a topic, in one aggregation."""
    text, user, turn = F.col("content"), F.col("role") == "user", F.col("turn_index")
    return turns.withColumn("kw", F.when(user, lexicon.keyword(text))).groupBy(*KEY).agg(
        F.coalesce(F.sum("kw.weight"), F.lit(0.0)).alias("keyword_weight"), F.count("kw.keyword").alias("keywords"), F.coalesce(F.max("response_gap_sec"), F.lit(0)).alias("max_gap"), F.count(F.lit(1)).alias("n_rows"), F.count_if("is_topic_switch").alias("switches"),
        F.max(user & text.rlike(lexicon.confusion)).alias("confused"), F.max(text.rlike(lexicon.case_escalation)).alias("escalated"), F.max(F.col("emotion_score") <= 40).alias("low"), F.max(asked_then_switched()).alias("drifted"),
        F.min("turn_index").alias("start_turn"), F.max("turn_index").alias("end_turn"), F.min("session_seq").alias("session_seq"), F.first("topic").alias("topic"), F.first("topic_segment_id").alias("topic_segment_id"),
        F.array_sort(F.collect_list(F.struct(turn, "role", "content"))).alias("turns"),
    )


def harvest(facts: DataFrame, objective: DataFrame, signals: DataFrame) -> DataFrame:
    """Adds harvest_severity (rounded, at most 1) and auto_signals (kinds found). High signals count for the session they name."""
    high = signals.filter("severity = 'high'").select(F.split("evidence_turn_range", ":")[0].alias("session_id")).groupBy("session_id").agg(F.count(F.lit(1)).alias("high_signals"))
    rate = objective.select("topic_switch_rate")  # one row
    met = facts.join(F.broadcast(high), "session_id", "left").join(F.broadcast(rate)).withColumn("high_signals", F.coalesce("high_signals", F.lit(0)))
    gap, short, moved = F.col("max_gap") >= 60, (F.col("n_rows") <= 2) & (F.col("keywords") > 0), (F.col("switches") > 0) | (F.col("topic_switch_rate") >= 0.8)
    total = F.col("keyword_weight") + F.when(gap, 0.18).otherwise(0.0) + F.when(short, 0.12).otherwise(0.0) + F.when(moved, 0.1).otherwise(0.0) + F.col("high_signals") * 0.14
    kinds = F.array_compact(F.array(F.when(F.col("keywords") > 0, "negative_keyword"), F.when(gap, "response_gap"), F.when(short, "short_turns"), F.when(moved, "topic_switch"), F.when(F.col("high_signals") > 0, "implicit_signal")))
    return met.withColumns({"harvest_severity": F.least(F.lit(1.0), js_round(total, 4)), "auto_signals": kinds})


def repeated_in_topic(turns: DataFrame) -> DataFrame:
    asked = turns.filter((F.col("role") == "user") & F.col("is_question")).groupBy(*KEY, question_fingerprint(F.col("content")).alias("fp")).count()
    return asked.filter("fp <> '' and count >= 2").select(*KEY).distinct().withColumn("repeated", F.lit(True))


def bad_cases(turns: DataFrame, objective: DataFrame, signals: DataFrame, goals: DataFrame, recoveries: DataFrame, lexicon: Lexicon = ZH, *, scenario: str = "generic", with_hash: bool = True) -> DataFrame:
    """One row per topic with at least one tag: severity, tags, transcript, duplicate group, action."""
    facts = harvest(topic_facts(turns, lexicon), objective, signals).join(repeated_in_topic(turns), KEY, "left")
    facts = facts.join(goals.select("session_id", F.col("status").alias("goal")), "session_id", "left").join(recoveries.select("session_id", F.col("status").alias("recovery")), "session_id", "left")
    no = F.lit(False)
    has = lambda kind: F.array_contains("auto_signals", kind)
    yes = lambda c: F.coalesce(F.col(c), no)
    gap = F.col("max_gap") >= 60
    failed = F.coalesce(F.col("recovery") == "failed", no)
    parts = [
        (F.col("goal") == "failed", 0.34), (F.col("goal") == "partial", 0.2), (F.col("goal") == "unclear", 0.12), (failed, 0.24), (yes("repeated"), 0.18), (yes("confused"), 0.16), (yes("escalated"), 0.22), (yes("low"), 0.14), (yes("drifted"), 0.16), (gap, 0.1),
    ]
    severity = F.col("harvest_severity")
    for test, weight in parts:
        severity = severity + F.when(test, weight).otherwise(0.0)
    tags = {
        "emotion_drop": yes("low"), "escalation_keyword": yes("escalated"), "goal_failed": F.col("goal") == "failed", "goal_partial": F.col("goal") == "partial", "goal_unclear": F.col("goal") == "unclear", "long_response_gap": gap | has("response_gap"),
        "off_topic_shift": yes("drifted") | has("topic_switch"), "question_repeat": yes("repeated"), "recovery_failed": failed, "understanding_barrier": yes("confused") | has("negative_keyword"),
    }
    cases = facts.withColumns({"severity": unit4(severity), "tags": F.array_compact(F.array(*[F.when(test, F.lit(tag)) for tag, test in tags.items()]))}).filter(F.size("tags") > 0)
    transcript = F.array_join(F.transform("turns", lambda r: F.concat(F.lit("[turn "), r["turn_index"].cast("string"), F.lit("] ["), r["role"], F.lit("] "), r["content"])), "\n")
    tagged = lambda *names: F.arrays_overlap("tags", F.array(*[F.lit(n) for n in names]))
    action = F.when(tagged("goal_failed"), "replay-failed-session").when(tagged("recovery_failed"), "add-repair-sequence").when(tagged("question_repeat", "understanding_barrier"), "answer-first").when(tagged("escalation_keyword"), "add-escalation-fallback").otherwise("add-to-pool")
    title = F.when(tagged("goal_failed"), "goal-missed").when(tagged("recovery_failed"), "recovery-failed").when(tagged("escalation_keyword"), "escalation-risk").otherwise("failure-sign")
    cases = cases.withColumns({"transcript": transcript, "suggested_action": action, "title": F.concat(title, F.lit(" at turn "), F.col("start_turn").cast("string"), F.lit(": "), truncated(F.col("turns")[0]["content"], 24, 23)), "duplicate_group": F.concat_ws(":", F.lit(scenario), "topic", F.array_join("tags", "+"))})
    if with_hash:
        cases = cases.withColumn("transcript_hash", transcript_hash(F.col("transcript")))
    keep = [*KEY, "session_seq", "topic_segment_id", "topic", "start_turn", "end_turn", "severity", "tags", "auto_signals", "title", "suggested_action", "duplicate_group", "transcript"]
    return cases.select(*keep, *(["transcript_hash"] if with_hash else []))


def by_severity(cases: DataFrame, most: int | None = None) -> DataFrame:
    ordered = cases.orderBy(F.desc("severity"), "session_seq", "topic_segment_index")
    return ordered.limit(most) if most else ordered


def dominant_tags(cases: DataFrame, most: int = 3) -> DataFrame:
    return cases.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("cases")).orderBy(F.desc("cases"), "tag").limit(most)


# What each tag takes from a baseline score, for the objective and the subjective record.
OBJECTIVE_PENALTY = {"question_repeat": 0.2, "escalation_keyword": 0.24, "off_topic_shift": 0.18, "long_response_gap": 0.12}
SUBJECTIVE_PENALTY = {"goal_failed": 0.34, "goal_partial": 0.18, "goal_unclear": 0.1, "recovery_failed": 0.24, "understanding_barrier": 0.16, "emotion_drop": 0.14}


def baseline_scores(cases: DataFrame) -> DataFrame:
    left = lambda table: unit4(1 - sum((F.when(F.array_contains("tags", t), w).otherwise(0.0) for t, w in table.items()), F.lit(0.0)))
    cases = cases.withColumns({"objective_score": left(OBJECTIVE_PENALTY), "subjective_score": left(SUBJECTIVE_PENALTY)})
    return cases.withColumn("case_score", unit4((F.col("objective_score") + F.col("subjective_score")) / 2))


def match_evidence(evidence: DataFrame, turns: DataFrame, start: int = 20) -> DataFrame:
    """evidence: session_id, said. The first turn of the session whose beginning it quotes, or that holds it whole."""
    quoted = F.contains(F.col("said"), truncated(F.col("content"), start)) | F.contains(F.col("content"), F.col("said"))
    met = evidence.join(turns.select("session_id", "turn_index", "role", "content"), "session_id").filter(quoted)
    return met.groupBy("session_id", "said").agg(F.min_by(F.struct("turn_index", "role", "content"), "turn_index").alias("t")).select("session_id", "said", "t.*")
