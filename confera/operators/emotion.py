"""Emotion of topic segments by rule: cue counts, weights of the exchange, and the final score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confera.functions.lexicon import ZH, Lexicon
from confera.functions.text import factor, penalty, ratio, score100

KEY = ["session_id", "topic_segment_index"]


def emotion_cues(turns: DataFrame, lexicon: Lexicon = ZH) -> DataFrame:
    """Per segment, the counts and averages that the scores are made of. Gaps count within the segment and only above 0."""
    text, user, assistant = F.col("content"), F.col("role") == "user", F.col("role") == "assistant"
    n = lambda test: F.count_if(test)
    inner_gap = F.when((F.col("response_gap_sec") > 0) & (F.col("turn_index") > F.col("segment_start")), F.col("response_gap_sec"))
    started = turns.join(turns.groupBy(*KEY).agg(F.min("turn_index").alias("segment_start")), KEY)
    return started.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_rows"), n(text.rlike(lexicon.negative)).alias("n_negative"), n(text.rlike(lexicon.positive)).alias("n_positive"), n(assistant & text.rlike(lexicon.empathy)).alias("n_empathy"), n(assistant & text.rlike(lexicon.preachy)).alias("n_preachy"),
        F.coalesce(F.avg(inner_gap), F.lit(0.0)).alias("avg_gap"), F.coalesce(F.avg(F.when(user, F.col("content_length"))), F.lit(0.0)).alias("avg_user_length"), F.coalesce(F.avg(F.when(assistant, F.col("content_length"))), F.lit(0.0)).alias("avg_assistant_length"),
        F.max_by("role", "turn_index").alias("last_role"), F.coalesce(F.min_by(text.rlike(lexicon.negative), F.when(user, F.col("turn_index"))), F.lit(False)).alias("first_negative"), F.coalesce(F.max_by(text.rlike(lexicon.positive), F.when(user, F.col("turn_index"))), F.lit(False)).alias("last_positive"),
        F.coalesce(F.min_by("content", F.when(text.rlike(lexicon.negative) | text.rlike(lexicon.positive), F.col("turn_index"))), F.min_by("content", "turn_index")).alias("emotion_evidence"),
    )


def emotion_baseline(cues: DataFrame) -> DataFrame:
    """Adds emotion_polarity, emotion_intensity and emotion_base_score."""
    p, n = F.col("n_positive"), F.col("n_negative")
    polarity = F.when(n >= p + 2, "negative").when(p >= n + 2, "positive").when((n > 0) & (p > 0), "mixed").otherwise("neutral")
    share = ratio(F.greatest(n, p), F.greatest(F.lit(1), F.col("n_rows")))
    base = F.when(F.col("emotion_polarity") == "negative", 34 + p * 2 - n * 1.5).when(F.col("emotion_polarity") == "positive", 72.0 + p * 2 - n).when(F.col("emotion_polarity") == "mixed", 55.0 + p - n).otherwise(52.0)
    cues = cues.withColumns({"emotion_polarity": polarity, "emotion_intensity": F.when(share >= 0.5, "high").when(share >= 0.25, "medium").otherwise("low")})
    return cues.withColumn("emotion_base_score", score100(base))


def emotion_scores(scored: DataFrame) -> DataFrame:
    """Adds the six weights and emotion_score."""
    c, negative = F.col, F.col("emotion_polarity") == "negative"
    supportive = c("n_empathy") > 0
    weights = {
        "valence_weight": factor((c("n_positive") - c("n_negative")) / F.greatest(F.lit(1), c("n_rows")) * 12),
        "length_weight": factor(F.when(c("avg_user_length") >= 14, 2.5).when(c("avg_user_length") <= 7, -2.5).otherwise(0.0) + F.when(c("avg_assistant_length") >= 28, -1.5).when(c("avg_assistant_length") <= 10, -1.0).otherwise(0.8)),
        "style_weight": factor(c("n_empathy") * 1.5 - c("n_preachy") * 3.0),
        "gap_weight": F.when(c("avg_gap") > 90, -5.0).when(c("avg_gap") > 45, -2.0).when((c("avg_gap") > 0) & (c("avg_gap") < 20), 1.5).otherwise(0.0),
        "recovery_weight": F.when(c("first_negative") & c("last_positive"), 6.0).when(c("first_negative") & supportive, 3.5).when(negative & ~supportive, -3.0).otherwise(0.0),
        "risk_penalty": penalty(F.when(c("last_role") == "assistant", 1.2).otherwise(0.0) + F.when(negative & (c("emotion_intensity") == "high"), 2.8).otherwise(0.0) + F.when((c("avg_user_length") <= 6) & negative, 1.5).otherwise(0.0)),
    }
    total = c("emotion_base_score") + c("valence_weight") + c("length_weight") + c("style_weight") + c("gap_weight") + c("recovery_weight") - c("risk_penalty")
    return scored.withColumns(weights).withColumn("emotion_score", score100(total))


def segment_emotions(turns: DataFrame, lexicon: Lexicon = ZH) -> DataFrame:
    return emotion_scores(emotion_baseline(emotion_cues(turns, lexicon)))
