"""Turns of sessions: order, gaps and flags. Everything is a window over one exchange on the session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confera.functions.lexicon import ZH, Lexicon
from confera.functions.text import parse_time_ms, token_estimate, utf16_length


def session():
    return Window.partitionBy("session_id")


def in_order():
    return session().orderBy("turn_index")


def number_turns(rows: DataFrame) -> DataFrame:
    """rows: session_id, ts_raw, role, content, ingest_seq. Adds ts_ms, turn_index (from 1) and active_hour.

    Unreadable times sort last in their session; ties keep the order of ingestion.
    """
    rows = rows.withColumn("ts_ms", parse_time_ms(F.col("ts_raw"))) if "ts_ms" not in rows.columns else rows
    order = session().orderBy(F.col("ts_ms").asc_nulls_last(), "ingest_seq")
    return rows.withColumns({"turn_index": F.row_number().over(order), "active_hour": F.hour(F.timestamp_millis("ts_ms"))})


def response_gap(ts_ms: Column) -> Column:
    """Whole seconds since the turn before, never negative; null if either time is."""
    seconds = F.floor((ts_ms - F.lag(ts_ms).over(in_order())) / 1000 + 0.5)
    return F.when(seconds < 0, 0).otherwise(seconds)


def flag_turns(turns: DataFrame, lexicon: Lexicon = ZH) -> DataFrame:
    """Adds response_gap_sec, is_dropoff, is_question, token_estimate and content_length."""
    content = F.col("content")
    return turns.withColumns(
        {
            "response_gap_sec": response_gap(F.col("ts_ms")),
            "is_dropoff": (F.col("turn_index") == F.max("turn_index").over(session())) & (F.col("role") == "assistant"),
            "is_question": content.rlike(lexicon.question),
            "token_estimate": token_estimate(content),
            "content_length": utf16_length(content),
        }
    )


def mark_switches(turns: DataFrame) -> DataFrame:
    """Adds is_topic_switch, prev_role and prev_question from topic_segment_index."""
    before = F.lag("topic_segment_index").over(in_order())
    return turns.withColumns({"is_topic_switch": F.coalesce(before != F.col("topic_segment_index"), F.lit(False)), "prev_role": F.lag("role").over(in_order()), "prev_question": F.lag("is_question").over(in_order())})


def asked_then_switched() -> Column:
    """An assistant turn that changes the topic right after a user's question."""
    return F.coalesce((F.col("prev_role") == "user") & F.col("prev_question") & (F.col("role") == "assistant") & F.col("is_topic_switch"), F.lit(False))
