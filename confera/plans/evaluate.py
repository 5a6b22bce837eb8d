"""The evaluation plan: from turns to every result, as lazy frames over one enriched table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confera.functions.lexicon import ZH, Lexicon
from confera.operators import badcase, emotion, kpi, metrics, outcomes, segment, sessionize, signals
from confera.operators.store import use_shared_folder


def enrich(turns: DataFrame, lexicon: Lexicon = ZH, *, eager_user_breaks: bool = True, by_row: bool = False) -> DataFrame:
    """turns: session_id, session_seq, turn_index, role, content, ts_ms. Adds flags, segments and their emotion.

    by_row: segments by the running-sum part of the rules alone, without the sequential scan.
    """
    flagged = sessionize.flag_turns(turns, lexicon)
    segmented = segment.row_splits(flagged, lexicon) if by_row else segment.topic_segments(flagged, lexicon, eager_user_breaks=eager_user_breaks)
    switched = sessionize.mark_switches(segmented)
    described = segment.describe_segments(switched).drop("message_count")
    scored = emotion.segment_emotions(switched, lexicon).select(*emotion.KEY, "emotion_polarity", "emotion_intensity", "emotion_base_score", "emotion_score", "emotion_evidence", "valence_weight", "length_weight", "style_weight", "gap_weight", "recovery_weight", "risk_penalty")
    return switched.join(described, emotion.KEY).join(scored, emotion.KEY).drop("own_topic")


def result(f: Callable[[Evaluation], DataFrame]) -> cached_property:
    """A result that others build on; written once where the evaluation keeps its results."""
    return cached_property(wraps(f)(lambda self: self._kept(f(self))))


@dataclass
class Evaluation:
    """Results as lazy frames, or, after keep(), each written once to the shared folder when it is first asked for.

    Most results build on others, so without keep() a plan repeats what it builds on as often as it is used.
    """

    turns: DataFrame
    lexicon: Lexicon = ZH
    by_row: bool = False
    run_id: str = "run"
    scenario: str = "generic"

    @result
    def enriched(self) -> DataFrame:
        return enrich(self.turns, self.lexicon, by_row=self.by_row)

    writes: bool = False

    def keep(self) -> Evaluation:
        use_shared_folder(self.turns.sparkSession)
        self.writes = True
        return self

    def _kept(self, df: DataFrame) -> DataFrame:
        """df, or its rows written as Parquet and read again: later results then read the columns they need, with statistics."""
        if not self.writes:
            return df
        path = f"{use_shared_folder(df.sparkSession)}/evaluation-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    @result
    def objective(self) -> DataFrame:
        return metrics.objective_metrics(self.enriched, self.lexicon)

    @result
    def signals(self) -> DataFrame:
        return signals.implicit_signals(self.enriched, self.lexicon)

    @result
    def dimensions(self) -> DataFrame:
        return signals.rule_dimensions(self.enriched, self.signals, self.lexicon)

    @cached_property
    def turning_points(self) -> DataFrame:
        return outcomes.turning_points(self.enriched)

    @result
    def goals(self) -> DataFrame:
        return outcomes.goal_completion(self.enriched, self.lexicon)

    @result
    def recoveries(self) -> DataFrame:
        return outcomes.recovery_traces(self.enriched, self.goals, self.lexicon)

    @result
    def values(self) -> DataFrame:
        return kpi.metric_values(self.objective, self.dimensions, self.signals, self.goals, self.recoveries)

    @result
    def kpis(self) -> DataFrame:
        return kpi.scenario_kpis(self.values)

    @cached_property
    def registry(self) -> DataFrame:
        return kpi.metric_registry(self.values)

    @result
    def bad_cases(self) -> DataFrame:
        return badcase.bad_cases(self.enriched, self.objective, self.signals, self.goals, self.recoveries, self.lexicon, scenario=self.scenario)

    @cached_property
    def summary(self) -> DataFrame:
        return metrics.summary_cards(self.enriched, self.goals, self.objective)

    @cached_property
    def sessions(self) -> DataFrame:
        """The flagship view: a row per session with its outcome."""
        base = self.enriched.groupBy("session_id").agg(F.max("turn_index").alias("turns"), F.max("topic_segment_index").alias("segments"), F.avg("emotion_score").alias("emotion"))
        goals = self.goals.select("session_id", F.col("status").alias("goal"), F.col("score").alias("goal_score"))
        traces = self.recoveries.select("session_id", F.col("status").alias("recovery"), "quality_score")
        cases = self.bad_cases.groupBy("session_id").agg(F.count(F.lit(1)).alias("bad_cases"), F.max("severity").alias("worst"))
        return base.join(goals, "session_id").join(traces, "session_id").join(cases, "session_id", "left")
