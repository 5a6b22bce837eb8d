"""Streams of turns and spans through the batch operators. An extension: the rules themselves are defined on whole sessions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from confera.functions.lexicon import ZH, Lexicon
from confera.operators.segment import Scan, coded_turns

TURN = "session_id string, session_seq bigint, turn_index int, role string, content string, ts timestamp"


def turn_stream(spark: SparkSession, path: str, schema: str = TURN, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def session_activity(turns: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by pause: turns, questions and span of each; a session is out once the watermark has passed its end."""
    grouped = turns.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "session_id")
    return grouped.agg(F.count(F.lit(1)).alias("turns"), F.count_if(F.col("content").rlike("[?？]")).alias("questions")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "turns", "questions")


def activity_by_window(turns: DataFrame, size: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return turns.withWatermark("ts", late).groupBy(window.alias("w"), "role").agg(F.count(F.lit(1)).alias("turns")).select(F.col("w.start").alias("start"), "role", "turns")


def evaluate_batches(turns: DataFrame, evaluate: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch through a batch operator, to Parquet by batch; a batch that is done again replaces itself."""

    def run(batch: DataFrame, number: int) -> None:
        evaluate(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = turns.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def segment_stream(turns: DataFrame, lexicon: Lexicon = ZH, *, eager_user_breaks: bool = True, honor_continuation: bool = True) -> DataFrame:
    """session_id, turn_index, topic_segment_index of a stream of turns; a session's turns must come in their order.

    The state of a session is its open segment, as small however long the session is. Within a micro-batch turns are put in
    order; a turn that comes in a later batch than its successor is taken in after it.
    """

    def scan(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        index, sums = state.get if state.exists else (0, "{}")
        open_ = Scan(lexicon, eager_user_breaks, honor_continuation, index, json.loads(sums))
        rows = pd.concat(list(frames)).sort_values("turn_index", kind="stable")
        out = [open_.segment_of(r) for r in rows.itertuples(index=False)]
        state.update((open_.index, json.dumps(open_.sums)))
        yield pd.DataFrame({"session_id": key[0], "turn_index": rows["turn_index"].to_numpy(), "topic_segment_index": out})

    coded = coded_turns(turns, lexicon)
    return coded.groupBy("session_id").applyInPandasWithState(scan, "session_id string, turn_index int, topic_segment_index int", "open int, sums string", "append", "NoTimeout")
