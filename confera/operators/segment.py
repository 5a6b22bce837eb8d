"""Topic segmentation: a scan of each session that opens a new segment when the rules say so.

Whether a turn splits depends on the leading topic of the segment that is still open, so this one operator is sequential.
All text work is done before as columns; the scan sees small codes only. Rows are dealt by session and sorted, and the scan
runs over the sorted rows as they stream by, with the running sums of one segment as its only state: a session of any
length needs no more memory than a short one.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from confera.functions.lexicon import ZH, Lexicon
from confera.functions.text import confidence


def split_rule(lexicon: Lexicon, eager_user_breaks: bool):
    """decide(previous domain, row) for the scan; row: domain, hundredths, user, assistant, breaks, practice, wrap, closing."""
    compatible = lexicon.compatible

    def decide(previous: str, r) -> bool:  # noqa: ANN001
        if eager_user_breaks and r.user and r.breaks:
            return True
        if previous == r.domain:
            return False
        if r.user and r.practice:
            return True
        if (previous, r.domain) in compatible or r.domain == "casual" or (r.assistant and not r.wrap):
            return False
        if r.domain == "wrap_up":
            return bool(r.closing)
        return bool(r.practice) or r.hundredths >= 84

    return decide


def coded_turns(turns: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    """What the scan needs to know of each turn; keep: "row" for the turn itself, as a struct with its own topic."""
    text = F.col("content")
    own = turns.withColumn("own_topic", lexicon.domain(text))
    own = own.withColumn("row", F.struct(*turns.columns, "own_topic")) if "row" in keep else own
    return own.select(
        "session_id", "turn_index", *keep, "own_topic.domain", "own_topic.hundredths", (F.col("role") == "user").alias("user"), (F.col("role") == "assistant").alias("assistant"), (text.rlike(lexicon.switch) | text.rlike(lexicon.negative_break)).alias("breaks"),
        text.rlike(lexicon.practice).alias("practice"), text.rlike(lexicon.assistant_wrap).alias("wrap"), text.rlike(lexicon.wrap_up).alias("closing"), text.rlike(lexicon.continuation).alias("continues"),
    )


class Scan:
    """The open segment of one session: its number and, by domain in order of appearance, its sums."""

    def __init__(self, lexicon: Lexicon, eager_user_breaks: bool, honor_continuation: bool, index: int = 0, sums: dict[str, int] | None = None):
        self.decide, self.honor_continuation = split_rule(lexicon, eager_user_breaks), honor_continuation
        self.index, self.sums = index, sums or {}

    def segment_of(self, r) -> int:  # noqa: ANN001
        """Takes the session's next turn in."""
        if not self.index:
            self.index = 1
        elif not (self.honor_continuation and r.continues) and self.decide(max(self.sums, key=self.sums.get), r):
            self.index, self.sums = self.index + 1, {}
        self.sums[r.domain] = self.sums.get(r.domain, 0) + r.hundredths
        return self.index


def topic_segments(turns: DataFrame, lexicon: Lexicon = ZH, *, eager_user_breaks: bool = True, honor_continuation: bool = True) -> DataFrame:
    """turns with topic_segment_index (from 1 in each session) and the message's own topic: label, domain, hundredths.

    Rows go through the scan whole, as Arrow columns that it hands on untouched, so no join has to bring its answer back.
    """
    coded = coded_turns(turns, lexicon, "row")
    codes = [c for c in coded.columns if c not in ("row", "session_id", "turn_index")]
    kept = [*turns.columns, "own_topic"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, state = None, None
        turn = namedtuple("turn", codes)
        for batch in batches:
            out = []
            for own, *code in zip(batch.column("session_id").to_pylist(), *(batch.column(f"__{c}").to_pylist() for c in codes)):
                if own != session or state is None:
                    session, state = own, Scan(lexicon, eager_user_breaks, honor_continuation)
                out.append(state.segment_of(turn(*code)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.int32())], names=[*kept, "topic_segment_index"])

    rows = coded.select("row.*", *[F.col(c).alias(f"__{c}") for c in codes])
    ordered = rows.repartition("session_id").sortWithinPartitions("session_id", "turn_index")
    return ordered.mapInArrow(scan, rows.select(*kept).schema.add("topic_segment_index", IntegerType()))


def row_splits(turns: DataFrame, lexicon: Lexicon = ZH) -> DataFrame:
    """Segments where each user turn with a switch or negative phrase opens one: the part of the rules that is a running sum."""
    opens = (F.col("role") == "user") & (F.col("content").rlike(lexicon.switch) | F.col("content").rlike(lexicon.negative_break)) & ~F.col("content").rlike(lexicon.continuation) & (F.col("turn_index") > 1)
    running = Window.partitionBy("session_id").orderBy("turn_index")
    return turns.withColumns({"topic_segment_index": (1 + F.sum(opens.cast("int")).over(running)).cast("int"), "own_topic": lexicon.domain(F.col("content"))})


def describe_segments(segmented: DataFrame, *, excerpt: int = 20) -> DataFrame:
    """One row per segment: label and domain of the largest sum (the first seen of equals), mean confidence, span, summary."""
    key = ["session_id", "topic_segment_index"]
    by_domain = segmented.groupBy(*key, "own_topic.domain", "own_topic.label").agg(F.sum("own_topic.hundredths").alias("total"), F.min("turn_index").alias("seen"))
    top = by_domain.groupBy(*key).agg(F.max_by(F.struct("label", "domain"), F.struct("total", -F.col("seen"))).alias("top"))
    user_turn = F.when(F.col("role") == "user", F.col("turn_index"))
    spans = segmented.groupBy(*key).agg(
        F.min("turn_index").alias("start_turn"), F.max("turn_index").alias("end_turn"), F.count(F.lit(1)).alias("message_count"), F.avg("own_topic.hundredths").alias("mean"),
        F.coalesce(F.min_by("content", user_turn), F.min_by("content", "turn_index")).alias("first"),
    )
    start = F.substring("first", 1, excerpt)
    return spans.join(top, key).select(
        *key, F.concat(F.col("session_id"), F.lit("_topic_"), F.col("topic_segment_index")).alias("topic_segment_id"), F.col("top.label").alias("topic"), F.col("top.domain").alias("topic_domain"),
        confidence(F.col("mean") / 100).alias("topic_confidence"), F.when(start != "", F.concat(F.col("top.label"), F.lit("："), start)).otherwise(F.col("top.label")).alias("topic_summary"), "start_turn", "end_turn", "message_count",
    )
