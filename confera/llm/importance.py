"""Importance resampling towards a target distribution over hashed words and word pairs.

Texts reach the workers as Arrow UTF-8 buffers, and features are hashed there by a byte automaton without a Python string: a
table of 256 entries gives each byte its class (no word byte, or the byte in lower case), differences between neighbouring
classes give the ends of words, and the table-driven CRC advances at all words of a block at once, one byte a step. Words are
taken by falling length, so the ones still running are a prefix. A pair goes on from the state its first word ended in.

Three steps read texts. Counts of the buckets over the corpus and over the target become one gain per bucket; every text then
gets the floored mean of its gains; a seeded Gumbel draw by id turns means into scores, and the highest are drawn. Counts and
gains have one row per bucket, whatever the corpus. Ranks come from the counts per score (a score is a whole number, so there
are some ten thousand of them), and only the rows of one score are ordered among themselves.

Defined results: a null or empty text, or one without a word, has no feature and weight 0; it has a score, but takes part in
the draw only if it has `min_words` words. A null id has the draw of the text "null" and ranks last among ties. Rows that
repeat an id and a text have one score and ranks next to each other. A very long text is hashed block by block, each block
cut between words and overlapping by one, so memory is bounded but for a single word longer than a block. An empty target
gives every bucket a count of 0 there; an empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from confera.llm.common import checkpointed, own_name, text_batches
from confera.llm.utf8 import byte_classes, word_blocks

BUCKETS = 10_000
#: Steps that words of a block take together; what is longer goes on alone, through the same CRC of the standard library.
STEPS = 40


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


CLASS, CRC = byte_classes(digits=True), _crc_table()


def _advance(state: np.ndarray, low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC states after the bytes low[start : start + length] of each place."""
    order = np.argsort(-np.minimum(lengths, STEPS + 1).astype(np.int8), kind="stable")
    c, at, longest = state[order], starts[order], lengths[order]
    running = len(order) - np.cumsum(np.bincount(np.minimum(lengths, STEPS + 1), minlength=STEPS + 2))
    for k in range(STEPS):
        n = running[k]
        if not n:
            break
        c[:n] = CRC[(c[:n] ^ low[at[:n] + k]) & 0xFF] ^ (c[:n] >> np.uint32(8))
    for i in range(running[STEPS]):
        rest = low[at[i] + STEPS : at[i] + longest[i]].tobytes()
        c[i] = zlib.crc32(rest, int(c[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(c)
    out[order] = c
    return out


def text_features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of a text column: numbers of their rows; row within the block and CRC per feature; words per row."""
    for b in word_blocks(column, CLASS):
        state = _advance(np.full(len(b.starts), 0xFFFFFFFF, np.uint32), b.low, b.starts, b.ends - b.starts)
        pair = np.flatnonzero(b.of[1:] == b.of[:-1])
        mid = CRC[(state[pair] ^ np.uint32(32)) & 0xFF] ^ (state[pair] >> np.uint32(8))
        both = _advance(mid, b.low, b.starts[pair + 1], (b.ends - b.starts)[pair + 1])
        own = slice(1, None) if b.seen else slice(None)  # a word seen before is here for its pair only
        yield b.rows, np.concatenate([b.of[own], b.of[pair]]), np.concatenate([state[own], both]) ^ np.uint32(0xFFFFFFFF), np.bincount(b.of[own], minlength=len(b.rows))


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how often features of the bucket occur in all texts. A task hands on one row per bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, crc, _ in text_features(batch.column(0)):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.record_batch([pa.array(met, pa.int32()), pa.array(total[met], pa.int64())], names=["bucket", "n"])

    parts = text_batches(docs.select(F.col(text_col))).mapInArrow(count, "bucket int, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket: one number each, however large the corpus."""
    both = bucket_counts(docs, text_col, buckets).withColumn("side", F.lit("s")).unionByName(bucket_counts(target, text_col, buckets).withColumn("side", F.lit("t")))
    s, t = [0] * buckets, [0] * buckets
    for r in both.collect():
        (s if r["side"] == "s" else t)[r["bucket"]] = r["n"]
    total_s, total_t = sum(s), sum(t)
    return [math.floor(1000 * math.log(float(b + 1) * float(total_s + buckets) / (float(a + 1) * float(total_t + buckets)))) for a, b in zip(s, t)]


def weighed(docs: DataFrame, gain: list[int], text_col: str = "text") -> DataFrame:
    """docs with n_words, n_features and weight (all long) after their columns, under names that no column has."""
    names = [own_name(docs, n) for n in ("n_words", "n_features", "weight")]
    schema = T.StructType(docs.schema.fields + [T.StructField(n, T.LongType()) for n in names])
    at, table = docs.columns.index(text_col), np.array(gain, np.int64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for rows, of, crc, n in text_features(batch.column(at)):
                words[rows] += n
                features[rows] += np.bincount(of, minlength=len(rows))
                # Sums of whole numbers, below 2^53 for any text of less than 10^10 features.
                total[rows] += np.bincount(of, table[crc % np.uint32(len(table))], minlength=len(rows)).astype(np.int64)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.int64()) for x in (words, features, weight)]], names=[*batch.schema.names, *names])

    return text_batches(docs).mapInArrow(weigh, schema)


def gumbel(id_col: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2^32))), h from the first 8 hex digits of sha256("seed:id")."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row per row: doc_id, n_words, n_features, weight, score. Written, as ranks come from several looks at it."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = [own_name(narrow, n) for n in ("n_words", "n_features", "weight")]
    out = weighed(narrow, gains(docs, target, text_col, buckets)).select("doc_id", *[F.col(n).alias(n.strip("_")) for n in names])
    return checkpointed(out.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))


#: Scores that one block of the running count holds.
SCORE_BLOCK = 1024


def _offsets(able: DataFrame) -> DataFrame:
    """score, before: how many rows have a higher one. Blocks of scores meet first, so no window has more rows than a block."""
    counts = able.groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("score") / SCORE_BLOCK))
    counts = checkpointed(counts)
    higher = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("above"))
    within = Window.partitionBy("block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    local = counts.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return checkpointed(local.join(blocks, "block").select("score", "n", (F.col("above") + F.col("within")).alias("before")))


def ranked(rows: DataFrame, percent: int = 25, min_words: int = 20) -> DataFrame:
    """rows as scored() gives them, with rank: 1, 2, 3 ... of those drawn, null for the rest."""
    able = F.col("n_words") >= min_words
    offsets = _offsets(rows.filter(able))
    most = (offsets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] * percent) // 100
    cut = offsets.filter(F.col("before") < most).agg(F.min("score").alias("s")).first()["s"]
    near = able & (F.col("score") >= cut) if cut is not None else F.lit(False)
    nth = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id")))
    high = rows.filter(near).join(offsets.select("score", "before"), "score").withColumn("rank", F.col("before") + nth)
    high = high.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    columns = [*rows.columns, "rank"]
    return rows.filter(~near).withColumn("rank", F.lit(None).cast("bigint")).select(*columns).unionByName(high.select(*columns))


def importance_scores(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_words, n_features, weight, score, rank."""
    return ranked(scored(docs, target, seed, id_col, text_col), percent, min_words)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows drawn, with all their columns. No text is shuffled; rows that repeat the last id drawn are all drawn."""
    gain = gains(docs, target, text_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = weighed(narrow, gain).select("doc_id", F.col("__n_words").alias("n_words"), (F.col("__weight") + gumbel(F.col("doc_id"), seed)).alias("score"))
    drawn = checkpointed(ranked(checkpointed(rows), percent, min_words).filter("rank is not null"))
    last = drawn.orderBy(F.desc("rank")).select("score", "doc_id").first()
    if last is None:
        return docs.limit(0)
    words, weight = own_name(docs, "n_words"), own_name(docs, "weight")
    out, score = weighed(docs, gain, text_col), F.col(weight) + gumbel(F.col(id_col), seed)
    tie = F.lit(True) if last["doc_id"] is None else F.col(id_col) <= last["doc_id"]
    return out.filter((F.col(words) >= min_words) & ((score > last["score"]) | ((score == last["score"]) & tie))).select(*[F.col(f"`{c}`") for c in docs.columns])
