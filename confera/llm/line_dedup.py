"""Substring deduplication by hashing of lines, paragraphs or clauses: the earliest ranked occurrence of a unit stays.

Units tile the text: a line ends with its line end, a clause also with the white space after a mark. A unit is normalised
(A-Z lower-cased, white space folded) and hashed to 128 bits. Digests are grouped globally with the least rank and the count
combined before the shuffle, so a line that a third of all documents share is one row a task. Only digests met twice or more
are joined back to the units. Offsets are those in the original text, in code points.

Every unit with a word takes part, however short. `min_run_words` tells what goes: a unit goes if the run of adjacent units
around it that have an earlier occurrence holds that many words; 1 (the default) takes out every repeated unit. A passage
that is copied into other documents seldom begins at a line, so clauses with a run of some length find it and leave lone
short units, which repeat in unrelated texts too, where they are.

Defined results: a null text has no units and stays null. Rank is by id (null ids last), then by the hash of the whole text,
then by place, so one occurrence stays among null or repeated ids too. Rows that repeat both id and text are one document:
their units are listed once, and each of the rows is cut alike. A text that loses every unit is empty. A very long text is
one row of its own in a batch to Python and is never split. An empty table gives an empty result. Other columns are ignored
or passed on as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from confera.llm.common import checkpointed, own_name, text_batches

_END = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t\r]*(?:\n[ \t\r]*)+"), "clause": re.compile(r"[.,;:!?][\x20\x09-\x0D]+|\n")}


def units(text: str, unit: str = "line") -> Iterator[tuple[int, str]]:
    """Start and text of each unit, with its end."""
    at = 0
    for m in _END[unit].finditer(text):
        yield at, text[at : m.end()]
        at = m.end()
    if at < len(text):
        yield at, text[at:]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_UNIT = {"unit": pa.int32(), "words": pa.int32(), "start": pa.int64(), "length": pa.int32(), "h1": pa.int64(), "h2": pa.int64()}


def hashed_units(docs: DataFrame, id_col: str, text_col: str, unit: str, *, once: bool = False) -> DataFrame:
    """doc_id, text_hash, unit (number among units with a word, from 0), words, start, length, h1, h2.

    once: rows that repeat id and text give their units once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            rows = []
            for row, text in enumerate(batch.column("text")):
                if once:
                    key = (batch.column("doc_id")[row].as_py(), batch.column("text_hash")[row].as_py())
                    if key in seen:
                        continue
                    seen.add(key)
                n = 0
                for start, part in units(text.as_py() or "", unit):
                    if words := part.encode("utf-8", "surrogatepass").lower().split():
                        h = xxhash.xxh3_128_intdigest(b" ".join(words))
                        rows.append((row, n, len(words), start, len(part), _signed(h >> 64), _signed(h & (1 << 64) - 1)))
                        n += 1
            if rows:
                of, *rest = zip(*rows)
                of = pa.array(of)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("text_hash").take(of), *(pa.array(c, t) for c, t in zip(rest, _UNIT.values()))], names=["doc_id", "text_hash", *_UNIT])

    kind = dict(docs.dtypes)[id_col]
    texts = text_batches(docs).select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, text_hash bigint, unit int, words int, start bigint, length int, h1 bigint, h2 bigint")


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, unit: str = "line", min_run_words: int = 1) -> DataFrame:
    """One row per unit to remove: doc_id, text_hash, start, length, words, keep_doc_id, keep_start, copies."""
    rank = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"), F.col("start").alias("start"))
    groups = hashed_units(docs, id_col, text_col, unit).groupBy("h1", "h2").agg(F.min(rank).alias("keep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    # The same key under an expression of its own: the join then has a plain exchange on both sides, and Spark can split
    # the rows of a hot line over tasks.
    groups = groups.select(F.col("h1").bitwiseXOR(F.lit(0)).alias("h1"), F.col("h2").bitwiseXOR(F.lit(0)).alias("h2"), "keep", "copies")
    first = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("text_hash") == F.col("keep.text_hash")) & (F.col("start") == F.col("keep.start"))
    # Hashed once more for the rows: cheaper than writing the units of all documents.
    again = hashed_units(docs, id_col, text_col, unit, once=True).join(groups, ["h1", "h2"]).filter(~first)
    again = again.select("doc_id", "text_hash", "unit", "start", "length", "words", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.start").alias("keep_start"), "copies")
    # Dealt by text: what follows stays within one text, of which the tasks above have left a copy each at most.
    again = again.repartition("doc_id", "text_hash").distinct()
    if min_run_words > 1:
        text = ["doc_id", "text_hash"]
        again = again.withColumn("run", F.col("unit") - F.row_number().over(Window.partitionBy(*text).orderBy("unit")))
        again = again.withColumn("run_words", F.sum("words").over(Window.partitionBy(*text, "run"))).filter(F.col("run_words") >= min_run_words)
    return again.select("doc_id", "text_hash", "start", "length", "words", "keep_doc_id", "keep_start", "copies")


def remove_units(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the removed units cut out, and removed_spans: (start, length) in the original text, ascending.

    A row meets the spans of its own id (null too) and its own text, so no text is cut by the spans of another.
    """
    spans_col, gone, hash_col = (own_name(docs, c) for c in ("spans", "gone", "hash"))
    spans = removed.groupBy(F.col("doc_id").alias(gone), F.col("text_hash").alias(hash_col)).agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias(spans_col))
    spans = checkpointed(spans)

    @F.pandas_udf("string")
    def cut(texts, spans):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for text, own in zip(texts, spans):
            if text is None:
                out.append(None)
                continue
            kept, at = [], 0
            for s in own:
                kept.append(text[at : s["start"]])
                at = s["start"] + s["length"]
            kept.append(text[at:])
            out.append("".join(kept))
        return pd.Series(out, dtype=object)

    text = F.col(f"`{text_col}`")
    joined = docs.join(spans, F.col(f"`{id_col}`").eqNullSafe(F.col(gone)) & (F.xxhash64(text) == F.col(hash_col)), "left")
    # Texts that lose nothing go to Python as nulls.
    loses = F.col(spans_col).isNotNull()
    shorter = F.when(loses, cut(F.when(loses, text), F.col(spans_col))).otherwise(text)
    out = "removed_spans" if "removed_spans" not in docs.columns else spans_col + "_removed"
    return joined.select(*[(shorter.alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns], F.coalesce(F.col(spans_col), F.array().cast("array<struct<start:bigint,length:int>>")).alias(out))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, unit: str = "line", min_run_words: int = 1) -> DataFrame:
    return remove_units(docs, repeated_units(docs, id_col, text_col, unit=unit, min_run_words=min_run_words), id_col, text_col)
