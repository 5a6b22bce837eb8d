"""Audit of how the sources of a language differ in their words, with count columns deduplicated.

Terms of a language that occur equally often in each of its sources have the same sparse vector of counts. They are one row
with a multiplicity, and every pair of sources is evaluated once for it. Only sources that a vector names meet within it: by

    f(a, b) = [f(a, b) - f(a, 0) - f(0, b) + f(0, 0)] + [f(a, 0) - f(0, 0)] + [f(0, b) - f(0, 0)] + f(0, 0)

the first bracket is summed over vectors that name both, the next two over the distinct counts of one source (their
multiplicities come from the vectors too), and the last is the number of kept terms times one value. Terms themselves come
back only for the ranks of a source's own terms.

A probability is the whole number p = 1 + floor(scale (count + 1) / (N + V)); f = floor((p - q)^2 / q). All sums are of
whole numbers. Texts are read once, as Arrow UTF-8 buffers: a worker counts the words of a block per text and hands on a row
per group and term, and Spark adds these up before it shuffles.

Defined results: a null text, language or source is the empty string. A language without kept terms has pairs of value 0 and
no term rows. A language with one source has no pairs. Rows that repeat an id are documents like any. A very long text is
counted piece by piece, and its distinct terms are held at once. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confera.llm.common import checkpointed, text_batches
from confera.llm.utf8 import as_strings, byte_classes, word_blocks

CLASS = byte_classes(digits=False)
SCALE = 1_000_000_000
#: Parts that a language's vectors are dealt into where they meet its sources, so that one language isn't one task.
SALTS = 64


def _counted(rows: np.ndarray, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words with the group of their row, as distinct terms, groups, codes of terms and occurrences per (row, term)."""
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    met, times = np.unique(rows.astype(np.int64) * len(coded.dictionary) + codes, return_counts=True)
    return coded.dictionary, met // max(1, len(coded.dictionary)), met % max(1, len(coded.dictionary)), times


def _per_group(group: np.ndarray, batch: pa.Array, long: dict[tuple[int, str], int]) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """Blocks of one batch: group of each count, term, n, in_docs. group: of each row. Pieces of long texts are added up first."""
    for b in word_blocks(batch, CLASS):
        starts, ends, of = (x[1:] if b.seen else x for x in (b.starts, b.ends, b.of))
        if not len(starts):
            continue
        terms, row, code, times = _counted(of, as_strings(b.low, starts, ends))
        if b.part:
            for t, n in zip(terms.take(pa.array(code)).to_pylist(), times.tolist()):
                long[(int(b.rows[0]), t)] = long.get((int(b.rows[0]), t), 0) + n
            continue
        met, at = np.unique(group[b.rows][row] * len(terms) + code, return_inverse=True)
        yield met // len(terms), terms.take(pa.array(met % len(terms))), np.bincount(at, times).astype(np.int64), np.bincount(at)
    if long:
        yield group[[r for r, _ in long]], pa.array([t for _, t in long], pa.large_string()), np.array(list(long.values())), np.ones(len(long), np.int64)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), in_docs (texts that hold it)."""
    empty = F.lit("")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"), F.coalesce(F.col(source_col).cast("string"), empty).alias("source"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: dict[tuple[str, str], int] = {}
            group = np.array([names.setdefault(x, len(names)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], np.int64)
            lang, source = (pa.array([x[k] for x in names], pa.string()) for k in (0, 1))
            for of, term, n, in_docs in _per_group(group, batch.column(2), {}):
                at = pa.array(of)
                yield pa.record_batch([lang.take(at), source.take(at), term.cast(pa.string()), pa.array(n, pa.int64()), pa.array(in_docs, pa.int64())], names=["lang", "source", "term", "n", "in_docs"])

    counts = text_batches(rows).mapInArrow(count, "lang string, source string, term string, n bigint, in_docs bigint")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("in_docs").alias("in_docs"))


def probability(count: Column, total: Column, kept: Column, scale: int = SCALE) -> Column:
    """1 + floor(scale (count + 1) / (total + kept)) as a long; the product is a decimal, as it can pass a long's range."""
    whole = F.lit(scale).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    return F.lit(1) + F.when(total + kept > 0, F.call_function("div", whole, (total + kept).cast("decimal(19,0)"))).otherwise(F.lit(0))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _groups(docs: DataFrame, counts: DataFrame, lang_col: str, source_col: str, scale: int) -> DataFrame:
    """Every occurring lang and source: total (N of its words), kept (V of the language), zero (its p of a count of 0)."""
    empty = F.lit("")
    all_groups = docs.select(F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"), F.coalesce(F.col(source_col).cast("string"), empty).alias("source")).distinct()
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    out = all_groups.join(sizes, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    return checkpointed(out.withColumn("zero", probability(F.lit(0), F.col("total"), F.col("kept"), scale)))


def _pairs(counts: DataFrame, groups: DataFrame, scale: int) -> DataFrame:
    """lang, source, item, value of every ordered pair of sources of a language."""
    p = probability(F.col("n"), F.col("total"), F.col("kept"), scale)
    with_p = counts.join(groups.select("lang", "source", "total", "kept", "zero"), ["lang", "source"]).select("lang", "term", F.struct("source", "n", p.alias("p"), "zero").alias("at"))
    vectors = with_p.groupBy("lang", "term").agg(F.sort_array(F.collect_list("at")).alias("vector"))
    vectors = checkpointed(vectors.groupBy("lang", "vector").agg(F.count(F.lit(1)).alias("times")))

    a, b = F.col("a"), F.col("b")
    excess = divergence(a["p"], b["p"]) - divergence(a["p"], b["zero"]) - divergence(a["zero"], b["p"]) + divergence(a["zero"], b["zero"])
    met = vectors.filter(F.size("vector") > 1).select("lang", "times", "vector", F.explode("vector").alias("a")).select("lang", "times", "a", F.explode("vector").alias("b")).filter("a.source <> b.source")
    both = met.groupBy("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item")).agg(F.sum(excess * F.col("times")).alias("value"))

    # Distinct probabilities of a source with how many terms have them, against every other source of the language.
    alone = vectors.select("lang", "times", F.explode("vector").alias("at")).groupBy("lang", "at").agg(F.sum("times").alias("times"))
    alone = alone.select("lang", F.pmod(F.xxhash64("at"), F.lit(SALTS).cast("long")).alias("salt"), F.col("at.source").alias("named"), F.col("at.p").alias("p"), F.col("at.zero").alias("own"), "times")
    others = groups.select("lang", "source", "zero", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])).alias("salt"))
    against = alone.join(others, ["lang", "salt"]).filter("named <> source")
    sums = against.groupBy("lang", "named", "source").agg(
        F.sum((divergence(F.col("p"), F.col("zero")) - divergence(F.col("own"), F.col("zero"))) * F.col("times")).alias("mine"),
        F.sum((divergence(F.col("zero"), F.col("p")) - divergence(F.col("zero"), F.col("own"))) * F.col("times")).alias("theirs"),
    )
    mine = sums.select("lang", F.col("named").alias("source"), F.col("source").alias("item"), F.col("mine").alias("value"))
    theirs = sums.select("lang", "source", F.col("named").alias("item"), F.col("theirs").alias("value"))

    first = groups.select("lang", "source", "zero", "kept")
    every = first.join(groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero")), "lang").filter("source <> item")
    every = every.select("lang", "source", "item", F.when(F.col("kept") > 0, F.col("kept") * divergence(F.col("zero"), F.col("item_zero"))).otherwise(F.lit(0)).alias("value"))
    parts = both.unionByName(mine).unionByName(theirs).unionByName(every)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = 3, top_terms: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", scale: int = SCALE) -> DataFrame:
    """lang, source, part, item, value, rank.

    part "pair": how the source's words differ from each other source of its language, all ranks. part "term": the terms it
    holds more often than its language, the top_terms of them by f.
    """
    # The sources of a term meet once, which gives its documents and its count in the language without another grouping.
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs, text_col, lang_col, source_col).withColumns({"term_docs": F.sum("in_docs").over(of_term), "lang_n": F.sum("n").over(of_term)})
    counts = checkpointed(counts.filter(F.col("term_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n"))
    groups = _groups(docs, counts, lang_col, source_col, scale)

    order = [F.desc("value"), F.asc("item")]
    nth = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))
    pairs = _pairs(counts.drop("lang_n"), groups, scale).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", nth)

    p = probability(F.col("n"), F.col("total"), F.col("kept"), scale)
    q = probability(F.col("lang_n"), F.col("lang_total"), F.col("kept"), scale)
    terms = counts.join(groups.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", divergence(F.col("p"), F.col("q")).alias("value")).withColumn("rank", nth).filter(F.col("rank") <= top_terms)
    return pairs.unionByName(terms)
