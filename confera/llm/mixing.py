"""Mixing sources to target weights by capped water-filling.

Every source asks for its share of the mix by weight; none may exceed `max_epochs` times its own size, and what a capped
source leaves is shared among the others by weight until none is above its cap. Each document is then taken whole as often
as its source's target covers the source, and once more if a seeded hash of its id falls below the source's cut. The cut is
found by counting: sizes are summed per source and hash bucket, the bucket in which the sum passes the target is read
again, and the cut is the document there that brings the sum nearest the target. So a source misses its target by about
half a document, whatever its size, and a source that holds a third of all rows is summed in parts.

Defined results: a null text has size 0 and is taken 0 words. Documents of a null source form a source of their own, last
in order. Rows that share an id share its draw. A null id has the draw of its null. A very long text counts its words like any. A source of size 0 has target 0. An
empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confera.llm.common import WORD, checkpointed, own_name

BUCKETS = 4096
#: Sources the plan is made for on the driver; more are refused with an error.
MAX_SOURCES = 100_000


def draw(id_col: Column, seed: int) -> Column:
    """A number from 0 to 2^48 - 1 for each id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, max_epochs: float) -> list[float]:
    """Targets that are proportional to the weights but for sources at their cap; they add up to the total if the caps do."""
    caps = [max_epochs * s for s in sizes]
    capped: set[int] = set()
    while True:
        rest = total - sum(caps[i] for i in capped)
        weight = sum(w for i, w in enumerate(weights) if i not in capped)
        over = {i for i, w in enumerate(weights) if i not in capped and rest * w / weight > caps[i]}
        if not over:
            return [caps[i] if i in capped else rest * w / weight for i, w in enumerate(weights)]
        capped |= over


def plan_sources(docs: DataFrame, weights: Sequence[float], share: float, max_epochs: float, seed: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """The narrow documents (doc_id, name, size, draw) and the plan: name, source_size, target, whole, cut.

    A document of the source is taken whole times, and once more if its draw is at most the cut.
    """
    spark = docs.sparkSession
    # A null source gets a name that sorts last and that no other can have: names are prefixed.
    name = F.coalesce(F.concat(F.lit("a"), F.col(source_col).cast("string")), F.lit("b"))
    narrow = checkpointed(docs.select(F.col(id_col).alias("doc_id"), name.alias("name"), size_of(F.col(text_col)).alias("size"), draw(F.col(id_col), seed).alias("draw")))
    buckets = checkpointed(narrow.groupBy("name", F.floor(F.col("draw") / (2**48 // BUCKETS)).alias("bucket")).agg(F.sum("size").alias("words")))
    per_source = sorted((r["name"], r["words"]) for r in buckets.groupBy("name").agg(F.sum("words").alias("words")).limit(MAX_SOURCES + 1).collect())
    if len(per_source) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    sizes = [s for _, s in per_source]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), max_epochs)
    rows = []
    for (source, size), target in zip(per_source, targets):
        whole = min(int(target // size), int(max_epochs)) if size else 0
        rows.append((source, size, float(target), whole, max(0.0, target - whole * size)))
    plan = spark.createDataFrame(rows, "name string, source_size bigint, target double, whole bigint, rest double")

    # The bucket in which the running sum passes what the whole takes leave; then the draw in it that comes nearest.
    upto = F.sum("words").over(Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    crossed = buckets.withColumn("upto", upto).join(F.broadcast(plan), "name").filter((F.col("upto") - F.col("words") < F.col("rest")) & (F.col("upto") >= F.col("rest")))
    crossed = checkpointed(crossed.groupBy("name").agg(F.min("bucket").alias("bucket"), F.min_by(F.col("upto") - F.col("words"), "bucket").alias("before"), F.min("rest").alias("rest")))
    within = narrow.withColumn("bucket", F.floor(F.col("draw") / (2**48 // BUCKETS))).join(F.broadcast(crossed), ["name", "bucket"])
    within = within.groupBy("name", "draw", "before", "rest", "bucket").agg(F.sum("size").alias("size"))  # rows of one id fall together
    run = F.sum("size").over(Window.partitionBy("name").orderBy("draw").rowsBetween(Window.unboundedPreceding, 0))
    taken = within.withColumn("upto", F.col("before") + run).filter(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    cuts = taken.groupBy("name").agg(F.max("draw").alias("last"))
    below = crossed.select("name", (F.col("bucket") * (2**48 // BUCKETS) - 1).alias("floor"))
    cut = F.when(F.col("rest") <= 0, F.lit(-1)).otherwise(F.coalesce(F.greatest("last", "floor"), F.lit(2**48)))
    full = plan.join(below, "name", "left").join(cuts, "name", "left").select("name", "source_size", "target", "whole", cut.cast("bigint").alias("cut"))
    # As many rows as there are sources, which is checked above: rebuilt from the driver to be a plain small table.
    return narrow, spark.createDataFrame([tuple(r) for r in full.collect()], "name string, source_size bigint, target double, whole bigint, cut bigint")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row: doc_id, size, source_size, target, taken."""
    narrow, plan = plan_sources(docs, weights, share, max_epochs, seed, id_col, text_col, source_col)
    times = F.col("whole") + (F.col("draw") <= F.col("cut")).cast("bigint")
    return narrow.join(F.broadcast(plan), "name").select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def repeat_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns. No text is shuffled."""
    _, plan = plan_sources(docs, weights, share, max_epochs, seed, id_col, text_col, source_col)
    row, name, times = own_name(docs, "row"), own_name(docs, "name"), own_name(docs, "times")
    key = F.coalesce(F.concat(F.lit("a"), F.col(source_col).cast("string")), F.lit("b"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), key.alias(name), draw(F.col(id_col), seed).alias("__draw"))
    joined = packed.join(F.broadcast(plan.select(F.col("name").alias(name), "whole", "cut")), name)
    copies = F.col("whole") + (F.col("__draw") <= F.col("cut")).cast("bigint")
    return joined.select(row, F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias(times)).select(f"{row}.*")
