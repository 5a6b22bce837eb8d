"""Text files in as many tasks as they have splits: lines know their place in the file without a window over it.

Spark reads a large file in splits. Within one, rows come in order and are consecutive numbers; what a split adds to a count,
or leaves to the next one, is a row for each split, and only those rows are put in order per file.

Defined results: an empty file has no rows. A file of one split is carried nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ["file", "block"]


def split_rows(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """line, file, block (where its split begins), at (rows of a split follow each other)."""
    reader = spark.read if sep is None else spark.read.option("lineSep", sep)
    return reader.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def within_split() -> Window:
    return Window.partitionBy(*KEY).orderBy("at")


def carried_sum(rows: DataFrame, amount: Column, name: str) -> DataFrame:
    """file, block, name: the amounts of all earlier splits of the file."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy(*KEY).agg(F.sum(amount).alias("__n")).select(*KEY, F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("bigint").alias(name))


def carried_last(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """file, block, name: the last value (not null) of the earlier splits of the file."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy(*KEY).agg(F.max_by(value, F.when(value.isNotNull(), F.col("at"))).alias("__v")).select(*KEY, F.last("__v", ignorenulls=True).over(before).alias(name))


def numbered_rows(rows: DataFrame) -> DataFrame:
    """rows with n: their number in the file, from 0."""
    first = rows.groupBy(*KEY).agg(F.min("at").alias("__first"))
    before = carried_sum(rows, F.lit(1), "__before")
    return rows.join(first.join(before, KEY), KEY).withColumn("n", F.col("at") - F.col("__first") + F.col("__before")).drop("__first", "__before")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line, file, block, at, n: every line with its number in its file."""
    return numbered_rows(split_rows(spark, path))


#: What stands between the strings of a piece of JSON, by whether the piece begins outside (0) or within a string (1).
_ESCAPE = r"\\."


def _depths(piece: Column) -> Column:
    """Struct of parity (whether the piece holds an odd number of quotes), d0, d1: how deep it leads if it begins outside or within a string."""
    parts = F.split(F.regexp_replace(piece, _ESCAPE, ""), '"')
    opened = lambda s: F.length(F.regexp_replace(s, r"[^\[{]", "")) - F.length(F.regexp_replace(s, r"[^\]}]", ""))
    total = lambda odd: F.aggregate(F.filter(parts, lambda _, i: i % 2 == odd), F.lit(0), lambda a, s: a + opened(s))
    return F.struct(F.pmod(F.size(parts) - 1, F.lit(2)).alias("parity"), total(0).alias("d0"), total(1).alias("d1"))


def json_pieces(spark: SparkSession, path: str) -> DataFrame:
    """line, file, block, at, depth (after the piece), n of the pieces of JSON files, cut after each closing brace.

    Where a split begins within a string or some levels deep isn't known to it. It counts both ways, the counts of the splits
    of a file are folded in order, and then every split knows how it began.
    """
    # Reading cut off the brace. Whether the last piece of a file had one shows in its depth: without it, one level is open.
    rows = numbered_rows(split_rows(spark, path, "}"))
    ends = rows.groupBy("file").agg(F.max("n").alias("__end"))
    rows = rows.join(ends, "file").withColumn("__tail", F.col("n") == F.col("__end")).withColumn("line", F.when(F.col("__tail"), F.col("line")).otherwise(F.concat("line", F.lit("}"))))
    rows = rows.withColumn("__d", _depths(F.col("line")))
    # Two runs at once: from outside (d0) and from within a string (d1); parity tells how far they have swapped.
    step = lambda a, d: F.struct(F.pmod(a["parity"] + d["parity"], F.lit(2)).alias("parity"), (a["d0"] + F.when(a["parity"] == 0, d["d0"]).otherwise(d["d1"])).alias("d0"), (a["d1"] + F.when(a["parity"] == 0, d["d1"]).otherwise(d["d0"])).alias("d1"))
    parity = F.pmod(F.sum("__d.parity").over(within_split().rowsBetween(Window.unboundedPreceding, -1)), F.lit(2))
    rows = rows.withColumn("__p", F.coalesce(parity, F.lit(0)))
    as_outside = F.when(F.col("__p") == 0, F.col("__d.d0")).otherwise(F.col("__d.d1"))
    as_inside = F.when(F.col("__p") == 0, F.col("__d.d1")).otherwise(F.col("__d.d0"))
    totals = rows.groupBy(*KEY).agg(F.struct(F.pmod(F.sum("__d.parity"), F.lit(2)).cast("int").alias("parity"), F.sum(as_outside).cast("int").alias("d0"), F.sum(as_inside).cast("int").alias("d1")).alias("t"))
    so_far = F.array_sort(F.collect_list(F.struct("block", "t")).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    zero = F.struct(F.lit(0).alias("parity"), F.lit(0).alias("d0"), F.lit(0).alias("d1"))
    folded = F.aggregate(F.transform(so_far, lambda x: x["t"]), zero, step)
    began = totals.select(*KEY, folded["parity"].alias("__in"), folded["d0"].alias("__deep"))
    run = Window.partitionBy(*KEY).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(began, KEY).withColumn("depth", F.col("__deep") + F.sum(F.when(F.col("__in") == 0, as_outside).otherwise(as_inside)).over(run))
    open_ = F.col("__tail") & (F.col("depth") == 1)
    return rows.select(F.when(open_, F.concat("line", F.lit("}"))).otherwise(F.col("line")).alias("line"), *KEY, "at", "n", F.when(open_, 0).otherwise(F.col("depth")).alias("depth"))


def json_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Elements (file, nth, value) of files that hold a list at the top, and whole texts (file, value) of the others.

    The objects of a list are put together from their pieces, so a list may be larger than any executor's memory; items that
    are no objects are skipped and not counted. Other files are one text each.
    """
    pieces = json_pieces(spark, path)
    root = pieces.filter("n = 0").select("file", F.ltrim("line").startswith("[").alias("listed"))
    pieces = pieces.join(root, "file")
    ended = ((F.col("depth") == 1) & F.col("listed")).cast("int")
    mine = F.coalesce(F.sum(ended).over(within_split().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = pieces.filter("listed").withColumn("nth", mine)
    listed = listed.join(carried_sum(listed, ended, "__before"), KEY).withColumn("nth", F.col("nth") + F.col("__before"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "")
    cut = F.regexp_replace(F.col("value"), r"^[^{]*", "")
    elements = listed.groupBy("file", "nth").agg(text.alias("value")).select("file", "nth", cut.alias("value")).filter("value <> ''")
    others = pieces.filter("not listed").groupBy("file").agg(text.alias("value"))
    return elements, others
