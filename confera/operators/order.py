"""A global order as row numbers: range partitions number their own rows, and only the counts of the partitions meet.

No window spans the table. Rows go through one range shuffle and are written once, so that the numbers a lost executor had
given are the ones its successor gives. What is broadcast has one row per partition.

Defined results: nulls come first in an ascending order and last in a descending one, as Spark sorts. Rows that tie in all
columns of the order share one partition and get neighbouring numbers, in any order. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from confera.operators.store import use_shared_folder

#: The low bits of monotonically_increasing_id count the rows of a partition.
_LOW = 33


def numbered(rows: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """rows with `name`: their place from 0 in the order."""
    use_shared_folder(rows.sparkSession)
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    local = rows.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    part, nth = F.shiftright("__at", _LOW), F.col("__at").bitwiseAND(F.lit((1 << _LOW) - 1))
    counts = local.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))
    return local.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + nth).drop("__part", "__before", "__at")


def running_totals(values: DataFrame, by: list[str], value: str, amount: str, name: str = "before") -> DataFrame:
    """values (by, value, amount), one row per value of a key: with `name`, the amount of all smaller values of its key.

    A key's values are numbered by range partitions like rows of any order; only one total per key and partition meets.
    """
    use_shared_folder(values.sparkSession)
    order = [F.col(c) for c in [*by, value]]
    local = values.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).checkpoint()
    totals = local.groupBy(*by, "__part").agg(F.sum(amount).alias("__sum"))
    upto = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select(*by, "__part", F.coalesce(F.sum("__sum").over(upto), F.lit(0)).alias("__earlier"))
    within = Window.partitionBy(*by, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = local.withColumn("__within", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    same = [out[c].eqNullSafe(earlier[c]) for c in by] + [out["__part"] == earlier["__part"]]
    joined = out.join(earlier, same).select(*[out[c] for c in values.columns], (F.col("__earlier") + F.col("__within")).alias(name))
    return joined
