"""What the modules of queries share: their registry, the driver tables, and pieces of SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from confera.operators.store import use_shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with the SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as turns. They have no times, so a fixed rule gives each turn its gap and each session its day."""
    c = table(spark, sf_dir, "conversations")
    gap = F.pmod(F.col("conv_id") * 37 + F.col("turn") * 53, F.lit(240))
    since = F.sum(gap).over(Window.partitionBy("conv_id").orderBy("turn"))
    start = F.lit(1_577_836_800_000).cast("bigint") + F.col("conv_id") * 86_400_000
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("conv_id").alias("session_seq"), (F.col("turn") + 1).cast("int").alias("turn_index"), "role", F.col("text").alias("content"), (start + since * 1000).alias("ts_ms"), F.hour(F.timestamp_millis(start + since * 1000)).alias("active_hour"))


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, for what a query writes and reads back."""
    return f"{use_shared_folder(spark)}/query-{uuid.uuid4().hex}"


def r(x: str, n: int) -> str:
    """x rounded to n places, half up."""
    return f"(floor(({x}) * {10**n}.0::double + 0.5) / {10**n}.0::double)"


def unit(x: str) -> str:
    return f"greatest(0, least(1, {r(x, 4)}))"
