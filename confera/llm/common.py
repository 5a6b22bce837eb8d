"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of ASCII white space (Java and Python syntax); a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A folder of this machine won't do on a cluster, so unset is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        found = "file://" + tempfile.mkdtemp(prefix="confera-shared-")  # driver and executors are one process
        spark.conf.set("spark.checkpoint.dir", found)
    if not found:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


#: Rows of narrow tables that one file of a checkpoint holds, where their number is known.
ROWS_A_FILE = 200_000
#: Files it has at least: a reader of one file would have all rows in one task.
LEAST_FILES = 8


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cuts the lineage through the shared folder, so that a lost executor costs no recomputation from the start.

    rows: about how many there are, if known; then there are as many files as they fill, however many partitions df has.
    """
    shared_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(max(LEAST_FILES, -(-rows // ROWS_A_FILE)))).checkpoint(eager=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(text: Column) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def own_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name in taken:
        name += "_"
    return name


#: What a Python worker gets at once of texts: bounds its memory whatever the length of the rows.
BATCH_BYTES = 4 << 20


def text_batches(df: DataFrame) -> DataFrame:
    """df, after its session has been told to hand rows to Python workers in batches of bounded size."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df
