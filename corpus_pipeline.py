"""A corpus pipeline of five stages: toxic documents go, then copies, then near-copies; sources are mixed and packed.

Each stage takes the documents that its predecessor kept, written as Parquet and read again, and returns documents with the
columns they came with; the last returns the packed pieces. Labels to learn from are those of the table beside documents.

Defined results: an empty table gives an empty result. A null text scores as one without toxic words, is a copy of other null
and empty texts (one stays), and is taken 0 words by the mix, so it may be taken any whole number of times. Rows of null ids
are rows like any; of rows that repeat an id and a text one stays. A very long text passes every stage whole and is cut into
pieces by the last. Columns beyond those of documents are carried along to the last stage, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from confera.llm.common import shared_dir, table
from confera.llm.exact_dedup import drop_copies
from confera.llm.mixing import repeat_documents
from confera.llm.packing import pack
from confera.llm.queries import tokenizer_path
from confera.llm.simhash import keep_one
from confera.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeat_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The toxicity lexicon is learned and the tokenizer is no SQL function; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
