"""A pipeline over the corpus: each stage takes what its predecessor kept.

(1) documents that the toxicity grammar rejects go; (2) of each group of near copies one
document stays; (3) documents that test items contaminate go; (4) sources are mixed to
their target weights, documents of some repeated; (5) what is left is put in shards along
a curve, texts and all.

An empty table passes through all stages; columns beyond those of ``documents`` are kept;
nulls are handled as each operator says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cartula.llm import decontam, hilbert, mixing, simhash, toxicity
from cartula.llm.common import remove_at_end, scratch, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hilbert.sharded(docs, 8)


STAGES = [
    ("toxicity", toxic_out),
    ("simhash near-dedup", near_copies_out),
    ("benchmark decontamination", contaminated_out),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]

#: SQL can express neither the fitted grammar nor the near copies.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; between stages documents are written as Parquet to the shared folder and read again.

    The folder goes when the driver ends.
    """
    docs = table(spark, sf_dir, "documents")
    at = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        remove_at_end(spark, at)
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
