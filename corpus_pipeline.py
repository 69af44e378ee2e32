"""The corpus pipeline: documents that are clean, unique, uncontaminated, masked and mixed.

Each stage takes the rows the one before has left and returns rows with the
columns of ``documents``; the last adds the copy's number and place. What a
stage decides takes effect: toxic documents and copies and those with a
benchmark item are gone, personal data is masked, sources are repeated.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import leaks, mixing, neardup, pii, toxicity
from veilframe.llm.common import checkpoint_dir, table
from veilframe.llm.queries import CATALOG as OPERATORS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; null and empty texts are scored like others."""
    return toxicity.reject(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies (similarity 0.8); rows without an id stay."""
    gone = neardup.find_groups(docs, 80).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.select(*COLUMNS).join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text no benchmark item stands."""
    return leaks.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with personal data replaced by its kind, and ``n_chars`` of the new text."""
    masked = pii.redact(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies by source weight, ``replica`` and ``mix_key``, in the order of the key."""
    return mixing.mix(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("personal data", mask_personal_data),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each leaves is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs


#: Toxicity, near duplicates, leaks and masking are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None

CATALOG = {**OPERATORS, "pipeline": (run, ORACLE_SQL)}
