"""From raw documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logloom.llm.common import stored  # noqa: E402
from logloom.llm.line_dedup import dedup_lines  # noqa: E402
from logloom.llm.mixing import mixed_documents  # noqa: E402
from logloom.llm.near_copies import keep_one  # noqa: E402
from logloom.llm.packing import pack_documents  # noqa: E402
from logloom.llm.queries import TOXIC_FROM, tokenizer_path  # noqa: E402
from logloom.llm.toxicity import drop_toxic, train_toxicity  # noqa: E402

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go; it learns from the table `labels`."""
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), max_rows=6000)
    return drop_toxic(docs, model, TOXIC_FROM)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 40 characters found in 5 documents or more stay in one of them."""
    kept = dedup_lines(docs, min_chars=40, min_docs=5)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: SimHash groups and min-wise keys give the
    candidates, a five-word shingle similarity of 0.8 or more decides."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target proportions, documents repeated or left out whole."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their place in sequences of at most 4096 tokens."""
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: SimHash, the classifier and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
