"""Weighted rendezvous hashing of stable record keys, and gapless slots inside shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.llm.common import stored

LAW = "key"


def rendezvous_shard(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard with the largest score weight / -ln(u), u being a hash of key and shard in (0, 1).

    A shard's score never depends on other shards, so another shard only takes rows into itself,
    and a shard's share of the keys is its share of the weights. Null keys all score alike.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above zero")

    def scored(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(shard)), 11)
        unit = (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))
        return F.struct((F.lit(float(weight)) / -F.log(unit)).alias("score"), F.lit(shard).alias("shard"))

    candidates = [scored(shard, weight) for shard, weight in enumerate(weights)]
    best = F.greatest(*candidates) if len(candidates) > 1 else candidates[0]
    return best["shard"]


def with_shards(
    records: DataFrame, key: str, weights: Sequence[float], grown_by: float | None = None, seed: int = 0
) -> DataFrame:
    """All records with `shard`, and with `grown_shard` where a shard of weight `grown_by` joins.

    Input columns of these names are replaced. Records without a key share one shard.
    """
    out = records.withColumn("shard", rendezvous_shard(F.col(key), weights, seed))
    if grown_by is not None:
        out = out.withColumn("grown_shard", rendezvous_shard(F.col(key), [*weights, grown_by], seed))
    return out


def with_slots(placed: DataFrame, shard: str = "shard") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in scan order.

    The rows are stored once with the task that wrote them; a shard's slots are the rows' numbers
    within (shard, task) plus the totals of earlier tasks, so no shard meets in one task. Ties and
    repeated rows get slots of their own; an empty table stays empty. Keep `placed` narrow.
    """
    kept = stored(
        placed.withColumn("__task", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
    )
    before = Window.partitionBy(shard).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        kept.groupBy(shard, "__task")
        .agg(F.count("*").alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    within = Window.partitionBy(shard, "__task").orderBy("__row")
    numbered = kept.withColumn("__local", F.row_number().over(within) - 1)
    return (
        numbered.join(totals, [shard, "__task"])
        .withColumn("slot", (F.col("__before") + F.col("__local")).cast("long"))
        .drop("__task", "__row", "__local", "__before")
    )


def shard_documents(
    documents: DataFrame, weights: Sequence[float], grown_by: float | None = 1.0, seed: int = 0
) -> DataFrame:
    """Shard, slot and size of every document; a narrow table that `write_shards` can be joined to.

    Size is the UTF-8 length plus 1. A null text counts as none: size 1 and the checksum of the
    empty text. Other input columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return with_slots(with_shards(narrow, "doc_id", weights, grown_by, seed))


def write_shards(records: DataFrame, key: str, weights: Sequence[float], path: str, seed: int = 0) -> None:
    """Write the records as one Parquet folder per shard, without a shuffle.

    Each task adds a file to the shards it holds rows of, so a hot shard is written by many tasks.
    """
    with_shards(records, key, weights, seed=seed).write.partitionBy("shard").parquet(path)
