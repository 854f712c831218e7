"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.session import scratch_folder

WORD = r"[^\x20\x09-\x0D]+"
SLICE_ROWS = 256
SEED = 42
BROADCAST_ROWS = 100_000


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_checked(table: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a stored table of narrow rows, if its real row count is within the bound."""
    return F.broadcast(table) if table.count() <= max_rows else table


def source_key(name: str) -> Column:
    """A never-null text for grouping and joining by a column that may be null."""
    return F.when(F.col(name).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(name)))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space as UTF-8; bytes.split() splits at exactly these characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def shingles(text: str | None, width: int) -> list[bytes]:
    """Runs of `width` words joined by spaces; all words if they are fewer; none without words.

    A-Z is lower-cased (bytes.lower() touches nothing else).
    """
    words = [word.lower() for word in words_of(text)]
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(word) + 1 for word in words], out=starts[1:])
    ends = (starts[width:] - 1).tolist()
    return [joined[start:end] for start, end in zip(starts.tolist(), ends, strict=False)]


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as this Python worker, from task to task.

    Functions are shipped by value, so a module's or class's own variables start anew in each task.
    """
    module = sys.modules.setdefault("logloom_worker_cache", types.ModuleType("logloom_worker_cache"))
    return module.__dict__.setdefault(name, {})


def map_slices(
    df: DataFrame, handle: Callable[[pa.RecordBatch], dict[str, object] | None], schema: str
) -> DataFrame:
    """mapInArrow in slices of few rows, so that memory is bounded by a few long texts.

    `handle` gets a batch and returns the columns of its output rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark_schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                columns = handle(batch.slice(start, SLICE_ROWS))
                if columns is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[field.name], type=field.type) for field in arrow], schema=arrow
                    )

    return df.mapInArrow(run, spark_schema)


def shard_count(rows: DataFrame, shard_rows: int, least_rows: int = 1024) -> int:
    """Shards of at most about `shard_rows`; of a small table as many as there are cores to use."""
    count = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-count // shard_rows), min(2 * cores, count // least_rows))


def probe_shards(
    rows: DataFrame,
    probes: DataFrame,
    shards: int,
    build: Callable[[list[pa.RecordBatch]], object],
    probe: Callable[[object, pa.RecordBatch], dict[str, object]],
    schema: str,
) -> DataFrame:
    """What the probes of each shard find in an index of the shard's rows.

    Both tables have the same columns, `shard` among them. A task takes its shards one after the
    other: it reads the rows of a shard, builds their index, and lets the probes stream through, so
    it holds one shard and one batch of probes, however many probes there are. No row is copied
    for another block of probes.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark_schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, index = None, [], None
        for batch in batches:
            keys = 2 * batch["shard"].to_numpy().astype(np.int64) + batch["__probe"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), batch.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                part, (shard, is_probe) = batch.slice(start, end - start), divmod(int(keys[start]), 2)
                if shard != current:
                    current, held, index = shard, [], None
                if not is_probe:
                    held.append(part)
                    continue
                if held:
                    index, held = build(held), []
                if index is not None:
                    columns = probe(index, part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[field.name], type=field.type) for field in arrow], schema=arrow
                    )

    both = rows.withColumn("__probe", F.lit(0)).unionByName(probes.withColumn("__probe", F.lit(1)))
    placed = both.repartition(shards, "shard").sortWithinPartitions("shard", "__probe")
    return placed.mapInArrow(run, spark_schema)
