"""Session defaults and the few session-wide helpers the library needs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
DEFAULT_BROADCAST_LIMIT_ROWS = 100_000
SMALL_SCAN_BYTES = 1024 * 1024


def build_session(master: str | None = None, app_name: str = "logloom", **conf: str) -> SparkSession:
    """Session with the settings the operators are written for.

    Cluster values (shuffle partitions, memory, checkpoint folder) are left to the
    caller or to spark-defaults; only semantics-bearing settings are fixed here.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; fall back to a scratch one only in local tests."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
        return
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder for checkpoints")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="logloom-ckpt-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession) -> str:
    """A new path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read back: lineage is cut and the size is known."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_size_bytes(df: DataFrame) -> int:
    """Optimizer's size estimate of a plan, which for scans is the size of the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(
    df: DataFrame,
    limit_bytes: int = DEFAULT_BROADCAST_LIMIT_BYTES,
    limit_rows: int = DEFAULT_BROADCAST_LIMIT_ROWS,
) -> DataFrame:
    """Broadcast hint only when the plan's estimate and a real, bounded row count are small.

    Beyond either limit the join stays a shuffled one and adaptive execution splits skewed
    partitions.
    """
    if plan_size_bytes(df) > limit_bytes or df.limit(limit_rows + 1).count() > limit_rows:
        return df
    return F.broadcast(df)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Repartition a file scan that leaves most cores idle (few or unsplittable files).

    A scan with at least half as many splits as there are cores, as any large input has, is
    returned unchanged and costs no shuffle; so is a tiny one.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if plan_size_bytes(scan) < SMALL_SCAN_BYTES or 2 * scan.rdd.getNumPartitions() > cores:
        return scan
    return scan.repartition(cores, *keys)


def quoted(name: str) -> Column:
    """Column reference by exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")
