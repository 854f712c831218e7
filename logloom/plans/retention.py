"""Retention of targets, time-to-live of rows and of dead letters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.plans.control import COMMITTED, Warehouse, utc_now
from logloom.plans.ingest import DEAD, OUTCOME

KEEP, DELETE, SKIP = "keep", "delete", "skip"


def retention_plan(
    targets: DataFrame,
    tracked: DataFrame,
    now: dt.datetime,
    days: int,
    prefix: str = "",
    strict: bool = True,
) -> DataFrame:
    """(target, created_at, action) of every target under the prefix.

    Older than the limit (strictly) means delete, or skip when strict mode does not know the
    target. A limit of 0 days keeps everything.
    """
    own = targets.filter(F.col("target").startswith(prefix)) if prefix else targets
    marked = own.join(tracked.select("target", F.lit(True).alias("known")).distinct(), "target", "left")
    cutoff = F.lit(now) - F.make_dt_interval(F.lit(days))
    old = (F.lit(days > 0)) & (F.col("created_at") < cutoff)
    unknown = F.lit(strict) & F.col("known").isNull()
    action = F.when(~old, KEEP).when(unknown, SKIP).otherwise(DELETE)
    return marked.select("target", "created_at", action.alias("action"))


def apply_retention(warehouse: Warehouse, days: int, now: dt.datetime | None = None) -> dict[str, object]:
    """Delete old targets; deletion also untracks them, flags their runs and is audited."""
    result: dict[str, object] = {"checked": 0, "deleted": [], "skipped": [], "errors": []}
    if days <= 0:
        return result
    plan = retention_plan(
        warehouse.existing_targets(), warehouse.tracked_targets(), now or utc_now(), days, warehouse.prefix, warehouse.strict
    )
    # one row per target folder: a list the driver has just made by listing folders
    rows = plan.orderBy("target").collect()
    result["checked"] = len(rows)
    for row in rows:
        if row["action"] == SKIP:
            result["skipped"].append(row["target"])
        elif row["action"] == DELETE:
            deleted = warehouse.drop_target(row["target"], "system", "retention-policy")
            result["deleted" if deleted else "errors"].append(row["target"])
    return result


def live_rows(table: DataFrame, expires: str, now: dt.datetime) -> DataFrame:
    return table.filter(F.col(expires).isNull() | (F.col(expires) >= F.lit(now)))


def expired_rows(table: DataFrame, expires: str, now: dt.datetime) -> DataFrame:
    return table.filter(F.col(expires) < F.lit(now))


def write_expiring(table: DataFrame, path: str, expires: str) -> None:
    """Lay a table out by expiry day, so that purging mostly drops whole partitions."""
    table.withColumn("expires_on", F.to_date(expires)).write.mode("append").partitionBy("expires_on").parquet(path)


def purge_expired(warehouse: Warehouse, path: str, expires: str, now: dt.datetime | None = None) -> int:
    """Remove expired rows of such a table; only the current day's partition is rewritten.

    Its live rows are written beside it and swapped in by two renames, under names that readers
    skip. A purge that breaks off between them is put right by the next one.
    """
    now = now or utc_now()
    spark: SparkSession = warehouse.spark
    today = now.date()
    folder, aside = f"{path}/expires_on={today.isoformat()}", f"{path}/_aside-{today.isoformat()}"
    if warehouse.exists(aside) and not warehouse.exists(folder):
        warehouse.move(aside, folder)
    warehouse.delete(aside)
    table = spark.read.option("basePath", path).parquet(path)
    gone = expired_rows(table, expires, now)
    removed = gone.count()
    days = [r[0] for r in gone.filter(F.col("expires_on") < F.lit(today)).select("expires_on").distinct().collect()]
    for day in days:
        warehouse.delete(f"{path}/expires_on={day.isoformat()}")
    edge = table.filter(F.col("expires_on") == F.lit(today))
    if not expired_rows(edge, expires, now).isEmpty():
        fresh = f"{path}/_fresh-{today.isoformat()}"
        live_rows(edge, expires, now).drop("expires_on").write.mode("overwrite").parquet(fresh)
        warehouse.move(folder, aside)
        warehouse.move(fresh, folder)
        warehouse.delete(aside)
    return removed


def purge_dead_letters(warehouse: Warehouse, hours: int, now: dt.datetime | None = None) -> list[str]:
    """Drop the rejected records of runs that finished longer ago than ``hours``; 0 keeps all."""
    if hours <= 0:
        return []
    cutoff = (now or utc_now()) - dt.timedelta(hours=hours)
    old = warehouse.manifest().filter(F.col("status").isin(*COMMITTED) & (F.col("completed_at") < F.lit(cutoff)))
    runs = old.filter(F.col("failure_count") > 0).select("id", "target").collect()
    return [
        row["id"]
        for row in runs
        if warehouse.delete(f"{warehouse.run_path(row['target'], row['id'])}/{OUTCOME}={DEAD}")
    ]
