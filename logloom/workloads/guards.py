"""Allowlists, trailing counts, admission and lockout replays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.allowlist import check_allowlists
from logloom.operators.replay import replay_admission, replay_lockout, trailing_counts
from logloom.session import scratch_folder
from logloom.streaming.guards import held_admission, held_lockout, stream_admission, stream_lockout
from logloom.workloads import spread_table, table, workload


@workload(
    "address_allowlist",
    """
    SELECT event_id, CASE key % 5
             WHEN 0 THEN TRUE
             WHEN 1 THEN event_id % 10 <> 0 AND key % 4 = (event_id % 4) AND event_id % 256 < 128
             WHEN 2 THEN event_id % 10 <> 0
             WHEN 3 THEN event_id % 10 <> 0 AND event_id % 256 IN (7, 9)
             ELSE FALSE END AS allowed
    FROM (SELECT event_id, user_id % 25 AS key FROM events)
    """,
)
def address_allowlist(spark: SparkSession, folder: str) -> DataFrame:
    """Access log of events against one allowlist per nation."""
    access = spread_table(spark, folder, "events", "event_id").select(
        "event_id",
        (F.col("user_id") % 25).alias("key"),
        F.when(F.col("event_id") % 10 == 0, "unknown")
        .otherwise(F.concat(F.lit("10.0."), F.col("event_id") % 4, F.lit("."), F.col("event_id") % 256))
        .alias("ip"),
    )
    key = F.col("n_nationkey").cast("bigint")
    every = [F.concat(F.lit(f"10.0.{third}."), F.lit(fourth)) for third in range(4) for fourth in ("7", "9")]
    lists = F.element_at(
        F.array(
            F.lit("  "),
            F.concat(F.lit("10.0."), key % 4, F.lit(".77/25, bad entry, 1.2.3.4/99")),
            F.lit("192.168.0.0/16,10.0.200.1/255.255.0.0"),
            F.concat_ws(" , ", *every),
            F.lit("::/0, 2001:db8::1"),
        ),
        (key % 5 + 1).cast("int"),
    )
    keys = table(spark, folder, "nation").select(key.alias("key"), lists.alias("allowed_ips"))
    return check_allowlists(access, keys, "key").select("event_id", "allowed")


@workload(
    "long_allowlists",
    """
    SELECT event_id, c_custkey IS NOT NULL AND key = place // 300 AND CASE c_custkey % 3 WHEN 0 THEN TRUE
             WHEN 1 THEN host BETWEEN 64 AND 79 ELSE host = 9 END AS allowed
    FROM (SELECT event_id, event_id % 3000 AS place, event_id % 3000 // 300 + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS key,
                 CASE WHEN event_id % 5 = 0 THEN 9 ELSE event_id * 31 % 256 END AS host FROM events)
    LEFT JOIN customer ON c_custkey = place
    """,
)
def long_allowlists(spark: SparkSession, folder: str) -> DataFrame:
    """Access log of events against lists of 300 networks and addresses, one per 300 customers."""
    place = F.col("event_id") % 3000
    last = F.when(F.col("event_id") % 5 == 0, 9).otherwise(F.col("event_id") * 31 % 256)
    access = spread_table(spark, folder, "events", "event_id").select(
        "event_id",
        (F.floor(place / 300) + F.when(F.col("event_id") % 4 == 0, 1).otherwise(0)).alias("key"),
        F.concat_ws(".", F.lit("10"), F.floor(place / 256), place % 256, last).alias("ip"),
    )
    customer = F.col("c_custkey")
    base = F.concat_ws(".", F.lit("10"), F.floor(customer / 256), customer % 256)
    ending = F.element_at(F.array(F.lit(".0/24"), F.lit(".77/28"), F.lit(".9")), (customer % 3 + 1).cast("int"))
    # 300 customers a list
    keys = (
        table(spark, folder, "customer")
        .groupBy(F.floor(customer / 300).alias("key"))
        .agg(F.array_join(F.collect_list(F.concat(base, ending)), ",").alias("allowed_ips"))
    )
    return check_allowlists(access, keys, "key").select("event_id", "allowed")


@workload(
    "trailing_failures",
    """
    SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 259199999999 MICROSECOND PRECEDING AND CURRENT ROW) AS recent
    FROM events WHERE event_type = 'error'
    """,
)
def trailing_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Failures of the same user in the three days up to each failure."""
    failures = table(spark, folder, "events").filter(F.col("event_type") == "error").select("event_id", "user_id", "ts")
    return trailing_counts(failures, "user_id", "ts", 3 * 86400).select("event_id", "recent")


_ADMISSION_SQL = """
    WITH RECURSIVE e AS (
      SELECT event_id, user_id, epoch_us(ts) AS t_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    r AS (
      SELECT user_id, rn, event_id, TRUE AS allowed, [t_us] AS taken, CAST(0 AS BIGINT) AS retry_after, t_us FROM e WHERE rn = 1
      UNION ALL
      SELECT user_id, rn, event_id, len(live) < 3 AS allowed, CASE WHEN len(live) < 3 THEN list_append(live, t_us) ELSE live END AS taken,
             CASE WHEN len(live) < 3 THEN 0 ELSE greatest(1, CAST(trunc((live[1] + 172800000000 - t_us) / 1000000.0) AS BIGINT) + 1) END, t_us
      FROM (SELECT e.user_id, e.rn, e.event_id, e.t_us, list_filter(r.taken, lambda t: t > e.t_us - 172800000000) AS live
            FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
    SELECT event_id, allowed, CAST(retry_after AS INTEGER) AS retry_after, CAST(3 - len(taken) AS INTEGER) AS remaining FROM r
    """


@workload("admission_replay", _ADMISSION_SQL)
def admission_replay(spark: SparkSession, folder: str) -> DataFrame:
    """At most three admitted events per user in any two days."""
    events = table(spark, folder, "events")
    replayed = replay_admission(events, "user_id", "ts", "event_id", limit=3, window_seconds=2 * 86400)
    return replayed.select("event_id", "allowed", "retry_after", "remaining")


@workload(
    "admission_saturated",
    _ADMISSION_SQL.replace("user_id", "event_type").replace("172800000000", "7200000000"),
)
def admission_saturated(spark: SparkSession, folder: str) -> DataFrame:
    """At most three admitted events of each type in any two hours: few keys without any pause, run in blocks."""
    events = table(spark, folder, "events")
    replayed = replay_admission(events, "event_type", "ts", "event_id", limit=3, window_seconds=7200, block_events=1000)
    return replayed.select("event_id", "allowed", "retry_after", "remaining")


_LOCKOUT_SQL = """
    WITH RECURSIVE e AS (
      SELECT event_id, user_id, epoch_us(ts) AS t_us, event_type = 'error' AS failed,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
      FROM events WHERE event_type IN ('error', 'signup')),
    r AS (
      SELECT user_id, rn, event_id, FALSE AS locked, CASE WHEN failed THEN [t_us] ELSE CAST([] AS BIGINT[]) END AS taken FROM e WHERE rn = 1
      UNION ALL
      SELECT user_id, rn, event_id, len(live) >= 2,
             CASE WHEN len(live) >= 2 THEN live WHEN failed THEN list_append(live, t_us) ELSE CAST([] AS BIGINT[]) END
      FROM (SELECT e.user_id, e.rn, e.event_id, e.t_us, e.failed, list_filter(r.taken, lambda t: t > e.t_us - 432000000000) AS live
            FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
    SELECT event_id, locked, CAST(len(taken) AS INTEGER) AS failures, NOT locked AND len(taken) = 2 AS locks FROM r
    """


@workload("lockout_replay", _LOCKOUT_SQL)
def lockout_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Two errors within five days lock a user out; a signup clears the count."""
    logins = table(spark, folder, "events").filter(F.col("event_type").isin("error", "signup"))
    replayed = replay_lockout(
        logins, "user_id", "ts", "event_id", F.col("event_type") == "error", attempts=2, window_minutes=5 * 1440
    )
    return replayed.select("event_id", "locked", "failures", "locks")


def _event_stream(spark: SparkSession, folder: str, files: int = 2) -> DataFrame:
    """The events as files of consecutive times, one per trigger."""
    events = table(spark, folder, "events")
    place = scratch_folder(spark)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = (value or 0 for value in events.agg(F.min(at), F.max(at)).first())
    part = F.floor((at - first) * files / (last - first + 1))
    for number in range(files):
        events.filter(part == number).coalesce(1).write.mode("append").parquet(place)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(place)


def _run_to_end(decided: DataFrame, held: Callable[[str], DataFrame]) -> DataFrame:
    """Rows of a finished stream: what it has decided, and what its last state still held."""
    spark = decided.sparkSession
    place = scratch_folder(spark)
    query = (
        decided.writeStream.format("parquet")
        .option("checkpointLocation", f"{place}/state")
        .option("path", f"{place}/rows")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(decided.schema).parquet(f"{place}/rows").unionByName(held(f"{place}/state"))


@workload("admission_stream", _ADMISSION_SQL)
def admission_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same rule on a stream of event files; decisions come once the watermark has passed."""
    keys = ("user_id", "ts", "event_id")
    rule = {"limit": 3, "window_seconds": 2 * 86400}
    decided = stream_admission(_event_stream(spark, folder), *keys, **rule, lateness="0 seconds")
    rows = _run_to_end(decided, lambda state: held_admission(spark, state, *keys, **rule))
    return rows.select("event_id", "allowed", "retry_after", "remaining")


@workload("lockout_stream", _LOCKOUT_SQL)
def lockout_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The lockout rule on a stream of login events."""
    keys = ("user_id", "ts", "event_id")
    rule = {"attempts": 2, "window_minutes": 5 * 1440}
    logins = _event_stream(spark, folder).filter(F.col("event_type").isin("error", "signup"))
    decided = stream_lockout(logins, *keys, F.col("event_type") == "error", **rule, lateness="0 seconds")
    rows = _run_to_end(decided, lambda state: held_lockout(spark, state, *keys, **rule))
    return rows.select("event_id", "locked", "failures", "locks")
