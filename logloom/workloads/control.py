"""Ingest outcomes, reports over control tables, retention and housekeeping."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.replay import recent_counts
from logloom.plans import ingest as I
from logloom.plans import reports as R
from logloom.plans.control import audit_events, latest_states
from logloom.plans.retention import expired_rows, live_rows, retention_plan
from logloom.sources.records import json_columns
from logloom.streaming.progress import with_rates
from logloom.workloads import table, workload
from logloom.workloads.formats import EVENT_FIELDS, event_json_lines


def _utc(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)


# ---------------------------------------------------------------- tables under their control names


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as ingest runs, customers as the users who started them."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("file_format"),
        F.concat(F.lit("logs-"), F.col("o_orderkey") % 97).alias("target"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.col("o_totalprice").cast("bigint").alias("total_records"),
        (F.col("o_totalprice").cast("bigint") - F.col("o_orderkey") % 5).alias("success_count"),
        (F.col("o_orderkey") % 5).alias("failure_count"),
    )


def _users(spark: SparkSession, folder: str) -> DataFrame:
    gone = F.when(F.col("c_custkey") % 7 == 0, F.lit("2024-01-01").cast("timestamp"))
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat("c_name", F.lit("@example.org")).alias("email"),
        F.col("c_mktsegment").alias("auth_type"),
        (F.col("c_custkey") % 10 == 0).alias("is_admin"),
        F.timestamp_seconds(F.col("c_custkey") * 3600).alias("created_at"),
        gone.alias("deleted_at"),
    )


def _audit(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return audit_events(
        events,
        F.col("event_type"),
        F.col("ts"),
        F.col("event_id"),
        actor_id=F.col("user_id"),
        target_type="index",
        target_id=F.col("event_id") % 13,
        details=[F.col("value").alias("value"), F.col("event_type").alias("kind")],
    ).withColumn("id", F.col("id").cast("bigint"))


# ---------------------------------------------------------------- ingest


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    records = json_columns(event_json_lines(spark, folder), EVENT_FIELDS).withColumnRenamed("source_file", I.SOURCE)
    rules = {
        "value is too large": F.col("value").cast("double") > 200,
        "click without a user": (F.col("event_type") == "click") & (F.col("user_id") % 10 == 0),
    }
    plan = I.FieldPlan({"ts": "seen"}, ("props",), "ts", {"value": "float"})
    return I.split_outcomes(records.drop("source_path", "split_start", "line_id"), plan, rules)


@workload(
    "ingest_outcomes",
    """
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS seen, value, event_type AS file,
           CASE WHEN value > 200 THEN 'value is too large'
                WHEN event_type = 'click' AND user_id % 10 = 0 THEN 'click without a user' END AS error,
           CASE WHEN value > 200 OR (event_type = 'click' AND user_id % 10 = 0) THEN 'dead' ELSE 'ok' END AS outcome
    FROM events
    """,
)
def ingest_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted and rejected records of one ingest, with the reason."""
    return _outcomes(spark, folder).select(
        "event_id", "seen", "value", F.col(I.SOURCE).alias("file"), F.col(I.ERROR).alias("error"), "outcome"
    )


@workload(
    "dead_letters",
    """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS kind FROM events
    WHERE value > 200 OR (event_type = 'click' AND user_id % 10 = 0)
    """,
)
def dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    """The original record, excluded fields included, is kept for every rejected one."""
    dead = _outcomes(spark, folder).filter(F.col("outcome") == I.DEAD)
    original = F.from_json(I.RECORD, "event_id bigint, event_type string, props struct<k: bigint>")
    return dead.select(original.alias("r")).select(
        F.col("r.event_id").alias("event_id"), F.col("r.props.k").alias("k"), F.col("r.event_type").alias("kind")
    )


@workload(
    "file_results",
    """
    SELECT event_type AS file, count(*) AS processed, count(*) FILTER (WHERE NOT bad) AS success, count(*) FILTER (WHERE bad) AS failed
    FROM (SELECT event_type, value > 200 OR (event_type = 'click' AND user_id % 10 = 0) AS bad FROM events) GROUP BY 1
    """,
)
def file_results(spark: SparkSession, folder: str) -> DataFrame:
    return I.file_results(_outcomes(spark, folder)).withColumnRenamed(I.SOURCE, "file")


@workload(
    "job_totals",
    """
    SELECT o_custkey AS job, CAST(sum(n) AS BIGINT) AS processed, CAST(sum(good) AS BIGINT) AS success, CAST(sum(n - good) AS BIGINT) AS failed
    FROM (SELECT o_custkey, l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'R') AS good
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1
    """,
)
def job_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as records, orders as files, customers as jobs."""
    items, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    records = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("job"),
        F.col("l_orderkey").alias(I.SOURCE),
        F.when(F.col("l_returnflag") == "R", I.DEAD).otherwise(I.OK).alias(I.OUTCOME),
    )
    return I.job_totals(I.file_results(records, ["job"]), ["job"])


@workload(
    "target_names",
    """
    SELECT p_partkey, CASE form WHEN 0 THEN NULL WHEN 1 THEN 'target name is empty' WHEN 2 THEN 'target name starts with ''-'' or ''_'''
             WHEN 3 THEN 'target name holds '' ''' WHEN 4 THEN 'target name is not in lower case' ELSE 'target name holds ''*''' END AS error
    FROM (SELECT p_partkey, p_partkey % 6 AS form FROM part)
    """,
)
def target_names(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    name = F.element_at(
        F.array(
            F.regexp_replace("p_name", " ", "-"), F.lit(""), F.concat(F.lit("_"), "p_name"), F.col("p_name"),
            F.regexp_replace("p_brand", "#", "-"), F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("*")),
        ),
        (F.col("p_partkey") % 6 + 1).cast("int"),
    )
    return I.target_name_errors(part.select("p_partkey", name.alias("name")), prefix="logs-").select("p_partkey", "error")


@workload(
    "progress_rates",
    """
    SELECT o_orderkey AS id, CASE WHEN e > 0 THEN CAST(p AS DOUBLE) / e ELSE 0.0 END AS records_per_second,
           CASE WHEN e > 0 AND p > 0 THEN (t - p) / (CAST(p AS DOUBLE) / e) ELSE 0.0 END AS estimated_remaining_seconds
    FROM (SELECT o_orderkey, o_orderkey % 1000 AS p, CAST(2000 AS BIGINT) AS t, CAST(o_orderkey % 60 AS DOUBLE) AS e FROM orders)
    """,
)
def progress_rates(spark: SparkSession, folder: str) -> DataFrame:
    progress = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderkey") % 1000).alias("processed"),
        F.lit(2000).cast("bigint").alias("total"),
        (F.col("o_orderkey") % 60).cast("double").alias("elapsed_seconds"),
    )
    return with_rates(progress).select("id", "records_per_second", "estimated_remaining_seconds")


# ---------------------------------------------------------------- reports


@workload(
    "history_page",
    """
    SELECT o_orderkey AS id, o_orderstatus AS status, 'logs-' || (o_orderkey % 97) AS target,
           strftime(o_orderdate, '%Y-%m-%d') AS created, c_name AS user_name, c_name || '@example.org' AS user_email,
           (o_orderkey % 97) < 50 AS target_exists
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'
    ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100
    """,
)
def history_page(spark: SparkSession, folder: str) -> DataFrame:
    """Third page of failed runs with their users, and whether each target still exists."""
    page = R.upload_history(_runs(spark, folder), _users(spark, folder), status="F", limit=50, offset=100)
    existing = (
        table(spark, folder, "orders").filter(F.col("o_orderkey") % 97 < 50)
        .select(F.concat(F.lit("logs-"), F.col("o_orderkey") % 97).alias("target"))
    )
    return R.with_target_exists(page, existing).select(
        "id", "status", "target", F.date_format("created_at", "yyyy-MM-dd").alias("created"), "user_name",
        "user_email", "target_exists",
    )


@workload(
    "audit_page",
    """
    SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created, CAST(user_id AS VARCHAR) AS actor_id,
           CAST(event_id % 13 AS VARCHAR) AS target_id
    FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 100
    """,
)
def audit_page(spark: SparkSession, folder: str) -> DataFrame:
    page = R.audit_page(_audit(spark, folder), 2, 100, event_type="purchase", target_type="index")
    return page.select("id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created"), "actor_id", "target_id")


@workload(
    "audit_page_counts",
    """
    SELECT count(*) AS total, CAST(greatest(ceil(count(*) / 50.0), 1) AS BIGINT) AS pages FROM events
    WHERE event_type = 'error' AND user_id = 7
    """,
)
def audit_page_counts(spark: SparkSession, folder: str) -> DataFrame:
    return R.page_counts(_audit(spark, folder), 50, actor_id="7", event_type="error")


@workload("audit_event_types", "SELECT DISTINCT event_type FROM events WHERE event_type <> ''")
def audit_event_types(spark: SparkSession, folder: str) -> DataFrame:
    return R.event_types(_audit(spark, folder))


@workload(
    "audit_rows",
    """
    SELECT event_id AS id, event_type, CAST(user_id AS VARCHAR) AS actor_id, 'index' AS target_type,
           CAST(event_id % 13 AS VARCHAR) AS target_id, value, event_type AS kind FROM events
    """,
)
def audit_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Audit rows built from a table, details as JSON text that can be read back."""
    details = F.from_json("details", "value double, kind string")
    return _audit(spark, folder).select(
        "id", "event_type", "actor_id", "target_type", "target_id", details["value"].alias("value"), details["kind"].alias("kind")
    )


@workload(
    "member_report",
    """
    SELECT c_mktsegment AS auth_type, count(*) AS members, count(*) FILTER (WHERE c_custkey % 7 <> 0) AS active,
           count(*) FILTER (WHERE c_custkey % 7 <> 0 AND c_custkey % 10 = 0) AS admins
    FROM customer GROUP BY 1
    """,
)
def member_report(spark: SparkSession, folder: str) -> DataFrame:
    return R.member_counts(_users(spark, folder), ["auth_type"])


@workload(
    "active_members",
    "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 7 <> 0",
)
def active_members(spark: SparkSession, folder: str) -> DataFrame:
    return R.active_members(_users(spark, folder), include_deleted=False).select("id", "name")


@workload(
    "run_totals",
    """
    SELECT o_orderstatus AS status, o_orderpriority AS file_format, count(*) AS runs, CAST(sum(floor(o_totalprice)) AS BIGINT) AS processed,
           CAST(sum(floor(o_totalprice) - o_orderkey % 5) AS BIGINT) AS success, CAST(sum(o_orderkey % 5) AS BIGINT) AS failed
    FROM orders GROUP BY 1, 2
    """,
)
def run_totals(spark: SparkSession, folder: str) -> DataFrame:
    return R.run_totals(_runs(spark, folder), ["status", "file_format"])


@workload(
    "key_expiry",
    """
    SELECT id, days_left, CASE WHEN days_left <= 0 THEN 'Expired' WHEN days_left = 1 THEN 'Expires today'
             WHEN days_left <= 7 THEN 'Expires in ' || days_left || ' days' END AS warning,
           CASE WHEN days_left <= 0 THEN 0 WHEN days_left <= 7 THEN 1 ELSE 2 END AS priority
    FROM (SELECT o_orderkey AS id, CAST(ceil((epoch(o_orderdate) - epoch(TIMESTAMP '1998-06-01 06:00:00')) / 86400.0) AS BIGINT) AS days_left FROM orders)
    """,
)
def key_expiry(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("expires_at"))
    return R.key_expiry(keys, F.lit(_utc("1998-06-01T06:00:00"))).select("id", "days_left", "warning", "priority")


@workload(
    "last_activity",
    """
    SELECT CAST(user_id AS VARCHAR) AS actor_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_at FROM events
    WHERE event_type IN ('signup', 'view') GROUP BY 1
    """,
)
def last_activity(spark: SparkSession, folder: str) -> DataFrame:
    latest = R.last_activity(_audit(spark, folder), ["signup", "view"])
    return latest.select("actor_id", F.date_format("last_at", "yyyy-MM-dd'T'HH:mm:ss").alias("last_at"))


@workload(
    "recent_failures",
    """
    SELECT user_id, count(*) AS recent FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-28 12:00:00' - INTERVAL 4320 MINUTE
    GROUP BY 1
    """,
)
def recent_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Failures per user later than three days before a fixed moment."""
    failures = table(spark, folder, "events").filter(F.col("event_type") == "error")
    return recent_counts(failures, "user_id", "ts", F.lit(_utc("2024-01-28T12:00:00")), 4320 * 60)


# ---------------------------------------------------------------- retention and housekeeping


@workload(
    "retention_plan",
    """
    SELECT 'logs-' || o_orderkey AS target,
           CASE WHEN NOT o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 365 DAY THEN 'keep'
                WHEN o_orderkey IN (SELECT p_partkey FROM part) THEN 'delete' ELSE 'skip' END AS action
    FROM orders
    """,
)
def retention(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "orders").select(
        F.concat(F.lit("logs-"), "o_orderkey").alias("target"), F.col("o_orderdate").cast("timestamp").alias("created_at")
    )
    tracked = table(spark, folder, "part").select(F.concat(F.lit("logs-"), "p_partkey").alias("target"))
    plan = retention_plan(targets, tracked, _utc("2000-01-01T00:00:00"), 365, "logs-")
    return plan.select("target", "action")


@workload(
    "expired_sessions",
    """
    SELECT 'live' AS state, count(*) AS n, min(event_id) AS first_id FROM events WHERE ts + INTERVAL 1 DAY >= TIMESTAMP '2024-01-15'
    UNION ALL SELECT 'expired', count(*), min(event_id) FROM events WHERE ts + INTERVAL 1 DAY < TIMESTAMP '2024-01-15'
    """,
)
def expired_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Rows a time-to-live purge keeps and removes."""
    sessions = table(spark, folder, "events").select(
        "event_id", (F.col("ts").cast("timestamp") + F.expr("interval 1 day")).alias("expires_at")
    )
    now = _utc("2024-01-15T00:00:00")

    def summary(rows: DataFrame, state: str) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id")).select(
            F.lit(state).alias("state"), "n", "first_id"
        )

    return summary(live_rows(sessions, "expires_at", now), "live").unionByName(
        summary(expired_rows(sessions, "expires_at", now), "expired")
    )


@workload(
    "latest_states",
    """
    SELECT user_id, event_id, event_type AS status, value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
    """,
)
def latest(spark: SparkSession, folder: str) -> DataFrame:
    """Current state of every entity of an append-only state log."""
    log = table(spark, folder, "events").select(
        "user_id", "event_id", F.col("event_type").alias("status"), "value", "ts"
    )
    return latest_states(log, "user_id", "ts", "event_id").drop("ts")
