"""Reports over the control tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PAGE = 100


def _page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int) -> DataFrame:
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be 1..{MAX_PAGE} and offset not negative")
    return rows.orderBy(*order).offset(offset).limit(limit)


def upload_history(
    runs: DataFrame,
    users: DataFrame,
    status: str | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """A page of runs, newest first, with user name and e-mail.

    The page is cut before the join (user ids are unique, so a left join changes neither its
    rows nor their order); at most ``MAX_PAGE`` rows then meet the users.
    """
    chosen = runs.filter(F.col("status") == status) if status else runs
    newest_first = [F.col("created_at").desc(), F.col("id").desc()]
    page = _page(chosen, newest_first, limit, offset)
    wanted = F.broadcast(page.select(F.col("user_id").alias("_user")).distinct())
    people = users.join(wanted, users["id"] == F.col("_user"), "left_semi").select(
        F.col("id").alias("user_id"), F.col("name").alias("user_name"), F.col("email").alias("user_email")
    )
    # bounded by the page: one row per user in it
    return page.join(F.broadcast(people), "user_id", "left").orderBy(*newest_first)


def with_target_exists(history: DataFrame, existing: DataFrame | None, target: str = "target") -> DataFrame:
    """Adds ``target_exists``: null when the listing failed or the run has no target."""
    if existing is None:
        return history.withColumn("target_exists", F.lit(None).cast("boolean"))
    listed = existing.select(F.col("target").alias("_listed")).distinct()
    joined = history.join(listed, F.col(target) == F.col("_listed"), "left")
    return joined.withColumn(
        "target_exists", F.when(F.col(target).isNotNull(), F.col("_listed").isNotNull())
    ).drop("_listed")


def filter_audit(
    log: DataFrame, actor_id: str | None = None, event_type: str | None = None, target_type: str | None = None
) -> DataFrame:
    wanted = {"actor_id": actor_id, "event_type": event_type, "target_type": target_type}
    for name, value in wanted.items():
        if value:
            log = log.filter(F.col(name) == value)
    return log


def audit_page(log: DataFrame, page: int = 1, page_size: int = 50, **filters: str | None) -> DataFrame:
    """One page of the filtered log, newest first, ties by id."""
    chosen = filter_audit(log, **filters)
    return _page(chosen, [F.col("created_at").desc(), F.col("id").desc()], page_size, (page - 1) * page_size)


def page_counts(log: DataFrame, page_size: int = 50, **filters: str | None) -> DataFrame:
    """(total, pages) of the filtered log; there is always at least one page."""
    total = filter_audit(log, **filters).agg(F.count(F.lit(1)).alias("total"))
    return total.withColumn("pages", F.greatest(F.ceil(F.col("total") / page_size), F.lit(1)).cast("bigint"))


def event_types(log: DataFrame) -> DataFrame:
    return log.filter("event_type != ''").select("event_type").distinct().orderBy("event_type")


def active_members(users: DataFrame, include_deleted: bool = True) -> DataFrame:
    chosen = users if include_deleted else users.filter(F.col("deleted_at").isNull())
    return chosen.orderBy(F.col("created_at").desc(), F.col("id").desc())


def member_counts(users: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All members, active ones and active administrators."""
    active = F.col("deleted_at").isNull()
    return users.groupBy(*by).agg(
        F.count(F.lit(1)).alias("members"),
        F.count_if(active).alias("active"),
        F.count_if(active & F.col("is_admin")).alias("admins"),
    )


def run_totals(runs: DataFrame, by: Sequence[str] = ("status",)) -> DataFrame:
    """Runs and record counts per status, format, user or any other run attribute."""
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("total_records").alias("processed"),
        F.sum("success_count").alias("success"),
        F.sum("failure_count").alias("failed"),
    )


def key_expiry(keys: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Adds ``days_left``, ``warning`` and ``priority`` (0 expired, 1 within a week, 2 later)."""
    micros = F.unix_micros(F.col(expires).cast("timestamp")) - F.unix_micros(now)
    days = F.ceil(micros / F.lit(86_400_000_000)).cast("bigint")
    warning = (
        F.when(F.col("days_left") <= 0, "Expired")
        .when(F.col("days_left") == 1, "Expires today")
        .when(F.col("days_left") <= 7, F.concat(F.lit("Expires in "), F.col("days_left").cast("string"), F.lit(" days")))
    )
    priority = F.when(F.col("days_left") <= 0, 0).when(F.col("days_left") <= 7, 1).otherwise(2)
    return keys.withColumn("days_left", days).withColumn("warning", warning).withColumn("priority", priority)


def by_urgency(expiry: DataFrame, created: str = "created_at", id_: str = "id") -> DataFrame:
    """Expired first, then those within a week by days left, the rest newest first."""
    soon = F.when(F.col("priority") < 2, F.col("days_left"))
    return expiry.orderBy("priority", soon, F.col(created).desc(), id_)


def last_activity(log: DataFrame, event_type: str | Sequence[str], by: str = "actor_id") -> DataFrame:
    """Latest time per entity among the given event types."""
    wanted = [event_type] if isinstance(event_type, str) else list(event_type)
    return (
        log.filter(F.col("event_type").isin(*wanted)).groupBy(by).agg(F.max("created_at").alias("last_at"))
    )
