"""Ingest job, control tables, retention, reports and streaming."""

from __future__ import annotations

import datetime as dt
import json
import os
import random
import tempfile
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from logloom.functions.regexes import compile_pattern
from logloom.operators.replay import RULES, replay_admission, replay_lockout
from logloom.plans import delivery as D
from logloom.plans import ingest as I
from logloom.plans import reports as R
from logloom.plans import retention as K
from logloom.plans.control import AUDIT_EVENTS, COMPLETED, FAILED, PENDING, WITH_ERRORS, Warehouse, utc_now
from logloom.plans.preview import describe, preview_files
from logloom.streaming.guards import GuardProcessor, late_events, stream_admission, stream_lockout
from logloom.streaming.ingest import start_ingest
from logloom.streaming.progress import ProgressFeed, live_progress, progress_table, run_progress, with_rates
from tests.conftest import dicts

PEOPLE = '{"name": "Alice", "age": 30}\n{"name": "Bob", "age": 25}\n{"name": "Charlie", "age": 35}\n'


@pytest.fixture
def warehouse(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "warehouse"))


# ---------------------------------------------------------------- names and guard


@pytest.mark.parametrize(
    ("name", "good"),
    [("my-index", True), ("", False), ("MyIndex", False), ("-x", False), ("_x", False), ("a b", False), ("a/b", False),
     ("a*", False), ("a?", False), ("a:b", False), ("x" * 250, True), ("x" * 251, False)],
)
def test_target_names(spark, name, good):
    assert (I.check_target_name(name, "logs-") is None) == good
    frame = I.target_name_errors(spark.createDataFrame([(name,)], "name string"), prefix="logs-")
    assert (frame.first()["error"] is None) == good


def test_strict_guard(spark, warehouse, put):
    assert I.guard_target(warehouse, "logs-new") is True
    warehouse.track("logs-mine", "u")
    warehouse.track("logs-mine", "other")
    assert I.guard_target(warehouse, "logs-mine") is False
    assert [row["created_by"] for row in warehouse.tracked_targets().collect()] == ["u"]
    spark.range(1).write.parquet(warehouse.target_path("logs-foreign"))
    with pytest.raises(I.TargetError, match="strict mode"):
        I.guard_target(warehouse, "logs-foreign")
    lax = Warehouse(spark, warehouse.root, strict=False)
    assert I.guard_target(lax, "logs-foreign") is True
    warehouse.untrack("logs-mine")
    assert not warehouse.is_tracked("logs-mine")


# ---------------------------------------------------------------- ingest


def test_ingest_and_read_back(warehouse, put):
    result = I.ingest(warehouse, put("p.ndjson", PEOPLE), "people", include_filename=True, user="u1")
    assert (result.status, result.processed, result.success, result.failed) == (COMPLETED, 3, 3, 0)
    rows = dicts(I.read_target(warehouse, "people"))
    assert {"name": "Bob", "age": 25, "source_file": "p.ndjson"} in rows and len(rows) == 3
    run = warehouse.manifest().first()
    assert (run["file_format"], run["filenames"], run["user_id"], run["total_records"]) == ("ndjson", ["p.ndjson"], "u1", 3)
    events = [row["event_type"] for row in warehouse.audit_log().orderBy("created_at").collect()]
    assert events == ["ingestion_started", "index_created", "ingestion_completed"]
    assert set(events) <= set(AUDIT_EVENTS)
    again = I.ingest(warehouse, put("p.ndjson", PEOPLE), "people", run_id=result.run_id)
    assert again.processed == 3 and I.read_target(warehouse, "people").count() == 3
    I.ingest(warehouse, put("q.ndjson", PEOPLE), "people")
    assert I.read_target(warehouse, "people").count() == 6


def test_rules_and_dead_letters(warehouse, put, tmp_path):
    rules = {"Mapping error": F.col("name") == "Bob"}
    result = I.ingest(
        warehouse, put("p.ndjson", PEOPLE + "{broken\n"), "people", rules=rules, field_mappings={"name": "user.name"},
        excluded_fields=["age"],
    )
    assert (result.status, result.success, result.failed) == (WITH_ERRORS, 2, 2)
    dead = {row["error"]: row["record"] for row in I.read_dead_letters(warehouse, "people", result.run_id).collect()}
    assert json.loads(dead["Mapping error"]) == {"name": "Bob", "age": 25} and dead["malformed JSON"] == "{broken"
    assert sorted(row["user.name"] for row in I.read_target(warehouse, "people").collect()) == ["Alice", "Charlie"]
    I.export_dead_letters(warehouse, "people", result.run_id, str(tmp_path / "dead"))
    assert warehouse.spark.read.json(str(tmp_path / "dead")).count() == 2


def test_values_that_do_not_fit_the_target(warehouse, put):
    I.ingest(warehouse, put("a.ndjson", '{"n": 1, "deep": {"x": 1}}\n'), "t")
    result = I.ingest(warehouse, put("b.ndjson", '{"n": "two", "new": true}\n{"n": "3", "deep": 5}\n'), "t")
    assert (result.success, result.failed) == (1, 1)
    assert I.read_dead_letters(warehouse, "t").first()["error"] == "field n: value does not fit type bigint"
    assert sorted(row["n"] for row in I.read_target(warehouse, "t").collect()) == [1, 3]
    assert I.read_target(warehouse, "t").columns == ["n", "deep", "new"]


def test_failed_runs_leave_nothing_visible(warehouse, put):
    I.ingest(warehouse, put("a.ndjson", PEOPLE), "t")
    with pytest.raises(Exception):
        I.ingest(warehouse, put("b.ndjson", PEOPLE), "t", rules={"x": F.raise_error(F.lit("boom")).isNull()})
    assert I.read_target(warehouse, "t").count() == 3
    statuses = sorted(row["status"] for row in warehouse.manifest().collect())
    assert statuses == [COMPLETED, FAILED]
    assert warehouse.manifest().filter(F.col("status") == FAILED).first()["error_message"]


def test_timestamp_field_and_formats(warehouse, put):
    path = put("x.log", 'ts=1700000000 level=info msg="a b"\n  trace=1\nts=1700000001 level=warn\n')
    I.ingest(
        warehouse, path, "logs", fmt="logfmt", timestamp_field="ts", multiline_start="ts=", field_types={"trace": "integer"}
    )
    rows = sorted(dicts(I.read_target(warehouse, "logs")), key=repr)
    assert rows[0] == {
        "ts": "2023-11-14T22:13:20Z", "level": "info", "msg": "a b", "trace": 1, "@timestamp": "2023-11-14T22:13:20Z",
    }
    with pytest.raises(ValueError, match="not found; available"):
        I.ingest(warehouse, path, "logs", fmt="logfmt", timestamp_field="nope")
    with pytest.raises(ValueError, match="do not share one format"):
        I.ingest(warehouse, [path, put("p.ndjson", PEOPLE)], "logs")
    grok = put("g.log", "10.0.0.1 bob\nother\n")
    result = I.ingest(warehouse, grok, "grok", pattern="%{IP:ip} %{USER:user}")
    assert result.success == 2
    assert {row.get("raw_message") for row in dicts(I.read_target(warehouse, "grok"))} == {None, "other"}


def test_file_results_and_totals(spark):
    rows = [("j", "a", "ok"), ("j", "a", "dead"), ("j", "b", "ok"), ("k", "c", "ok")]
    outcomes = spark.createDataFrame(rows, f"job string, {I.SOURCE} string, outcome string")
    per_file = I.file_results(outcomes, ["job"])
    assert {row[I.SOURCE]: (row["processed"], row["success"], row["failed"]) for row in per_file.collect()} == {
        "a": (2, 1, 1), "b": (1, 1, 0), "c": (1, 1, 0),
    }
    totals = {row["job"]: row["processed"] for row in I.job_totals(per_file, ["job"]).collect()}
    assert totals == {"j": 3, "k": 1}


# ---------------------------------------------------------------- preview


def test_preview_of_one_file(spark, put):
    path = put("large.json", json.dumps([{"id": i, "seen": "2024-01-01"} for i in range(200)]))
    seen = preview_files(spark, path)
    assert (seen.fmt, seen.fields) == ("json_array", [("id", "integer"), ("seen", "string")])
    assert seen.records.count() == 100 and seen.timestamp_fields() == ["seen"]
    assert preview_files(spark, path, limit=50).records.count() == 50


def test_preview_of_several_files(spark, put):
    paths = [put(f"f{i}.log", "\n".join(f"a={i} b={j} c{i}=x" for j in range(9))) for i in range(3)]
    seen = preview_files(spark, paths)
    assert seen.fmt == "logfmt" and seen.records.count() == 15
    assert sorted(name for name, _ in seen.fields) == ["a", "b", "c0", "c1", "c2"]
    assert [row["value"] for row in seen.raw_lines.collect()][0] == "a=0 b=0 c0=x"
    assert preview_files(spark, paths, limit=10).records.count() == 10
    with pytest.raises(ValueError, match="do not share"):
        preview_files(spark, [*paths, put("x.json", "[1]")])


def test_preview_again_under_another_reading(spark, put):
    path = put("app.log", "2024 one\n  a\n  b\n2025 two k=v\n")
    assert preview_files(spark, path).fmt == "csv"
    again = preview_files(spark, path, fmt="raw", multiline_start=r"\d{4}", multiline_max_lines=5)
    assert sorted(row["raw_message"] for row in again.records.collect()) == ["2024 one\n  a\n  b", "2025 two k=v"]
    pairs = preview_files(spark, path, fmt="logfmt", multiline_start=r"\d{4}")
    assert dict(pairs.fields) == {"raw_message": "string", "k": "string"}
    grok = preview_files(spark, path, pattern=compile_pattern("%{YEAR:year} %{WORD:word}"))
    assert grok.fields == [("year", "integer"), ("word", "string"), ("raw_message", "string")]
    assert describe(grok)["records"] == 4


# ---------------------------------------------------------------- control tables and retention


# ---------------------------------------------------------------- delivery to an outside sink


class FolderSink:
    """Keeps one file per record id; busy on the first tries of a batch, refuses odd ages."""

    def __init__(self, folder, busy=1):
        self.folder, self.busy = folder, busy

    def send(self, batch):
        tries = os.path.join(self.folder, "tries-" + batch[0][0].replace("/", "-"))
        with open(tries, "a") as seen:
            seen.write("x")
        if os.path.getsize(tries) <= self.busy:
            raise D.RetryableError("busy")
        errors = []
        for key, text in batch:
            refused = json.loads(text)["age"] % 2 == 1
            errors.append("odd age" if refused else None)
            if not refused:
                with open(os.path.join(self.folder, "record-" + key.replace("/", "-")), "w") as out:
                    out.write(text)
        return errors


def test_delivery_retries_and_repeats_harmlessly(warehouse, put, tmp_path):
    people = "".join(json.dumps({"name": f"n{at % 7}", "age": at}) + "\n" for at in range(250)) + "bad\n"
    run = I.ingest(warehouse, put("people.ndjson", people), "people", fmt="ndjson")
    folder = str(tmp_path / "sink")
    os.mkdir(folder)
    for _ in range(2):
        sent = D.deliver(warehouse, "people", run.run_id, lambda: FolderSink(folder), batch_records=40, first_pause=0.01)
        assert sent == D.Delivery(run.run_id, 125, 125)
    kept = [json.load(open(os.path.join(folder, name))) for name in os.listdir(folder) if name.startswith("record-")]
    assert sorted(row["age"] for row in kept) == list(range(0, 250, 2))
    refused = D.read_refused(warehouse, "people", run.run_id).collect()
    assert sorted(json.loads(row["record"])["age"] for row in refused) == list(range(1, 250, 2))
    assert {row["error"] for row in refused} == {"odd age"} and len({row["id"] for row in refused}) == 125
    # a sink that stays busy fails the job
    other = str(tmp_path / "busy")
    os.mkdir(other)
    with pytest.raises(Exception, match="busy"):
        D.deliver(warehouse, "people", run.run_id, lambda: FolderSink(other, busy=99), first_pause=0.01)


def test_batches_are_bounded():
    rows = [("a", "x" * 10), ("b", "é" * 10), ("c", "y"), ("d", "z" * 500), ("e", ""), ("f", "")]
    assert [[key for key, _ in batch] for batch in D.batches(iter(rows), 2, 30)] == [["a", "b"], ["c"], ["d"], ["e", "f"]]
    assert list(D.batches(iter([]))) == []
    pauses, tries = [], []

    class Busy:
        def send(self, batch):
            tries.append(batch)
            if len(tries) < 3:
                raise D.RetryableError("busy")
            return [None] * len(batch)

    assert D.send_with_retries(Busy(), rows, 3, 1.0, pauses.append) == [None] * 6
    assert pauses == [1.0, 2.0]


# ---------------------------------------------------------------- control tables


def test_long_logs_are_merged(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "w"), merge_files=8, merge_files_at_most=16)
    for at in range(60):
        warehouse.audit("logout", f"u{at}")
        assert warehouse.audit_log().count() == at + 1
        assert len(warehouse._log_files("audit_log")) <= 2 * 16
    assert sorted(row["actor_id"] for row in warehouse.audit_log().collect()) == sorted(f"u{at}" for at in range(60))
    merges = tmp_path / "w" / "_control" / "audit_log_merged"
    assert 1 <= len(list(merges.iterdir())) <= 2


def test_a_merge_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    warehouse = Warehouse(spark, str(tmp_path / "w"), merge_files=1000)
    for at in range(5):
        warehouse.track(f"t{at}")
    reading = warehouse.tracked_targets()
    monkeypatch.setattr(Warehouse, "_write_text", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        warehouse.merge_log("tracked_targets")
    monkeypatch.undo()
    assert warehouse.tracked_targets().count() == 5
    assert warehouse.merge_log("tracked_targets")
    warehouse.untrack("t1")
    assert warehouse.tracked_targets().count() == 4 and reading.count() == 5
    # another writer holds the lock
    assert warehouse._take_lock(warehouse._control("tracked_targets_merging"))
    assert not warehouse.merge_log("tracked_targets")
    assert warehouse.tracked_targets().count() == 4


def test_live_progress_of_a_running_ingest(spark, warehouse):
    """Partly done while some tasks still run; the figures come from another thread."""
    gate = tempfile.mktemp()

    def wait(parts):
        for part in parts:
            if part["id"].iloc[0] >= 50:
                while not os.path.exists(gate):
                    time.sleep(0.05)
            yield part

    records = spark.range(0, 100, 1, 10).mapInPandas(wait, "id bigint")
    result = []
    job = threading.Thread(target=lambda: result.append(I.ingest_records(warehouse, records, "slow", run_id="r-live")))
    job.start()
    try:
        for _ in range(200):
            row = live_progress(warehouse, "r-live", total_records=100).first()
            if 0 < row["processed"]:
                break
            time.sleep(0.1)
        assert row["unit"] == "records" and 0 < row["processed"] < row["total"] == 100
        assert row["elapsed_seconds"] > 0 and row["records_per_second"] > 0 and row["estimated_remaining_seconds"] > 0
        tasks = live_progress(warehouse, "r-live").first()
        assert tasks["unit"] == "tasks" and 0 < tasks["processed"] < tasks["total"]
    finally:
        open(gate, "w").close()
        job.join()
    assert result[0].processed == 100
    assert live_progress(warehouse, "unknown").first()["total"] == 0


def test_pending_runs_can_be_discarded(warehouse):
    for run, status in (("a", PENDING), ("b", COMPLETED)):
        warehouse.record_run({"id": run, "status": status, "step": 0})
    assert warehouse.discard_pending("a") and not warehouse.discard_pending("b")
    assert [row["id"] for row in warehouse.manifest().collect()] == ["b"]


def test_deleting_a_target(warehouse, put):
    I.ingest(warehouse, put("a.ndjson", PEOPLE), "t")
    assert warehouse.drop_target("logs-t", "u9", "admin")
    assert not warehouse.drop_target("logs-t")
    assert not warehouse.is_tracked("logs-t") and warehouse.manifest().first()["target_deleted"]
    assert warehouse.audit_log().filter("event_type = 'index_deleted'").first()["actor_id"] == "u9"


def moment(day, hour=0):
    return dt.datetime(2024, 1, day, hour, tzinfo=dt.timezone.utc)


def test_retention_plan(spark):
    targets = spark.createDataFrame(
        [("logs-old", moment(1)), ("logs-edge", moment(10)), ("logs-new", moment(11)), ("logs-foreign", moment(1)),
         ("other", moment(1))],
        "target string, created_at timestamp",
    )
    tracked = spark.createDataFrame([("logs-old",), ("logs-edge",), ("logs-new",)], "target string")

    def plan(**options):
        rows = K.retention_plan(targets, tracked, moment(20), prefix="logs-", **options).collect()
        return {row["target"]: row["action"] for row in rows}

    assert plan(days=10) == {"logs-old": "delete", "logs-edge": "keep", "logs-new": "keep", "logs-foreign": "skip"}
    assert plan(days=10, strict=False)["logs-foreign"] == "delete"
    assert set(plan(days=0).values()) == {"keep"}


def test_retention_job(spark, warehouse, put):
    I.ingest(warehouse, put("a.ndjson", PEOPLE), "mine")
    spark.range(1).write.parquet(warehouse.target_path("logs-foreign"))
    assert K.apply_retention(warehouse, 0)["checked"] == 0
    later = utc_now() + dt.timedelta(days=5)
    assert K.apply_retention(warehouse, 10, later)["deleted"] == []
    result = K.apply_retention(warehouse, 3, later)
    assert (result["checked"], result["deleted"], result["skipped"], result["errors"]) == (2, ["logs-mine"], ["logs-foreign"], [])
    assert warehouse.manifest().first()["target_deleted"] and not warehouse.is_tracked("logs-mine")


def test_time_to_live_purges(spark, warehouse, put, tmp_path):
    path = str(tmp_path / "sessions")
    rows = [(i, moment(1 + i % 4, 12) + dt.timedelta(minutes=i)) for i in range(40)]
    table = spark.createDataFrame(rows, "id int, expires_at timestamp")
    K.write_expiring(table, path, "expires_at")
    now = moment(3, 12) + dt.timedelta(minutes=20)
    kept = {id_ for id_, expires in rows if expires >= now}
    assert K.purge_expired(warehouse, path, "expires_at", now) == 40 - len(kept)
    assert {row["id"] for row in spark.read.parquet(path).collect()} == kept
    assert K.purge_expired(warehouse, path, "expires_at", now) == 0
    # a purge that broke off between its two renames has left the day's rows aside
    warehouse.move(f"{path}/expires_on={now.date()}", f"{path}/_aside-{now.date()}")
    assert K.purge_expired(warehouse, path, "expires_at", now) == 0
    assert {row["id"] for row in spark.read.parquet(path).collect()} == kept
    result = I.ingest(warehouse, put("bad.ndjson", PEOPLE + "{x\n"), "t")
    assert K.purge_dead_letters(warehouse, 0) == []
    assert K.purge_dead_letters(warehouse, 24, utc_now() + dt.timedelta(hours=25)) == [result.run_id]
    assert I.read_dead_letters(warehouse, "t").count() == 0 and I.read_target(warehouse, "t").count() == 3


# ---------------------------------------------------------------- reports


@pytest.fixture
def runs(spark):
    rows = [(str(i), f"u{i % 3}", "pending" if i == 0 else "completed", f"logs-{i % 2}", moment(1 + i // 2)) for i in range(6)]
    return spark.createDataFrame(rows, "id string, user_id string, status string, target string, created_at timestamp")


def test_history(spark, runs):
    users = spark.createDataFrame([("u0", "Ann", "a@x"), ("u1", "Ben", "b@x")], "id string, name string, email string")
    rows = R.upload_history(runs, users, limit=4, offset=1).collect()
    assert [(row["id"], row["user_name"]) for row in rows] == [("4", "Ben"), ("3", "Ann"), ("2", None), ("1", "Ben")]
    assert [row["id"] for row in R.upload_history(runs, users, status="pending").collect()] == ["0"]
    with pytest.raises(ValueError):
        R.upload_history(runs, users, limit=101)
    existing = spark.createDataFrame([("logs-1",)], "target string")
    flags = {row["target"]: row["target_exists"] for row in R.with_target_exists(runs, existing).collect()}
    assert flags == {"logs-0": False, "logs-1": True}
    assert R.with_target_exists(runs, None).first()["target_exists"] is None


def test_audit_reports(spark):
    rows = [(i, ["login", "logout", None, ""][i % 4], f"a{i % 2}", "user", moment(1 + i)) for i in range(8)]
    log = spark.createDataFrame(rows, "id int, event_type string, actor_id string, target_type string, created_at timestamp")
    assert [row["event_type"] for row in R.event_types(log).collect()] == ["login", "logout"]
    assert [row["id"] for row in R.audit_page(log, 1, 2, event_type="login", actor_id="a0").collect()] == [4, 0]
    assert [row["id"] for row in R.audit_page(log, 2, 3).collect()] == [4, 3, 2]
    assert tuple(R.page_counts(log, 3).first()) == (8, 3)
    assert tuple(R.page_counts(log, 3, actor_id="none").first()) == (0, 1)
    assert {row["actor_id"]: row["last_at"].day for row in R.last_activity(log, "login").collect()} == {"a0": 5}


def test_member_reports(spark):
    rows = [("a", True, None, moment(1)), ("b", True, moment(2), moment(2)), ("c", False, None, moment(3))]
    users = spark.createDataFrame(rows, "id string, is_admin boolean, deleted_at timestamp, created_at timestamp")
    assert tuple(R.member_counts(users).first()) == (3, 2, 1)
    assert [row["id"] for row in R.active_members(users).collect()] == ["c", "b", "a"]
    assert [row["id"] for row in R.active_members(users, include_deleted=False).collect()] == ["c", "a"]


def test_key_expiry_order(spark):
    offsets = {"gone": -30, "now": 0, "today": 5, "tomorrow": 24, "week": 24 * 7, "later": 24 * 8, "later2": 24 * 9}
    rows = [(name, moment(10) + dt.timedelta(hours=h), moment(1 + i)) for i, (name, h) in enumerate(offsets.items())]
    keys = spark.createDataFrame(rows, "id string, expires_at timestamp, created_at timestamp")
    report = R.by_urgency(R.key_expiry(keys, F.lit(moment(10)))).collect()
    assert [row["id"] for row in report] == ["gone", "now", "tomorrow", "today", "week", "later2", "later"]
    warnings = {row["id"]: row["warning"] for row in report}
    assert warnings["now"] == "Expired" and warnings["today"] == "Expires today" and warnings["tomorrow"] == "Expires today"
    assert warnings["week"] == "Expires in 7 days" and warnings["later"] is None


def test_progress_rates(spark, warehouse, put):
    frame = spark.createDataFrame([(50, 200, 10.0), (0, 200, 5.0), (5, 5, 0.0)], "processed int, total int, elapsed_seconds double")
    rows = with_rates(frame).collect()
    assert [(row["records_per_second"], row["estimated_remaining_seconds"]) for row in rows] == [(5.0, 30.0), (0.0, 0.0), (0.0, 0.0)]
    I.ingest(warehouse, put("a.ndjson", PEOPLE), "t")
    row = run_progress(warehouse.manifest(), F.current_timestamp()).first()
    assert row["processed"] == 3 and row["records_per_second"] > 0 and row["estimated_remaining_seconds"] == 0


# ---------------------------------------------------------------- streaming


def test_continuous_ingest(spark, warehouse, put, tmp_path):
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")
    plan = I.FieldPlan(timestamp_field="ts", filename_field="source_file")

    def run():
        query = start_ingest(
            warehouse, landing, "stream", checkpoint, "feed", fmt="logfmt", mapping=plan, multiline_start="ts="
        )
        query.awaitTermination(120)
        assert query.exception() is None
        return query

    put("landing/a.log", "ts=1700000000 m=1\n  cont n=2\nts=1700000001 m=2\n")
    run()
    put("landing/b.log", "ts=1700000002 m=3\n")
    query = run()
    run()
    rows = dicts(I.read_target(warehouse, "stream"))
    assert sorted((row["m"], row.get("n"), row["source_file"]) for row in rows) == [
        ("1", "2", "a.log"), ("2", None, "a.log"), ("3", None, "b.log"),
    ]
    assert [row["id"] for row in warehouse.manifest().orderBy("id").collect()] == ["feed-0", "feed-1"]
    assert progress_table(spark, query).first()["query"] == "feed"


def test_stream_guards_equal_the_replays(spark, tmp_path):
    """Many files and triggers, a third of all rows on one key, and rows that come too late."""
    user = F.when(F.col("event_id") % 3 == 0, F.lit(999)).otherwise(F.col("user_id"))
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        "event_id", user.alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed")
    )
    last = spark.createDataFrame([(-1, -1, moment(28) + dt.timedelta(days=90), True)], events.schema)
    late = spark.createDataFrame([(-2 - at, 999, moment(2), True) for at in range(7)], events.schema)
    folder = str(tmp_path / "events")
    for part in range(4):
        first, until = moment(1 + part * 8), moment(9 + part * 8) if part < 3 else moment(28) + dt.timedelta(days=9)
        chunk = events.filter((F.col("ts") >= F.lit(first)) & (F.col("ts") < F.lit(until)))
        chunk = chunk.unionByName(late) if part == 3 else chunk
        chunk.coalesce(1).write.mode("append").parquet(folder)
    last.coalesce(1).write.mode("append").parquet(folder)

    def decided(build, name):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
        query.processAllAvailable()
        assert late_events(query) == 7
        query.stop()
        return spark.table(name).filter("event_id >= 0")

    day = 86400
    batch = replay_admission(events, "user_id", "ts", "event_id", 2, day)
    live = decided(lambda s: stream_admission(s, "user_id", "ts", "event_id", 2, day, "1 hour"), "admitted")
    assert live.count() == 1000 and live.exceptAll(batch).count() == 0
    batch = replay_lockout(events, "user_id", "ts", "event_id", F.col("failed"), 2, 2 * 1440)
    live = decided(
        lambda s: stream_lockout(s, "user_id", "ts", "event_id", F.col("failed"), 2, 2 * 1440, "1 hour"), "locked"
    )
    assert live.count() == 1000 and live.exceptAll(batch).count() == 0


class CountedState:
    """The states of one bucket in memory, with the number of calls to them."""

    def __init__(self, handle=None):
        self.calls, self.value, self.map, self.timers, self.handle = 0, None, {}, set(), handle or self

    def getValueState(self, *_):
        return CountedState(self)

    getMapState = getListState = getValueState

    def _counted(self, result=None):
        self.handle.calls += 1
        return result

    def get(self):
        return self._counted(self.value)

    def update(self, value):
        self._counted()
        self.value = value

    def keys(self):
        return self._counted(iter([*self.map]))

    def iterator(self):
        return self._counted(iter([*self.map.items()]))

    def getValue(self, key):
        return self._counted(self.map[key])

    def updateValue(self, key, value):
        self._counted()
        self.map[key] = value

    def removeKey(self, key):
        self._counted()
        del self.map[key]

    def clear(self):
        self._counted()
        self.map, self.value = {}, None

    def listTimers(self):
        return self._counted(iter([*self.timers]))

    def registerTimer(self, at):
        self._counted()
        self.timers.add(at)

    def deleteTimer(self, at):
        self._counted()
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_stream_guard_calls_the_state_by_bucket():
    """Many keys and many slots of a trigger cost a few calls; partly passed entries lose nothing."""
    state, choice = CountedState(), random.Random(3)
    guard = GuardProcessor("admission", 2, 60_000_000)
    guard.init(state)
    keys = [None, *(f"k{at}" for at in range(99))]
    events = [(choice.choice(keys), choice.randrange(3600) * 1_000_000, at) for at in range(20_000)]
    got, last = [], 0
    for until in (1800, 2400, 2407, 2408, 3600):
        batch = pd.DataFrame([event for event in events if last <= event[1] // 1_000_000 < until], columns=["key", "at", "id"])
        before = state.calls
        list(guard.handleInputRows((1,), iter([batch.assign(failed=False)]), state))
        last, state.watermark = until, until * 1000
        expired = [at for at in state.timers if at <= state.watermark]
        for at in expired:
            got += [row for part in guard.handleExpiredTimer((1,), state, None) for row in part.itertuples(index=False)]
            state.timers.discard(at)
        assert state.calls - before < 40 and len(state.timers) == 1
    state.watermark = 10**7
    got += [row for part in guard.handleExpiredTimer((1,), state, None) for row in part.itertuples(index=False)]
    rules, want = {}, []
    for key, at, id_ in sorted(events, key=lambda event: event[1:]):
        rule = rules.setdefault(key, RULES["admission"](2, 60_000_000))
        want.append((key, at, id_, *rule.decide(at, False)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and not guard.held.map


def test_progress_feed_keeps_every_row(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(40).repartition(4).write.parquet(folder)
    feed = ProgressFeed(spark, str(tmp_path / "progress"), flush_rows=2)
    spark.streams.addListener(feed)
    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(folder)
    query = stream.writeStream.queryName("fed").format("noop").option("checkpointLocation", str(tmp_path / "state"))
    query.trigger(availableNow=True).start().awaitTermination()
    # events arrive on a thread of their own
    for _ in range(60):
        rows = feed.table().filter("input_rows > 0").collect()
        if sum(row["input_rows"] for row in rows) == 40:
            break
        time.sleep(0.5)
    spark.streams.removeListener(feed)
    assert sum(row["input_rows"] for row in rows) == 40 and {row["query"] for row in rows} == {"fed"} and len(rows) >= 4


def test_progress_feed_writes_one_at_a_time(spark, tmp_path):
    feed = ProgressFeed(spark, str(tmp_path / "progress"))
    running, most, written = [], [], []

    def write(rows):
        running.append(rows)
        most.append(len(running))
        time.sleep(0.2)
        written.extend(rows)
        running.remove(rows)

    def add(at):
        with feed._lock:
            feed._rows.append(at)
        feed.flush()

    feed._write = write
    threads = [threading.Thread(target=add, args=(at,)) for at in range(4)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert max(most) == 1 and sorted(written) == [0, 1, 2, 3]
