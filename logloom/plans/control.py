"""Control tables: ingest manifest, audit log and tracked targets.

All three are append-only logs on shared storage.  A state change appends a row and readers
take the latest one, so nothing is ever rewritten in place and a lost executor cannot leave
a half-updated table.

Every append leaves a file.  When there are many, they are merged: a folder with all rows so far
gets, as its last file, the list of the log files it covers.  Readers take the newest folder that
has its list, and the files the list does not name.  A writer that dies before the list is
complete leaves a folder nobody reads.  Covered files and older folders are only deleted by the
next merge, so a read under way keeps its files.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = """
    id string, filenames array<string>, file_size bigint, file_format string, target string,
    timestamp_field string, field_mappings map<string,string>, excluded_fields array<string>,
    status string, total_records bigint, success_count bigint, failure_count bigint,
    started_at timestamp, completed_at timestamp, created_at timestamp, error_message string,
    user_id string, target_deleted boolean, upload_method string, api_key_name string,
    pattern_id string, multiline_start string, multiline_max_lines int,
    target_schema string, recorded_at timestamp, step int
"""
AUDIT_SCHEMA = """
    id string, event_type string, actor_id string, actor_name string, target_type string,
    target_id string, details string, ip_address string, created_at timestamp
"""
TRACKED_SCHEMA = "target string, created_by string, action string, recorded_at timestamp"
CONTROL_SCHEMAS = {"ingest_manifest": MANIFEST_SCHEMA, "audit_log": AUDIT_SCHEMA, "tracked_targets": TRACKED_SCHEMA}

# A merged folder's list of the log files it covers, and the line that says the list is whole.
_COVERED, _END = "_covered", "end"
_MERGED_FILE_BYTES = 128 * 1024 * 1024
_LOCK_SECONDS = 3600

# Life cycle of an ingest run.
PENDING, IN_PROGRESS, COMPLETED = "pending", "in_progress", "completed"
WITH_ERRORS, FAILED, CANCELLED = "completed_with_errors", "failed", "cancelled"
DISCARDED = "discarded"
COMMITTED = (COMPLETED, WITH_ERRORS)

# Audit event vocabulary.
AUDIT_EVENTS = (
    "login_success",
    "login_failed",
    "logout",
    "user_created",
    "user_modified",
    "user_deleted",
    "api_key_created",
    "api_key_deleted",
    "index_created",
    "index_deleted",
    "ingestion_started",
    "ingestion_completed",
)


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


@dataclass(frozen=True)
class Warehouse:
    """Where targets and control tables live, and how target names are formed."""

    spark: SparkSession
    root: str
    prefix: str = "logs-"
    strict: bool = True
    # log files that may gather before they are merged, and the most of them when the merged part is large
    merge_files: int = 64
    merge_files_at_most: int = 512
    # runs whose cancellation has been asked for, by run id
    cancel_requests: set[str] = field(default_factory=set, compare=False, repr=False)

    # ------------------------------------------------------------ paths

    def full_name(self, target: str) -> str:
        return target if target.startswith(self.prefix) else self.prefix + target

    def target_path(self, full_name: str) -> str:
        return f"{self.root.rstrip('/')}/{full_name}"

    def run_path(self, full_name: str, run_id: str) -> str:
        return f"{self.target_path(full_name)}/run_id={run_id}"

    def _control(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/_control/{table}"

    def _file_system(self, path: str):
        jvm = self.spark.sparkContext._jvm
        location = jvm.org.apache.hadoop.fs.Path(path)
        return location.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), location

    def exists(self, path: str) -> bool:
        system, location = self._file_system(path)
        return bool(system.exists(location))

    def delete(self, path: str) -> bool:
        system, location = self._file_system(path)
        return bool(system.exists(location) and system.delete(location, True))

    def move(self, path: str, to: str) -> None:
        system, location = self._file_system(path)
        if not system.rename(location, self._file_system(to)[1]):
            raise OSError(f"could not move {path} to {to}")

    def existing_targets(self) -> DataFrame:
        """(target, created_at) of the target folders under the prefix."""
        system, location = self._file_system(self.root)
        found = system.listStatus(location) if system.exists(location) else []
        rows = [
            (status.getPath().getName(), dt.datetime.fromtimestamp(status.getModificationTime() / 1000, dt.timezone.utc))
            for status in found
            if status.isDirectory() and status.getPath().getName().startswith(self.prefix)
        ]
        folders = self.spark.createDataFrame(rows, "target string, changed_at timestamp")
        tracked = self.tracked_targets().select("target", F.col("created_at").alias("tracked_at"))
        return folders.join(tracked, "target", "left").select(
            "target", F.coalesce("tracked_at", "changed_at").alias("created_at")
        )

    # ------------------------------------------------------------ logs

    def _merged(self, table: str) -> tuple[str | None, set[str]]:
        """The newest complete merge of a log, and the names of the log files it covers."""
        system, folder = self._file_system(self._control(f"{table}_merged"))
        if not system.exists(folder):
            return None, set()
        names = sorted((status.getPath().getName() for status in system.listStatus(folder)), reverse=True)
        for name in names:
            path = f"{self._control(f'{table}_merged')}/{name}"
            covered = self._read_text(f"{path}/{_COVERED}")
            if covered.endswith(_END):
                return path, set(covered.splitlines()[:-1])
        return None, set()

    def _log_files(self, table: str) -> dict[str, int]:
        """Sizes of a log's files by name."""
        system, folder = self._file_system(self._control(table))
        if not system.exists(folder):
            return {}
        found = {status.getPath().getName(): status.getLen() for status in system.listStatus(folder)}
        return {name: size for name, size in found.items() if name[0] not in "._"}

    def _read_text(self, path: str) -> str:
        system, location = self._file_system(path)
        if not system.exists(location):
            return ""
        stream = system.open(location)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_text(self, path: str, text: str) -> None:
        system, location = self._file_system(path)
        stream = system.create(location, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _read(self, table: str, schema: str) -> DataFrame:
        merged, covered = self._merged(table)
        paths = [f"{self._control(table)}/{name}" for name in self._log_files(table) if name not in covered]
        paths += [merged] if merged else []
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)

    def _append(self, table: str, rows: DataFrame, few: bool = False) -> None:
        """Append rows; ``few`` of them, built on the driver, go to one file."""
        (rows.coalesce(1) if few else rows).write.mode("append").parquet(self._control(table))
        self._merge_long_log(table)

    def _merge_long_log(self, table: str) -> None:
        """Merge a log once its files are many, and large enough against the part already merged.

        The second condition lets the merged part grow by a quarter each time, so rows are written
        again a logarithmic number of times; ``merge_files_at_most`` bounds the files all the same.
        """
        files = self._log_files(table)
        if len(files) < self.merge_files:
            return
        merged, covered = self._merged(table)
        fresh = {name: size for name, size in files.items() if name not in covered}
        if len(fresh) < self.merge_files:
            return
        if merged and len(fresh) < self.merge_files_at_most:
            system, location = self._file_system(merged)
            if 4 * sum(fresh.values()) < system.getContentSummary(location).getLength():
                return
        self.merge_log(table)

    def merge_log(self, table: str) -> bool:
        """Merge all rows of a log into one folder; False when another writer is doing so."""
        lock = self._control(f"{table}_merging")
        if not self._take_lock(lock):
            return False
        try:
            merged, covered = self._merged(table)
            files = self._log_files(table)
            covered &= files.keys()
            names = [name for name in files if name not in covered]
            paths = [f"{self._control(table)}/{name}" for name in names] + ([merged] if merged else [])
            number = int(merged.rsplit("/", 1)[-1].split("-")[0]) + 1 if merged else 1
            folder = f"{self._control(f'{table}_merged')}/{number:09d}-{uuid.uuid4().hex}"
            schema = CONTROL_SCHEMAS[table]
            rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)
            size = sum(self._size(path) for path in paths)
            rows.coalesce(1 + size // _MERGED_FILE_BYTES).write.parquet(folder)
            # what the previous merge covers is in this one too, and stays named as it may not be deleted yet
            self._write_text(f"{folder}/{_COVERED}", "\n".join([*sorted(covered), *names, _END]))
            for name in covered:
                self.delete(f"{self._control(table)}/{name}")
            self._drop_old_merges(table, keep={path.rsplit("/", 1)[-1] for path in (folder, merged) if path})
        finally:
            self.delete(lock)
        return True

    def _size(self, path: str) -> int:
        system, location = self._file_system(path)
        return system.getContentSummary(location).getLength()

    def _drop_old_merges(self, table: str, keep: set[str]) -> None:
        system, folder = self._file_system(self._control(f"{table}_merged"))
        for status in system.listStatus(folder):
            if status.getPath().getName() not in keep:
                system.delete(status.getPath(), True)

    def _take_lock(self, path: str) -> bool:
        """Create a file that only one writer can create; one left by a dead writer is taken over."""
        system, location = self._file_system(path)
        if system.exists(location):
            age = dt.datetime.now().timestamp() - system.getFileStatus(location).getModificationTime() / 1000
            if age < _LOCK_SECONDS or not system.delete(location, False):
                return False
        return bool(system.createNewFile(location))

    def manifest_log(self) -> DataFrame:
        return self._read("ingest_manifest", MANIFEST_SCHEMA)

    def manifest(self) -> DataFrame:
        """Latest state of every run."""
        return latest_states(self.manifest_log(), "id", "step", "recorded_at").filter(F.col("status") != DISCARDED)

    def record_run(self, state: Mapping[str, object]) -> None:
        schema = self.spark.createDataFrame([], MANIFEST_SCHEMA).schema
        row = {**{field.name: None for field in schema.fields}, **state, "recorded_at": utc_now()}
        values = tuple(row[f.name] for f in schema.fields)
        self._append("ingest_manifest", self.spark.createDataFrame([values], schema), few=True)

    def discard_pending(self, run_id: str) -> bool:
        """Remove a run that never started; others are left alone."""
        return self._restate(
            self.manifest().filter((F.col("id") == run_id) & (F.col("status") == PENDING)), status=F.lit(DISCARDED)
        )

    def mark_deleted(self, full_name: str) -> bool:
        """Flag every run that wrote to a target."""
        return self._restate(self.manifest().filter(F.col("target") == full_name), target_deleted=F.lit(True))

    def _restate(self, rows: DataFrame, **changes: Column) -> bool:
        if rows.isEmpty():
            return False
        for name, value in {**changes, "recorded_at": F.lit(utc_now()), "step": F.col("step") + 1}.items():
            rows = rows.withColumn(name, value)
        self._append("ingest_manifest", rows)
        return True

    # ------------------------------------------------------------ tracking

    def tracked_targets(self) -> DataFrame:
        latest = latest_states(self._read("tracked_targets", TRACKED_SCHEMA), "target", "recorded_at")
        return latest.filter("action = 'track'").select("target", "created_by", F.col("recorded_at").alias("created_at"))

    def is_tracked(self, full_name: str) -> bool:
        return not self.tracked_targets().filter(F.col("target") == full_name).isEmpty()

    def track(self, full_name: str, user: str | None = None) -> None:
        """Remember that this library made the target; a second call changes nothing."""
        if not self.is_tracked(full_name):
            self._log_tracking(full_name, user, "track")

    def untrack(self, full_name: str) -> None:
        if self.is_tracked(full_name):
            self._log_tracking(full_name, None, "untrack")

    def _log_tracking(self, full_name: str, user: str | None, action: str) -> None:
        row = self.spark.createDataFrame([(full_name, user, action, utc_now())], TRACKED_SCHEMA)
        self._append("tracked_targets", row, few=True)

    # ------------------------------------------------------------ audit

    def audit_log(self) -> DataFrame:
        return self._read("audit_log", AUDIT_SCHEMA)

    def audit(
        self,
        event_type: str,
        actor_id: str | None = None,
        actor_name: str | None = None,
        target_type: str | None = None,
        target_id: str | None = None,
        details: Mapping[str, object] | None = None,
        ip_address: str | None = None,
    ) -> None:
        text = json.dumps(details) if details else None
        row = (uuid.uuid4().hex, event_type, actor_id, actor_name, target_type, target_id, text, ip_address, utc_now())
        self._append("audit_log", self.spark.createDataFrame([row], AUDIT_SCHEMA), few=True)

    def append_audit(self, events: DataFrame) -> None:
        self._append("audit_log", events)

    # ------------------------------------------------------------ deletion

    def drop_target(self, full_name: str, actor: str | None = None, actor_name: str | None = None) -> bool:
        """Delete a target's data, forget it, flag its runs and leave an audit row."""
        if not self.delete(self.target_path(full_name)):
            return False
        self.untrack(full_name)
        self.mark_deleted(full_name)
        self.audit("index_deleted", actor, actor_name, target_type="index", target_id=full_name)
        return True


def latest_states(log: DataFrame, key: str, *order: str) -> DataFrame:
    """Last row per key of an append-only log; combined before the shuffle."""
    row = F.max_by(F.struct(*log.columns), F.struct(*order)).alias("row")
    return log.groupBy(F.col(key).alias("_key")).agg(row).select("row.*")


def audit_events(
    source: DataFrame,
    event_type: str | Column,
    created_at: Column,
    id_: Column,
    actor_id: Column | None = None,
    actor_name: Column | None = None,
    target_type: str | None = None,
    target_id: Column | None = None,
    details: Iterable[Column] = (),
    ip_address: Column | None = None,
) -> DataFrame:
    """Audit rows from any table, details as JSON text; many of them can be united and appended."""
    none = F.lit(None).cast("string")
    details = list(details)
    return source.select(
        id_.cast("string").alias("id"),
        (F.lit(event_type) if isinstance(event_type, str) else event_type).alias("event_type"),
        (none if actor_id is None else actor_id.cast("string")).alias("actor_id"),
        (none if actor_name is None else actor_name).alias("actor_name"),
        F.lit(target_type).cast("string").alias("target_type"),
        (none if target_id is None else target_id.cast("string")).alias("target_id"),
        (F.to_json(F.struct(*details)) if details else none).alias("details"),
        (none if ip_address is None else ip_address).alias("ip_address"),
        created_at.cast("timestamp").alias("created_at"),
    )
