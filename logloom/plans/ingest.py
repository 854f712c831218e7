"""The ingest job: read, map, validate, write once, record the outcome.

Accepted and rejected records leave in one pass over the input, as two partitions of one
write below a folder of the run.  Readers only see runs the manifest lists as committed, and
its row is appended last, so a failed or cancelled run leaves nothing visible behind.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.regexes import CompiledPattern, compile_pattern
from logloom.functions.timestamps import DEFAULT_LAYOUTS, Layout
from logloom.operators.mapping import DEFAULT_FILENAME_FIELD, map_fields
from logloom.operators.profiling import MAX_FIELDS, detect_formats, format_agreement
from logloom.plans.control import CANCELLED, COMMITTED, COMPLETED, FAILED, IN_PROGRESS, WITH_ERRORS, Warehouse, utc_now
from logloom.session import broadcast_if_small, quoted
from logloom.sources.lines import as_paths, check_suffixes, read_lines
from logloom.sources.records import ERROR, SOURCE, data_columns, read_logs

# Characters a target name may not hold, and its greatest length.
FORBIDDEN_CHARACTERS = ("\\", "/", "*", "?", '"', "<", ">", "|", " ", ",", "#", ":")
MAX_NAME_LENGTH = 255

OUTCOME, OK, DEAD = "outcome", "ok", "dead"
RECORD, ORIGINAL = "_record", "_original"
INTERNAL = (SOURCE, ERROR, RECORD, OUTCOME, "run_id")


class TargetError(ValueError):
    """The target's name or state does not allow the write."""


@dataclass(frozen=True)
class FieldPlan:
    """What to do with the fields of each record."""

    field_mappings: Mapping[str, str] = field(default_factory=dict)
    excluded_fields: Sequence[str] = ()
    timestamp_field: str | None = None
    field_types: Mapping[str, str] = field(default_factory=dict)
    filename_field: str | None = None
    default_year: int | None = None
    layouts: tuple[Layout, ...] = DEFAULT_LAYOUTS


@dataclass(frozen=True)
class IngestResult:
    run_id: str
    target: str
    status: str
    processed: int
    success: int
    failed: int
    elapsed_seconds: float

    @property
    def records_per_second(self) -> float:
        return self.processed / self.elapsed_seconds if self.elapsed_seconds > 0 else 0.0


# ---------------------------------------------------------------- target checks


def check_target_name(name: str, prefix: str = "") -> str | None:
    """Reason why a name is not allowed, None when it is fine."""
    if not name:
        return "target name is empty"
    if name[0] in "-_":
        return "target name starts with '-' or '_'"
    for character in FORBIDDEN_CHARACTERS:
        if character in name:
            return f"target name holds {character!r}"
    if name != name.lower():
        return "target name is not in lower case"
    if len(prefix + name) > MAX_NAME_LENGTH:
        return f"target name is longer than {MAX_NAME_LENGTH} characters"
    return None


def target_name_errors(names: DataFrame, name: str = "name", prefix: str = "") -> DataFrame:
    """The same rule for a table of names; ``error`` is null for good names."""
    text = F.col(name)
    reason = F.when(F.coalesce(text, F.lit("")) == "", "target name is empty").when(
        text.startswith("-") | text.startswith("_"), "target name starts with '-' or '_'"
    )
    for character in FORBIDDEN_CHARACTERS:
        reason = reason.when(text.contains(character), f"target name holds {character!r}")
    reason = reason.when(text != F.lower(text), "target name is not in lower case")
    too_long = F.length(text) + len(prefix) > MAX_NAME_LENGTH
    return names.withColumn("error", reason.when(too_long, f"target name is longer than {MAX_NAME_LENGTH} characters"))


def guard_target(warehouse: Warehouse, full_name: str) -> bool:
    """True when the target has to be tracked after the write; error when it may not be written."""
    if warehouse.is_tracked(full_name):
        return False
    if not warehouse.strict or not warehouse.exists(warehouse.target_path(full_name)):
        return True
    raise TargetError(f"target {full_name} exists but was not made by this library (strict mode)")


# ---------------------------------------------------------------- validation


def _conform(records: DataFrame, names: Sequence[str], known: T.StructType | None) -> tuple[dict[str, Column], list[Column]]:
    """Cast columns to the types the target already has; values that do not fit are errors."""
    columns, errors = {}, []
    types = {f.name: f.dataType for f in known.fields} if known else {}
    for name in names:
        value, given = quoted(name), records.schema[name].dataType
        wanted = types.get(name, given)
        if wanted == given:
            columns[name] = value
            continue
        if isinstance(wanted, T.StringType) and isinstance(given, (T.VariantType, T.StructType, T.ArrayType, T.MapType)):
            cast = F.to_json(value)
        elif isinstance(wanted, T.VariantType):
            cast = F.try_variant_get(F.parse_json(F.to_json(F.struct(value.alias("v")))), "$.v", "variant")
        elif isinstance(given, (T.VariantType, T.StructType, T.ArrayType, T.MapType)):
            cast = F.lit(None).cast(wanted)
        else:
            cast = value.try_cast(wanted)
        columns[name] = cast
        errors.append(
            F.when(value.isNotNull() & cast.isNull(), f"field {name}: value does not fit type {wanted.simpleString()}")
        )
    return columns, errors


def split_outcomes(
    records: DataFrame,
    mapping: FieldPlan = FieldPlan(),
    rules: Mapping[str, Column] | None = None,
    known: T.StructType | None = None,
) -> DataFrame:
    """Mapped records with ``outcome``, ``_error`` and, for rejected ones, the original ``_record``.

    ``rules`` maps an error text to the condition that raises it, over the original columns.
    """
    names = data_columns(records)
    reasons = [F.col(ERROR)] if ERROR in records.columns else []
    reasons += [F.when(condition, F.lit(text)) for text, condition in (rules or {}).items()]
    reason = F.coalesce(*reasons, F.lit(None).cast("string"))
    raw_text = F.col(RECORD) if RECORD in records.columns else F.lit(None).cast("string")
    flagged = records.select(
        *[quoted(name) for name in names],
        *([F.col(SOURCE)] if SOURCE in records.columns else [F.lit(None).cast("string").alias(SOURCE)]),
        reason.alias(ERROR),
        raw_text.alias(RECORD),
        F.struct(*[quoted(name) for name in names]).alias(ORIGINAL),
    )
    mapped = map_fields(
        flagged,
        mapping.field_mappings,
        mapping.excluded_fields,
        mapping.timestamp_field,
        mapping.field_types,
        mapping.filename_field,
        F.col(SOURCE),
        passthrough=(SOURCE, ERROR, RECORD, ORIGINAL),
        layouts=mapping.layouts,
        default_year=mapping.default_year,
    )
    kept = [name for name in mapped.columns if name not in (SOURCE, ERROR, RECORD, ORIGINAL)]
    columns, misfits = _conform(mapped, kept, known)
    error = F.coalesce(F.col(ERROR), *misfits, F.lit(None).cast("string"))
    judged = mapped.select(
        *[value.alias(name) for name, value in columns.items()], SOURCE, error.alias(ERROR), RECORD, ORIGINAL
    )
    # the text of a record is only made for rejected ones
    text = F.when(F.col(ERROR).isNotNull(), F.coalesce(F.col(RECORD), F.to_json(ORIGINAL)))
    return judged.select(
        *[quoted(name) for name in columns],
        SOURCE,
        ERROR,
        text.alias(RECORD),
        F.when(F.col(ERROR).isNull(), OK).otherwise(DEAD).alias(OUTCOME),
    )


def file_results(outcomes: DataFrame, job: Sequence[str] = ()) -> DataFrame:
    """Processed, success and failed per source file (and job)."""
    return outcomes.groupBy(*job, SOURCE).agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col(OUTCOME) == OK).alias("success"),
        F.count_if(F.col(OUTCOME) == DEAD).alias("failed"),
    )


def job_totals(results: DataFrame, job: Sequence[str]) -> DataFrame:
    """Per-file results summed into totals."""
    return results.groupBy(*job).agg(*[F.sum(name).alias(name) for name in ("processed", "success", "failed")])


# ---------------------------------------------------------------- the job


@contextmanager
def _two_open_files_per_task(warehouse: Warehouse):
    """Let a task write both outcomes side by side instead of sorting its rows by outcome."""
    conf, name = warehouse.spark.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name, None)
    conf.set(name, "4")
    try:
        yield
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def known_schema(warehouse: Warehouse, full_name: str) -> T.StructType | None:
    """Columns the target has after its committed runs."""
    runs = warehouse.manifest().filter(
        (F.col("target") == full_name) & F.col("status").isin(*COMMITTED) & ~F.col("target_deleted")
    )
    row = runs.agg(F.max_by("target_schema", "completed_at")).first()
    return T.StructType.fromJson(json.loads(row[0])) if row and row[0] else None


def _merged_schema(known: T.StructType | None, written: T.StructType) -> T.StructType:
    fields = {f.name: f for f in (known.fields if known else [])}
    for f in written.fields:
        if f.name not in INTERNAL:
            fields.setdefault(f.name, T.StructField(f.name, f.dataType))
    return T.StructType(list(fields.values()))


def ingest_records(
    warehouse: Warehouse,
    records: DataFrame,
    target: str,
    mapping: FieldPlan = FieldPlan(),
    rules: Mapping[str, Column] | None = None,
    run_id: str | None = None,
    user: str | None = None,
    details: Mapping[str, object] | None = None,
) -> IngestResult:
    """Write records to a target. A run id that is already committed is not written again."""
    problem = check_target_name(target, warehouse.prefix)
    if problem:
        raise TargetError(problem)
    spark, full_name = warehouse.spark, warehouse.full_name(target)
    run_id = run_id or uuid.uuid4().hex
    done = warehouse.manifest().filter((F.col("id") == run_id) & F.col("status").isin(*COMMITTED)).first()
    if done is not None:
        return IngestResult(
            run_id, full_name, done["status"], done["total_records"], done["success_count"], done["failure_count"], 0.0
        )
    needs_tracking = guard_target(warehouse, full_name)
    _check_timestamp_field(records, mapping)
    began, started_at = time.monotonic(), utc_now()
    state: dict[str, object] = {
        "id": run_id,
        "target": full_name,
        "status": IN_PROGRESS,
        "timestamp_field": mapping.timestamp_field,
        "field_mappings": dict(mapping.field_mappings),
        "excluded_fields": list(mapping.excluded_fields),
        "started_at": started_at,
        "created_at": started_at,
        "user_id": user,
        "target_deleted": False,
        "upload_method": "batch",
        "step": 0,
        **(details or {}),
    }
    warehouse.record_run(state)
    warehouse.audit("ingestion_started", user, target_type="index", target_id=full_name, details={"run_id": run_id})
    spark.addTag(run_id)
    spark.sparkContext.addJobTag(run_id)  # by this one the status tracker finds the jobs
    try:
        known = known_schema(warehouse, full_name)
        outcomes = split_outcomes(records, mapping, rules, known)
        counts = Observation()
        observed = outcomes.observe(
            counts, F.count(F.lit(1)).alias("processed"), F.count_if(F.col(OUTCOME) == DEAD).alias("failed")
        )
        with _two_open_files_per_task(warehouse):
            observed.write.mode("overwrite").partitionBy(OUTCOME).parquet(warehouse.run_path(full_name, run_id))
        processed, failed = counts.get["processed"], counts.get["failed"]
    except Exception as problem:
        cancelled = run_id in warehouse.cancel_requests
        warehouse.record_run(
            {
                **state,
                "status": CANCELLED if cancelled else FAILED,
                "completed_at": utc_now(),
                "error_message": None if cancelled else str(problem),
                "step": 1,
            }
        )
        raise
    finally:
        spark.removeTag(run_id)
        spark.sparkContext.removeJobTag(run_id)
        warehouse.cancel_requests.discard(run_id)
    if needs_tracking:
        warehouse.track(full_name, user)
        warehouse.audit("index_created", user, target_type="index", target_id=full_name)
    status = WITH_ERRORS if failed else COMPLETED
    warehouse.record_run(
        {
            **state,
            "status": status,
            "total_records": processed,
            "success_count": processed - failed,
            "failure_count": failed,
            "completed_at": utc_now(),
            "error_message": f"{failed} records were rejected" if failed else None,
            "target_schema": _merged_schema(known, outcomes.schema).json(),
            "step": 1,
        }
    )
    warehouse.audit(
        "ingestion_completed",
        user,
        target_type="index",
        target_id=full_name,
        details={"run_id": run_id, "success": processed - failed, "failed": failed},
    )
    return IngestResult(run_id, full_name, status, processed, processed - failed, failed, time.monotonic() - began)


def _check_timestamp_field(records: DataFrame, mapping: FieldPlan) -> None:
    if mapping.timestamp_field is None or mapping.timestamp_field == mapping.filename_field:
        return
    available = data_columns(records)
    if mapping.timestamp_field not in available:
        raise ValueError(f"timestamp field {mapping.timestamp_field!r} not found; available: {available[:20]}")


def agreed_format(warehouse: Warehouse, paths: Sequence[str]) -> str:
    """Common format of all files, error when they differ."""
    row = format_agreement(detect_formats(read_lines(warehouse.spark, paths))).first()
    if not row["uniform"]:
        raise ValueError("the files do not share one format")
    return row["format"]


def ingest(
    warehouse: Warehouse,
    paths: str | Sequence[str],
    target: str,
    fmt: str | None = None,
    timestamp_field: str | None = None,
    include_filename: bool = False,
    filename_field: str = DEFAULT_FILENAME_FIELD,
    field_mappings: Mapping[str, str] | None = None,
    excluded_fields: Sequence[str] = (),
    field_types: Mapping[str, str] | None = None,
    pattern: str | CompiledPattern | None = None,
    pattern_kind: str = "grok",
    components: dict[str, str] | None = None,
    multiline_start: str | None = None,
    multiline_max_lines: int = 100,
    rules: Mapping[str, Column] | None = None,
    max_fields: int = MAX_FIELDS,
    run_id: str | None = None,
    user: str | None = None,
    default_year: int | None = None,
    layouts: tuple[Layout, ...] = DEFAULT_LAYOUTS,
) -> IngestResult:
    """Ingest files into a target; the format is detected unless given.

    ``layouts`` are those of the timestamp field, for example what ``column_layouts`` finds in it.
    """
    problem = check_target_name(target, warehouse.prefix)
    if problem:
        raise TargetError(problem)
    guard_target(warehouse, warehouse.full_name(target))
    files = as_paths(paths)
    check_suffixes(files)
    if isinstance(pattern, str):
        pattern = compile_pattern(pattern, pattern_kind, components)
    fmt = fmt or ("custom" if pattern is not None else agreed_format(warehouse, files))
    records = read_logs(
        warehouse.spark,
        files,
        fmt,
        pattern,
        multiline_start=multiline_start,
        multiline_max_lines=multiline_max_lines,
        max_fields=max_fields,
    )
    mapping = FieldPlan(
        field_mappings or {},
        excluded_fields,
        timestamp_field,
        field_types or {},
        filename_field if include_filename else None,
        default_year,
        layouts,
    )
    details = {
        "filenames": [path.rstrip("/").rsplit("/", 1)[-1] for path in files],
        "file_format": fmt,
        "multiline_start": multiline_start,
        "multiline_max_lines": multiline_max_lines if multiline_start else None,
    }
    return ingest_records(warehouse, records, target, mapping, rules, run_id, user, details)


def cancel(warehouse: Warehouse, run_id: str) -> None:
    """Stop a running ingest of this warehouse object; its run is recorded as cancelled."""
    warehouse.cancel_requests.add(run_id)
    warehouse.spark.interruptTag(run_id)


# ---------------------------------------------------------------- reading back


def _committed_rows(warehouse: Warehouse, target: str, outcome: str) -> DataFrame:
    full_name = warehouse.full_name(target)
    known = known_schema(warehouse, full_name)
    if known is None:
        raise ValueError(f"target {full_name} has no committed run")
    partitions = [T.StructField("run_id", T.StringType()), T.StructField(OUTCOME, T.StringType())]
    internal = [T.StructField(name, T.StringType()) for name in (SOURCE, ERROR, RECORD)]
    stored = (
        warehouse.spark.read.schema(T.StructType([*known.fields, *internal, *partitions]))
        .option("basePath", warehouse.target_path(full_name))
        .parquet(warehouse.target_path(full_name))
    )
    committed = warehouse.manifest().filter(
        (F.col("target") == full_name) & F.col("status").isin(*COMMITTED) & ~F.col("target_deleted")
    )
    runs = broadcast_if_small(committed.select(F.col("id").alias("run_id")))
    return stored.filter(F.col(OUTCOME) == outcome).join(runs, "run_id", "left_semi")


def read_target(warehouse: Warehouse, target: str) -> DataFrame:
    """Accepted records of all committed runs."""
    return _committed_rows(warehouse, target, OK).drop(*INTERNAL)


def read_dead_letters(warehouse: Warehouse, target: str, run_id: str | None = None) -> DataFrame:
    """(run_id, record, error, source_file) of rejected records."""
    rows = _committed_rows(warehouse, target, DEAD)
    if run_id is not None:
        rows = rows.filter(F.col("run_id") == run_id)
    return rows.select(
        "run_id", F.col(RECORD).alias("record"), F.col(ERROR).alias("error"), F.col(SOURCE).alias("source_file")
    )


def export_dead_letters(warehouse: Warehouse, target: str, run_id: str, path: str) -> None:
    read_dead_letters(warehouse, target, run_id).drop("run_id").write.mode("errorifexists").json(path)
