"""First look at files before an ingest: format, a few records, their fields and raw lines."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.regexes import CompiledPattern
from logloom.operators.multiline import merge_lines
from logloom.operators.profiling import (
    MAX_FIELDS,
    collect_fields,
    column_entries,
    detect_formats,
    field_profile,
    format_agreement,
    map_entries,
    timestamp_candidates,
)
from logloom.sources.lines import as_paths, leading_files, leading_lines, lines_in_order, raw_sample, read_lines
from logloom.sources.records import (
    LINE_FORMATS,
    MULTILINE_FORMATS,
    SOURCE,
    data_columns,
    filled_lines,
    json_records,
    parse_lines,
    read_logs,
    tidy,
)

# Records shown for one file, per file when there are several, and raw lines shown.
SINGLE_FILE_RECORDS, RECORDS_PER_FILE, RAW_LINES = 100, 5, 10


@dataclass(frozen=True)
class Preview:
    fmt: str
    records: DataFrame
    fields: list[tuple[str, str]]
    raw_lines: DataFrame

    def timestamp_fields(self) -> list[str]:
        names = data_columns(self.records)
        found = timestamp_candidates(self.records.select(*[F.col(f"`{name}`") for name in names]))
        return [row["name"] for row in found.filter("candidate").collect()]


def _first_records(
    spark: SparkSession,
    path: str,
    fmt: str,
    count: int,
    pattern: CompiledPattern | None,
    multiline_start: str | None,
    multiline_max_lines: int,
    max_fields: int,
) -> DataFrame:
    """First records of one file or folder; reading stops once there are enough of them."""
    if fmt not in LINE_FORMATS:
        return read_logs(spark, path, fmt, pattern, max_fields=max_fields, check_tabular=True).limit(count)
    for files, all_files in leading_files(spark, path):
        lines = lines_in_order(spark, files)
        found = _records_of(spark, lines, fmt, count, pattern, multiline_start, multiline_max_lines, max_fields)
        if all_files or found.count() >= count:
            break
    return found


def _records_of(
    spark: SparkSession,
    lines: DataFrame,
    fmt: str,
    count: int,
    pattern: CompiledPattern | None,
    multiline_start: str | None,
    multiline_max_lines: int,
    max_fields: int,
) -> DataFrame:
    """First records of lines that come in order."""
    if multiline_start and fmt in MULTILINE_FORMATS:
        # no record is longer than max_lines + 1 lines, so these hold the first records whole
        head = leading_lines(lines, count * (multiline_max_lines + 1) + 1).drop("line_no")
        merged = merge_lines(head, multiline_start, multiline_max_lines).drop("n_lines")
        merged = merged.orderBy("source_path", "split_start", "line_id").limit(count)
        return tidy(parse_lines(merged, fmt, pattern, max_fields=max_fields, keep_unparsed=True))
    if fmt == "ndjson":
        sample = spark.createDataFrame(filled_lines(lines).take(count), lines.schema)
        fields = collect_fields(field_profile(map_entries(json_records(sample))), max_fields)
        return tidy(parse_lines(sample, fmt, fields=fields, max_fields=max_fields))
    first = tidy(parse_lines(lines, fmt, pattern, max_fields=max_fields, sample=count))
    # take() reads partition by partition from the start of the file
    return spark.createDataFrame(first.take(count), first.schema)


def preview_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    fmt: str | None = None,
    pattern: CompiledPattern | None = None,
    multiline_start: str | None = None,
    multiline_max_lines: int = 100,
    limit: int = SINGLE_FILE_RECORDS,
    max_fields: int = MAX_FIELDS,
) -> Preview:
    """Preview of files of one format, detected unless given.

    Calling it again with another format, pattern or start pattern re-reads the same files
    that way.  Several files show a few records each, until ``limit`` is reached, so only the
    first ``limit / 5`` files are opened.
    """
    files = as_paths(paths)
    if fmt is None and pattern is None:
        agreed = format_agreement(detect_formats(read_lines(spark, files))).first()
        if agreed["files"] == 0:
            raise ValueError("the files are empty")
        if not agreed["uniform"]:
            raise ValueError("the files do not share one format")
        fmt = agreed["format"]
    fmt = fmt or "custom"
    count = limit if len(files) == 1 else RECORDS_PER_FILE
    records = None
    for path in files[: max(1, limit // count)]:
        part = _first_records(spark, path, fmt, count, pattern, multiline_start, multiline_max_lines, max_fields)
        records = part if records is None else records.unionByName(part, allowMissingColumns=True)
    shown = records.select(*[F.col(f"`{name}`") for name in data_columns(records)])
    found = collect_fields(field_profile(column_entries(shown)), max_fields)
    return Preview(fmt, records, [(name, kind) for name, kind, _ in found], raw_sample(spark, files, RAW_LINES))


def describe(preview: Preview) -> dict[str, object]:
    """Plain values for display."""
    return {
        "format": preview.fmt,
        "fields": preview.fields,
        "records": preview.records.drop(SOURCE).count(),
        "raw_lines": [row["value"] for row in preview.raw_lines.collect()],
    }
