"""Continuous ingest of a landing folder."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from logloom.functions.regexes import CompiledPattern
from logloom.operators.profiling import MAX_FIELDS
from logloom.plans.control import Warehouse
from logloom.plans.ingest import FieldPlan, agreed_format, ingest_records
from logloom.sources.records import read_logs


def start_ingest(
    warehouse: Warehouse,
    landing: str,
    target: str,
    checkpoint: str,
    name: str,
    fmt: str | None = None,
    mapping: FieldPlan = FieldPlan(),
    rules: Mapping[str, Column] | None = None,
    pattern: CompiledPattern | None = None,
    multiline_start: str | None = None,
    multiline_max_lines: int = 100,
    max_files_per_batch: int = 1000,
    max_fields: int = MAX_FIELDS,
    user: str | None = None,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Each micro-batch of new files is one run of the batch job.

    The stream only carries file names: contents are read once, by the job itself, so every
    format and multi-line records work on whole files.  The run id is made of the query name
    and the batch number, which makes a repeated batch a no-op or an overwrite of itself.
    """
    files = (
        warehouse.spark.readStream.format("binaryFile")
        .option("maxFilesPerTrigger", max_files_per_batch)
        .option("recursiveFileLookup", "true")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .load(landing)
        .filter(F.col("length") > 0)
        .select("path", "length")
    )

    def run(batch: DataFrame, number: int) -> None:
        # at most max_files_per_batch names
        rows = batch.orderBy("path").collect()
        if not rows:
            return
        paths = [row["path"] for row in rows]
        chosen = fmt or agreed_format(warehouse, paths)
        records = read_logs(
            warehouse.spark,
            paths,
            chosen,
            pattern,
            multiline_start=multiline_start,
            multiline_max_lines=multiline_max_lines,
            max_fields=max_fields,
            unique_names=False,
        )
        details = {
            "filenames": [path.rsplit("/", 1)[-1] for path in paths],
            "file_size": sum(row["length"] for row in rows),
            "file_format": chosen,
            "upload_method": "stream",
        }
        ingest_records(warehouse, records, target, mapping, rules, f"{name}-{number}", user, details)

    writer = files.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(run)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
