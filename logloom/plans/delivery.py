"""Sending a run's accepted records on to an outside sink, in bounded batches.

The run is already written, so every record has an id that no retry changes: its run, its file and
its place in the file.  A sink that keeps one record per id is not harmed by a task that runs twice.
Rejected records come back as rows of the job and are written as dead letters, in parallel.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from logloom.plans.control import COMMITTED, Warehouse
from logloom.plans.ingest import OK, OUTCOME, known_schema
from logloom.session import quoted

# Records of a batch, attempts, first pause in seconds; each further pause is twice as long.
BATCH_RECORDS = 1000
ATTEMPTS = 3
FIRST_PAUSE = 1.0
BATCH_BYTES = 8 * 1024 * 1024

_OUTCOMES = "id string, record string, error string, sent bigint, rejected bigint"


class RetryableError(Exception):
    """The sink is busy or out of reach; the same batch may be sent again.

    Known by its mark and not by its class, as the library's code may reach a task by value while
    the transport imports it there, which makes two classes of one.
    """

    retryable = True


class Transport(Protocol):
    def send(self, batch: Sequence[tuple[str, str]]) -> Sequence[str | None]:
        """Take (id, JSON text) pairs; an error text for each that is refused, None for the others."""


@dataclass(frozen=True)
class Delivery:
    run_id: str
    delivered: int
    rejected: int


def send_with_retries(
    transport: Transport,
    batch: Sequence[tuple[str, str]],
    attempts: int = ATTEMPTS,
    first_pause: float = FIRST_PAUSE,
    pause: Callable[[float], None] = time.sleep,
) -> Sequence[str | None]:
    """Errors per record; raises what the last attempt raised, and what is not retryable at once."""
    for attempt in range(attempts):
        try:
            errors = transport.send(batch)
            break
        except Exception as problem:
            if attempt == attempts - 1 or not getattr(problem, "retryable", False):
                raise
            pause(first_pause * 2**attempt)
    if len(errors) != len(batch):
        raise ValueError(f"the sink answered {len(errors)} of {len(batch)} records")
    return errors


def batches(
    rows: Iterator[tuple[str, str]], records: int = BATCH_RECORDS, size: int = BATCH_BYTES
) -> Iterator[list[tuple[str, str]]]:
    """Batches of at most ``records`` records and ``size`` bytes; a larger record goes alone."""
    batch: list[tuple[str, str]] = []
    held = 0
    for row in rows:
        length = len(row[1].encode())
        if batch and (len(batch) >= records or held + length > size):
            yield batch
            batch, held = [], 0
        batch.append(row)
        held += length
    if batch:
        yield batch


def send_records(
    records: DataFrame,
    make_transport: Callable[[], Transport],
    batch_records: int = BATCH_RECORDS,
    batch_bytes: int = BATCH_BYTES,
    attempts: int = ATTEMPTS,
    first_pause: float = FIRST_PAUSE,
) -> DataFrame:
    """Send (id, record) rows; each rejected one comes back, and one row with the counts of each batch.

    ``make_transport`` is called once per task, where connections are made.
    """

    def send(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transport = None
        rows = (pair for part in parts for pair in zip(part["id"], part["record"]))
        for batch in batches(rows, batch_records, batch_bytes):
            transport = transport or make_transport()
            errors = send_with_retries(transport, batch, attempts, first_pause)
            refused = [(key, text, error, 0, 0) for (key, text), error in zip(batch, errors) if error is not None]
            counts = (None, None, None, len(batch) - len(refused), len(refused))
            yield pd.DataFrame([*refused, counts], columns=["id", "record", "error", "sent", "rejected"])

    return records.select("id", "record").mapInPandas(send, _OUTCOMES)


def deliver(
    warehouse: Warehouse, target: str, run_id: str, make_transport: Callable[[], Transport], **limits: float
) -> Delivery:
    """Send the accepted records of a committed run. Doing it again sends the same ids again.

    A sink that stays busy fails the job after the attempts of every task; nothing is recorded then.
    """
    full_name = warehouse.full_name(target)
    run = warehouse.manifest().filter(
        (F.col("id") == run_id) & (F.col("target") == full_name) & F.col("status").isin(*COMMITTED) & ~F.col("target_deleted")
    )
    if run.isEmpty():
        raise ValueError(f"target {full_name} has no committed run {run_id}")
    accepted = f"{warehouse.run_path(full_name, run_id)}/{OUTCOME}={OK}"
    schema = known_schema(warehouse, full_name)
    if warehouse.exists(accepted):
        stored = warehouse.spark.read.schema(schema).parquet(accepted)
        place = F.concat_ws("/", F.lit(run_id), F.col("_metadata.file_name"), F.col("_metadata.row_index"))
        records = stored.select(place.alias("id"), F.to_json(F.struct(*[quoted(f.name) for f in schema.fields])).alias("record"))
    else:
        records = warehouse.spark.createDataFrame([], "id string, record string")
    counts = Observation()
    outcomes = send_records(records, make_transport, **limits).observe(
        counts,
        F.coalesce(F.sum("sent"), F.lit(0)).alias("sent"),
        F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected"),
    )
    refused = outcomes.filter("error is not null").drop("sent", "rejected")
    refused.write.mode("overwrite").parquet(_refused_path(warehouse, target, run_id))
    return Delivery(run_id, counts.get["sent"], counts.get["rejected"])


def _refused_path(warehouse: Warehouse, target: str, run_id: str) -> str:
    return f"{warehouse.root.rstrip('/')}/_refused/{warehouse.full_name(target)}/run_id={run_id}"


def read_refused(warehouse: Warehouse, target: str, run_id: str) -> DataFrame:
    """(id, record, error) of the records the sink refused when the run was last delivered."""
    return warehouse.spark.read.schema("id string, record string, error string").parquet(
        _refused_path(warehouse, target, run_id)
    )
