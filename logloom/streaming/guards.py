"""Admission and lockout on event streams.

Events of a key are held back until the watermark has passed their slot, a fraction of the rule's
window, and are then decided in event-time order.  Every call to the state is a message to another
process, so keys are dealt to BUCKETS groups that share a state and a timer: a trigger adds the events
of a bucket as entries of up to ENTRY_EVENTS under the first of their slots, and the number of calls
grows with the buckets it touches, not with their keys or the time it spans.  Beside the held events
the state of a bucket is the list of counted times (never more than the limit) of each key that has
some in the window.  What a trigger reads and writes is the entries and the counted times of the buckets
it touches, however long the history is.  Later events are dropped by the watermark and counted, see
:func:`late_events`.  Counted times are cleared once the window has left them, at the latest by a last
timer, in event time; a TTL would go by the clock of the machines and forget counted times when an
old log is replayed.

A stream that has come to its end still holds the events that its watermark has not passed;
:func:`held_admission` and :func:`held_lockout` decide those from the query's last state.
Bound the rows of a trigger at the source (``maxFilesPerTrigger``): a bucket's rows of one trigger
pass one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from logloom.operators.replay import (
    ADMISSION_SECONDS,
    LOCKOUT_ATTEMPTS,
    LOCKOUT_MINUTES,
    MICROS,
    RULES,
    UPLOADS_PER_MINUTE,
)

_OUT = "key string, at bigint, id bigint, ok boolean, first int, second int"
_NAMES = ["key", "at", "id", "ok", "first", "second"]
_EVENTS = "key array<string>, at array<bigint>, id array<bigint>, failed array<boolean>"
# Groups of keys and events of one entry of the state; a query keeps those it was started with.
BUCKETS, ENTRY_EVENTS = 1024, 16384
# Slots of a window in which events are held together.
SLOTS = 4
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class GuardProcessor(StatefulProcessor):
    """One rule over the events of the keys of each bucket, in event-time order."""

    def __init__(self, rule: str, limit: int, window: int) -> None:
        self.rule, self.limit, self.window = rule, limit, window
        self.slot_ms = max(1, window // (SLOTS * 1000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.taken = handle.getValueState("taken", "key array<string>, at array<array<bigint>>")
        self.held = handle.getMapState("held", "slot bigint, part bigint", _EVENTS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = self._next_part(self.held.keys())
        first = None
        for batch in rows:
            for start in range(0, len(batch), ENTRY_EVENTS):
                some = batch.iloc[start : start + ENTRY_EVENTS]
                failed = some["failed"].astype(bool)
                slot = self._hold(part, *(one.tolist() for one in (some["key"], some["at"], some["id"], failed)))
                first, part = slot if first is None else min(first, slot), part + 1
        if first is not None:
            self._wake((first + 1) * self.slot_ms)
        return iter(())

    def _next_part(self, entries) -> int:
        return max((part for _, part in entries), default=-1) + 1

    def _slot(self, at: int) -> int:
        return at // (self.slot_ms * 1000)

    def _hold(self, part: int, keys: list, at: list, ids: list, failed: list) -> int:
        """Add events to the state as one entry, under the first of their slots, which is returned."""
        slot = self._slot(min(at))
        self.held.updateValue((slot, part), (keys, at, ids, failed))
        return slot

    def _wake(self, at_ms: int) -> None:
        """Keep one timer, at the earliest moment asked for."""
        timers = list(self.handle.listTimers())
        if not timers or at_ms < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at_ms)

    def _due(self, first: int) -> tuple[dict[str | None, list[tuple]], int | None]:
        """Events by key of all slots before `first`, taken out of the state, and the next slot held.

        An entry may reach into slots that aren't due. What it holds of those is then kept slot by
        slot, so that a wide entry is not written again for each of them.
        """
        entries = list(self.held.keys())
        due = [entry for entry in entries if entry[0] < first]
        if len(due) == len(entries):
            found = [events for _, events in self.held.iterator()]
            self.held.clear()
        else:
            found = [self.held.getValue(entry) for entry in due]
            for entry in due:
                self.held.removeKey(entry)
        ripe: dict[str | None, list[tuple]] = {}
        early: dict[int, list[tuple]] = {}
        for key, at, id_, failed in (event for events in found for event in zip(*events)):
            slot = self._slot(at)
            if slot < first:
                ripe.setdefault(key, []).append((at, id_, failed))
            else:
                early.setdefault(slot, []).append((key, at, id_, failed))
        part = self._next_part(entries)
        for events in early.values():
            for start in range(0, len(events), ENTRY_EVENTS):
                self._hold(part, *(list(one) for one in zip(*events[start : start + ENTRY_EVENTS])))
                part += 1
        return ripe, min([*early, *(slot for slot, _ in entries if slot >= first)], default=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark_ms = timerValues.getCurrentWatermarkInMs()
        first = watermark_ms // self.slot_ms
        ripe, later = self._due(first)
        taken = dict(zip(*(self.taken.get() or ([], []))))
        rows = []
        for own, events in ripe.items():
            rule = RULES[self.rule](self.limit, self.window)
            rule.restore([int(at) for at in taken.get(own, [])])
            rows += [(own, int(at), int(id_), *rule.decide(int(at), bool(failed))) for at, id_, failed in sorted(events)]
            taken[own] = list(rule.dump())
        # events of the slot that the watermark is in may still come or be held
        horizon = first * self.slot_ms * 1000
        live = {own: [at for at in times if at + self.window > horizon] for own, times in taken.items()}
        live = {own: times for own, times in live.items() if times}
        if live:
            self.taken.update((list(live), list(live.values())))
        elif taken:
            self.taken.clear()
        if later is not None:
            self.handle.registerTimer((later + 1) * self.slot_ms)
        elif live:
            # wake once more when the window has left them all
            self.handle.registerTimer((max(times[-1] for times in live.values()) + self.window) // 1000 + 1)
        if rows:
            yield pd.DataFrame(rows, columns=_NAMES)

    def close(self) -> None:
        pass


def _decided(
    events: DataFrame, rule: str, key: str, ts: str, id_: str, failed: Column, limit: int, window: int, lateness: str
) -> DataFrame:
    # processors with several states need this store; queries keep the store they were started with
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    ready = events.select(
        F.col(key).cast("string").alias("key"),
        F.col(ts).cast("timestamp").alias("ts"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("at"),
        F.col(id_).cast("bigint").alias("id"),
        F.coalesce(failed, F.lit(False)).alias("failed"),
    )
    return (
        ready.withWatermark("ts", lateness)
        .withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))
        .groupBy("bucket")
        .transformWithStateInPandas(GuardProcessor(rule, limit, window), _OUT, "append", "eventTime")
    )


def late_events(query: StreamingQuery) -> int:
    """Events dropped because the watermark had passed them, over the query's recent triggers."""
    return sum(
        operator["numRowsDroppedByWatermark"] for step in query.recentProgress for operator in step["stateOperators"]
    )


def _read_state(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)


def _held(spark: SparkSession, checkpoint: str, rule: str, limit: int, window: int) -> DataFrame:
    """Decisions for the events that the last state of a finished query still holds."""
    taken = _read_state(spark, checkpoint, "taken").select(F.inline(F.arrays_zip("value.key", "value.at")))
    taken = taken.toDF("key", "taken")
    events = [f"user_map_value.{name}" for name in ("key", "at", "id", "failed")]
    held = _read_state(spark, checkpoint, "held").select(F.inline(F.arrays_zip(*events)))
    start = F.lit(None).cast("bigint")
    rows = held.toDF("key", "at", "id", "failed").withColumn("taken", F.lit(None).cast("array<bigint>")).unionByName(
        taken.select("key", start.alias("at"), start.alias("id"), F.lit(None).cast("boolean").alias("failed"), "taken")
    )
    ordered = rows.repartition("key").sortWithinPartitions("key", F.col("taken").isNull(), "at", "id")

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, own = object(), None
        for batch in batches:
            out = []
            for key, at, id_, failed, times in zip(*(batch[name] for name in ("key", "at", "id", "failed", "taken"))):
                if key != current:
                    current, own = key, RULES[rule](limit, window)
                if times is not None:
                    own.restore([int(t) for t in times])
                else:
                    out.append((key, int(at), int(id_), *own.decide(int(at), bool(failed))))
            yield pd.DataFrame(out, columns=_NAMES)

    exact = ordered.select(
        "key", F.coalesce("at", F.lit(0)).alias("at"), F.coalesce("id", F.lit(0)).alias("id"), F.coalesce("failed", F.lit(False)).alias("failed"), "taken"
    )
    return exact.mapInPandas(decide, _OUT)


def _as_admission(decided: DataFrame, key: str, ts: str, id_: str) -> DataFrame:
    return decided.select(
        F.col("key").alias(key),
        F.timestamp_micros("at").alias(ts),
        F.col("id").alias(id_),
        F.col("ok").alias("allowed"),
        F.col("first").alias("retry_after"),
        F.col("second").alias("remaining"),
    )


def _as_lockout(decided: DataFrame, account: str, ts: str, id_: str) -> DataFrame:
    return decided.select(
        F.col("key").alias(account),
        F.timestamp_micros("at").alias(ts),
        F.col("id").alias(id_),
        (~F.col("ok")).alias("locked"),
        F.col("first").alias("failures"),
        F.col("second").alias("attempts_left"),
        (F.col("ok") & (F.col("second") == 0)).alias("locks"),
    )


def held_admission(
    spark: SparkSession,
    checkpoint: str,
    key: str,
    ts: str,
    id_: str,
    limit: int = UPLOADS_PER_MINUTE,
    window_seconds: int = ADMISSION_SECONDS,
) -> DataFrame:
    """What :func:`stream_admission` has not decided when its query ended, from the query's checkpoint."""
    return _as_admission(_held(spark, checkpoint, "admission", limit, window_seconds * MICROS), key, ts, id_)


def held_lockout(
    spark: SparkSession,
    checkpoint: str,
    account: str,
    ts: str,
    id_: str,
    attempts: int = LOCKOUT_ATTEMPTS,
    window_minutes: int = LOCKOUT_MINUTES,
) -> DataFrame:
    """What :func:`stream_lockout` has not decided when its query ended, from the query's checkpoint."""
    return _as_lockout(_held(spark, checkpoint, "lockout", attempts, window_minutes * 60 * MICROS), account, ts, id_)


def stream_admission(
    events: DataFrame,
    key: str,
    ts: str,
    id_: str,
    limit: int = UPLOADS_PER_MINUTE,
    window_seconds: int = ADMISSION_SECONDS,
    lateness: str = "1 minute",
) -> DataFrame:
    """Streaming form of the admission replay, with the same output columns."""
    decided = _decided(
        events, "admission", key, ts, id_, F.lit(False), limit, window_seconds * MICROS, lateness
    )
    return _as_admission(decided, key, ts, id_)


def stream_lockout(
    events: DataFrame,
    account: str,
    ts: str,
    id_: str,
    failed: Column,
    attempts: int = LOCKOUT_ATTEMPTS,
    window_minutes: int = LOCKOUT_MINUTES,
    lateness: str = "1 minute",
) -> DataFrame:
    """Streaming form of the lockout replay, with the same output columns."""
    decided = _decided(
        events, "lockout", account, ts, id_, failed, attempts, window_minutes * 60 * MICROS, lateness
    )
    return _as_lockout(decided, account, ts, id_)
