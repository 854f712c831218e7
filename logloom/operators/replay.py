"""Replays of rules whose decisions depend on earlier decisions.

Sliding-window admission and account lockout are recursive, so no window function can
express them.  What can be done is to cut each key's history into independent stretches:
with time buckets as long as the window, a bucket is *calm* when it and the one before hold
too few events to ever reach the limit; decisions in it then do not depend on history.
A stretch starts after a calm or an empty bucket and only needs that one bucket as run-up.

Stretches of one key run in parallel.  A long stretch, as of a key that is saturated for good, is
cut into blocks that run speculatively: each from the state that its predecessor left when it ran
from its own assumption, at first none.  Blocks whose predecessor's state has changed run again,
until all agree; runs from different states mostly meet within a block, as windows move on and
successes clear.  Where they still differ after ``ROUNDS`` rounds, the rest of that stretch is
streamed by one task in time order.  A task holds the counted times of one window.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.session import broadcast_if_small, stored

MICROS = 1_000_000

# Default limits of the rules.
UPLOADS_PER_MINUTE = 10
LOGINS_PER_MINUTE = 5
ADMISSION_SECONDS = 60
LOCKOUT_ATTEMPTS = 5
LOCKOUT_MINUTES = 15

ENTRY_ROW, RUN_UP_ROW, LIVE_ROW = 0, 1, 2

# Events of one speculative block, slices of a window that blocks are cut at, and rounds of speculation.
BLOCK_EVENTS = 200_000
SLICES = 64
ROUNDS = 8


@dataclass
class Admission:
    """State of one key: times of the admitted events still inside the window."""

    limit: int
    window: int
    taken: deque

    def restore(self, times: list[int]) -> None:
        self.taken = deque(times)

    def dump(self) -> list[int]:
        return list(self.taken)

    def decide(self, at: int, _failed: bool) -> tuple[bool, int, int]:
        """(admitted, seconds to wait, quota left afterwards)."""
        taken = self.taken
        while taken and taken[0] <= at - self.window:
            taken.popleft()
        if len(taken) >= self.limit:
            wait = int((taken[0] + self.window - at) / MICROS) + 1
            return False, max(1, wait), 0
        taken.append(at)
        return True, 0, self.limit - len(taken)


@dataclass
class Lockout:
    """State of one account: times of the failures recorded since the last success."""

    limit: int
    window: int
    taken: deque

    restore = Admission.restore
    dump = Admission.dump

    def decide(self, at: int, failed: bool) -> tuple[bool, int, int]:
        """(let in to the check, failures counted, attempts left)."""
        recorded = self.taken
        while recorded and recorded[0] <= at - self.window:
            recorded.popleft()
        if len(recorded) >= self.limit:
            return False, len(recorded), 0
        if failed:
            recorded.append(at)
        else:
            recorded.clear()
        return True, len(recorded), self.limit - len(recorded)


RULES: dict[str, Callable[[int, int], Admission | Lockout]] = {
    "admission": lambda limit, window: Admission(limit, window, deque()),
    "lockout": lambda limit, window: Lockout(limit, window, deque()),
}

_OUT = "key string, at bigint, id bigint, ok boolean, first int, second int"
_PLACE = ["key", "stretch", "block"]
_EXIT = "key string, stretch bigint, block bigint, entry array<bigint>, exit array<bigint>"


def _replay_sorted(rule: str, limit: int, window: int, decisions: bool):
    """Streams sorted batches block by block; holds one block's state and one batch at a time.

    Yields decisions, or each block's entry state and the state it leaves.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, entry, last = None, None, [], None

        def left() -> tuple:
            return *current, entry, [t for t in state.dump() if last is None or t > last - window]

        columns = ["key", "at", "id", "ok", "first", "second"] if decisions else [*_PLACE, "entry", "exit"]
        for batch in batches:
            out = []
            entries = batch["taken"] if "taken" in batch else repeat(None)
            for key, stretch, block, role, at, id_, failed, taken in zip(
                *(batch[name] for name in (*_PLACE, "role", "at", "id", "failed")), entries
            ):
                if (key, stretch, block) != current:
                    if current is not None and not decisions:
                        out.append(left())
                    current, state, entry, last = (key, stretch, block), RULES[rule](limit, window), [], None
                if role == ENTRY_ROW:
                    entry = [int(t) for t in taken]
                    state.restore(list(entry))
                    continue
                decision, last = state.decide(at, failed), at
                if decisions and role == LIVE_ROW:
                    out.append((key, at, id_, *decision))
            if out:
                yield pd.DataFrame(out, columns=columns)
        if current is not None and not decisions:
            yield pd.DataFrame([left()], columns=columns)

    return run


def _run_blocks(
    rows: DataFrame, entries: DataFrame | None, rule: str, limit: int, window: int, decisions: bool
) -> DataFrame:
    """Run blocks of rows, each from its entry state if ``entries`` has one."""
    names = [*_PLACE, "role", "at", "id", "failed"]
    rows, own = rows.select(*names), _OUT if decisions else _EXIT
    if entries is not None:
        # an entry row has no event; plain values keep whole columns whole numbers
        no_event = [F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("id"), F.lit(False).alias("failed")]
        starts = entries.select(*_PLACE, F.lit(ENTRY_ROW).alias("role"), *no_event, F.col("entry").alias("taken"))
        rows = rows.withColumn("taken", F.lit(None).cast("array<bigint>")).unionByName(starts)
    ordered = rows.repartition(*_PLACE).sortWithinPartitions(*_PLACE, "role", "at", "id")
    return ordered.mapInPandas(_replay_sorted(rule, limit, window, decisions), own)


def _cut_blocks(placed: DataFrame, labels: DataFrame, window: int, block_events: int) -> DataFrame | None:
    """``placed`` with the rows of long stretches dealt to blocks of about ``block_events``, or None without any.

    Blocks end where slices of a window end, so they follow from counts per slice.
    """
    long_ones = stored(
        labels.groupBy("key", "stretch").agg(F.sum("n").alias("n")).filter(F.col("n") > block_events).drop("n")
    )
    if long_ones.isEmpty():
        return None
    place = F.floor(F.col("at") / max(1, window // SLICES)).cast("bigint")
    sliced = placed.withColumn("slice", F.when(F.col("role") == LIVE_ROW, place))
    counts = (
        sliced.filter("slice IS NOT NULL")
        .join(broadcast_if_small(long_ones), ["key", "stretch"], "left_semi")
        .groupBy("key", "stretch", "slice")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    before = F.sum("n").over(Window.partitionBy("key", "stretch").orderBy("slice")) - F.col("n")
    blocks = stored(
        counts.select("key", "stretch", "slice", F.floor(before / block_events).cast("bigint").alias("block"))
    )
    return sliced.drop("block").join(broadcast_if_small(blocks), ["key", "stretch", "slice"], "left").select(
        "key", "stretch", F.coalesce("block", F.lit(0)).cast("bigint").alias("block"), "role", "at", "id", "failed"
    )


def _settle(rows: DataFrame, run: Callable[[DataFrame, DataFrame | None], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Rows with the blocks to run in the end, and the entry state of each of them.

    ``rows`` is read again for every round, but only blocks that changed are run.
    """
    states = stored(run(rows, None))
    for round_ in range(ROUNDS + 1):
        wanted = states.select("key", "stretch", (F.col("block") + 1).alias("block"), F.col("exit").alias("wanted"))
        numbered = states.join(wanted, _PLACE, "left").withColumn("wanted", F.coalesce("wanted", F.expr("array()").cast("array<bigint>")))
        open_ = stored(numbered.filter(F.col("entry") != F.col("wanted")).select(*_PLACE, F.col("wanted").alias("entry")))
        if open_.isEmpty():
            return rows, states.select(*_PLACE, "entry")
        if round_ < ROUNDS:
            again = run(rows.join(broadcast_if_small(open_.select(*_PLACE)), _PLACE, "left_semi"), open_)
            states = stored(states.join(open_.select(*_PLACE), _PLACE, "left_anti").unionByName(again))
    # everything from a stretch's first open block on becomes one block, with that block's true entry
    first = open_.groupBy("key", "stretch").agg(F.min("block").alias("first"))
    last_block = F.least(F.col("block"), F.coalesce("first", F.col("block"))).alias("block")
    merged = rows.join(broadcast_if_small(first), ["key", "stretch"], "left").select(
        "key", "stretch", last_block, "role", "at", "id", "failed"
    )
    settled = states.join(first, ["key", "stretch"], "left").filter("first IS NULL OR block < first").select(*_PLACE, "entry")
    resumed = open_.join(first, ["key", "stretch"]).filter("block = first").select(*_PLACE, "entry")
    return merged, settled.unionByName(resumed)


def _label_buckets(events: DataFrame, counted: Column, most_calm: int) -> DataFrame:
    """Per (key, bucket): stretch and whether the bucket is run-up of the next one.

    Works on pre-aggregated bucket counts, whose number per key is bounded by time.
    """
    buckets = events.groupBy("key", "bucket").agg(F.count_if(counted).alias("counted"), F.count(F.lit(1)).alias("n"))
    by_time = Window.partitionBy("key").orderBy("bucket")
    adjacent = F.lag("bucket").over(by_time) == F.col("bucket") - 1
    before = F.when(adjacent, F.lag("counted").over(by_time)).otherwise(0)
    known = buckets.withColumn("adjacent", F.coalesce(adjacent, F.lit(False))).withColumn(
        "calm", F.col("counted") + F.coalesce(before, F.lit(0)) <= most_calm
    )
    fresh = ~F.col("adjacent") | F.lag("calm").over(by_time)
    return known.select(
        "key",
        "bucket",
        "n",
        F.max(F.when(fresh, F.col("bucket"))).over(by_time).alias("stretch"),
        (F.col("calm") & F.coalesce(F.lead("bucket").over(by_time) == F.col("bucket") + 1, F.lit(False))).alias(
            "leads"
        ),
    )


def _replay(
    events: DataFrame, rule: str, limit: int, window_us: int, most_calm: int, counted: Column, block_events: int
) -> DataFrame:
    """``events`` has key, at (micros), id, failed; returns key, at, id, ok, first, second."""
    bucketed = events.withColumn("bucket", F.floor(F.col("at") / window_us).cast("bigint"))
    # without enough events for one block nothing has to be looked up first
    few = bucketed.count() <= block_events
    labels = _label_buckets(bucketed, counted, most_calm)
    labels = labels if few else stored(labels)
    own = F.struct(F.col("stretch"), F.lit(LIVE_ROW).alias("role"))
    run_up = F.struct((F.col("bucket") + 1).alias("stretch"), F.lit(RUN_UP_ROW).alias("role"))
    placed = bucketed.join(labels, ["key", "bucket"]).select(
        "key",
        "at",
        "id",
        "failed",
        F.lit(0).cast("bigint").alias("block"),
        F.inline(F.when(F.col("leads"), F.array(own, run_up)).otherwise(F.array(own))),
    )
    blocked = None if few else _cut_blocks(placed, labels, window_us, block_events)
    if blocked is None:
        return _run_blocks(placed, None, rule, limit, window_us, decisions=True)

    def run(rows: DataFrame, entries: DataFrame | None) -> DataFrame:
        return _run_blocks(rows, entries, rule, limit, window_us, decisions=False)

    # blocks that are alone in their stretch need no speculation
    rows = stored(blocked)
    many = rows.filter("block > 0").select("key", "stretch").distinct()
    settled, entries = _settle(rows.join(broadcast_if_small(many), ["key", "stretch"], "left_semi"), run)
    alone = rows.join(broadcast_if_small(many), ["key", "stretch"], "left_anti")
    return _run_blocks(settled.unionByName(alone.select(*settled.columns)), entries, rule, limit, window_us, decisions=True)


def _prepared(events: DataFrame, key: str, ts: str, id_: str, failed: Column) -> DataFrame:
    return events.select(
        F.col(key).cast("string").alias("key"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("at"),
        F.col(id_).cast("bigint").alias("id"),
        failed.alias("failed"),
    )


def replay_admission(
    events: DataFrame,
    key: str,
    ts: str,
    id_: str,
    limit: int = UPLOADS_PER_MINUTE,
    window_seconds: int = ADMISSION_SECONDS,
    block_events: int = BLOCK_EVENTS,
) -> DataFrame:
    """(key, ts, id, allowed, retry_after, remaining) for every event.

    An event is admitted when fewer than ``limit`` admitted events lie in the window before
    it; rejected events are not counted.  Ties in time are ordered by id.
    """
    ready = _prepared(events, key, ts, id_, F.lit(False))
    if limit <= 0:
        decided = ready.select(
            "key", "at", "id", F.lit(True).alias("ok"), F.lit(0).alias("first"), F.lit(-1).alias("second")
        )
    else:
        decided = _replay(ready, "admission", limit, window_seconds * MICROS, limit, F.lit(True), block_events)
    return decided.select(
        F.col("key").alias(key),
        F.timestamp_micros("at").alias(ts),
        F.col("id").alias(id_),
        F.col("ok").alias("allowed"),
        F.col("first").alias("retry_after"),
        F.col("second").alias("remaining"),
    )


def replay_lockout(
    events: DataFrame,
    account: str,
    ts: str,
    id_: str,
    failed: Column,
    attempts: int = LOCKOUT_ATTEMPTS,
    window_minutes: int = LOCKOUT_MINUTES,
    block_events: int = BLOCK_EVENTS,
) -> DataFrame:
    """(account, ts, id, locked, failures, attempts_left, locks) for every login event.

    A failure is recorded only while the account is open; a success clears the record.
    ``locks`` marks the failure that reaches the limit.
    """
    ready = _prepared(events, account, ts, id_, failed)
    window = window_minutes * 60 * MICROS
    decided = _replay(ready, "lockout", attempts, window, attempts - 1, F.col("failed"), block_events)
    return decided.select(
        F.col("key").alias(account),
        F.timestamp_micros("at").alias(ts),
        F.col("id").alias(id_),
        (~F.col("ok")).alias("locked"),
        F.col("first").alias("failures"),
        F.col("second").alias("attempts_left"),
        (F.col("ok") & (F.col("second") == 0)).alias("locks"),
    )


def trailing_counts(events: DataFrame, key: str, ts: str, seconds: int, name: str = "recent") -> DataFrame:
    """Adds, per event, the events of its key in the window (ts - seconds, ts].

    Windows are cut at bucket borders and get the previous bucket as history, so the rows
    one task sorts are bounded by the traffic of two windows, not by the size of a key.
    """
    width = seconds * MICROS
    keyed = events.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    bucketed = keyed.withColumn("_bucket", F.floor(F.col("_at") / width))
    live = bucketed.withColumn("_live", F.lit(True))
    history = (
        bucketed.select(key, "_at", (F.col("_bucket") + 1).alias("_bucket")).withColumn("_live", F.lit(False))
    )
    window = Window.partitionBy(key, "_bucket").orderBy("_at").rangeBetween(-(width - 1), 0)
    both = live.unionByName(history, allowMissingColumns=True)
    return both.withColumn(name, F.count(F.lit(1)).over(window)).filter("_live").drop("_at", "_bucket", "_live")


def recent_counts(events: DataFrame, key: str, ts: str, now: Column, seconds: int) -> DataFrame:
    """Events per key later than ``now - seconds``, as of one moment."""
    cutoff = F.timestamp_micros(F.unix_micros(now) - seconds * MICROS)
    return events.filter(F.col(ts).cast("timestamp") > cutoff).groupBy(key).agg(F.count(F.lit(1)).alias("recent"))
