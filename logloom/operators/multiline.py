"""Re-assembly of records that span several lines.

A line matching the start pattern opens a record and other lines join the open one; a
record is closed by force at ``max_lines + 1`` lines.  Because that makes the piece number
a plain division, a line's record follows from two counts: its own position in the file and
the position of the last start at or before it.  Both are found per bounded block of lines
first and then shifted by what the earlier blocks of the file hold, so a single huge file
is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.regexes import CompiledPattern, compile_pattern
from logloom.sources.lines import block_of

BLOCK_KEY = ["source_path", "split_start", "block_no"]


def with_blocks(lines: DataFrame) -> DataFrame:
    return lines.withColumn("block_no", block_of(F.col("line_id")))


def earlier_blocks():
    """Window over the blocks of a file that come before the current one."""
    return (
        Window.partitionBy("source_path")
        .orderBy("split_start", "block_no")
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def _within_block():
    return Window.partitionBy(*BLOCK_KEY).orderBy("line_id").rowsBetween(Window.unboundedPreceding, 0)


def _assemble(placed: DataFrame, max_lines: int | None, separator: str) -> DataFrame:
    """Join lines to records, given per line its place ``at`` and the place of its start ``opened_at``."""
    record_at = F.col("opened_at")
    if max_lines is not None:
        record_at = F.col("at") - F.pmod(F.col("at") - F.col("opened_at"), F.lit(max_lines + 1))
    pieces = F.sort_array(F.collect_list(F.struct("at", "value")))
    return (
        placed.withColumn("record_at", record_at)
        .groupBy("source_path", "record_at")
        .agg(
            F.min("source_file").alias("source_file"),
            F.count(F.lit(1)).alias("n_lines"),
            F.array_join(F.transform(pieces, lambda piece: piece["value"]), separator).alias("value"),
        )
        .select(
            "source_path",
            "source_file",
            F.lit(0).cast("bigint").alias("split_start"),
            F.col("record_at").alias("line_id"),
            "value",
            "n_lines",
        )
    )


def _opened(placed: DataFrame) -> DataFrame:
    """Add ``at`` and ``opened_at``; needs is_start, before, first_id and open_start."""
    located = placed.withColumn("at", F.col("before") + F.col("line_id") - F.col("first_id"))
    own_start = F.max(F.when(F.col("is_start"), F.col("at"))).over(_within_block())
    return located.withColumn("opened_at", F.coalesce(own_start, F.col("open_start"), F.lit(0)))


def merge_by_flag(lines: DataFrame, is_start: Column, max_lines: int | None, separator: str = "\n") -> DataFrame:
    """Merge lines given a boolean start column; ``max_lines=None`` means unlimited."""
    flagged = with_blocks(lines.withColumn("is_start", F.coalesce(is_start, F.lit(False))))
    per_block = flagged.groupBy(*BLOCK_KEY).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.min("line_id").alias("first_id"),
        F.max(F.when(F.col("is_start"), F.col("line_id"))).alias("last_start_id"),
    )
    counted = per_block.withColumn("before", F.coalesce(F.sum("n_lines").over(earlier_blocks()), F.lit(0)))
    last_start = F.col("before") + F.col("last_start_id") - F.col("first_id")
    carried = counted.withColumn("open_start", F.max(last_start).over(earlier_blocks())).select(
        *BLOCK_KEY, "first_id", "before", "open_start"
    )
    return _assemble(_opened(flagged.join(carried, BLOCK_KEY)), max_lines, separator)


def merge_lines(
    lines: DataFrame,
    start_pattern: str | CompiledPattern,
    max_lines: int = 100,
    separator: str = "\n",
) -> DataFrame:
    """One row per record; ``line_id`` is the record's first line, counted from 0 in its file."""
    if max_lines < 1:
        raise ValueError("max_lines must be at least 1")
    pattern = compile_pattern(start_pattern, "regex") if isinstance(start_pattern, str) else start_pattern
    return merge_by_flag(lines, F.col("value").rlike(pattern.anchored), max_lines, separator)
