"""Splittable reading of files that hold one JSON array.

The file is read in fragments that end at a comma, so it needs no line breaks and no task ever
holds the whole array.  What a quote or bracket means depends on all text before it, but each
split can be summed up without knowing it: whether it leaves a quotation open or not, and by how
much the nesting changes if it was entered outside or inside a quotation.  These few numbers per
split are composed in file order, and every split is then cut into elements from its true state.
Only elements that run over the end of a split travel, in pieces, to be joined.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.literals import strip
from logloom.session import DEFAULT_BROADCAST_LIMIT_ROWS, stored
from logloom.sources.lines import read_lines

FRAGMENT_END = ","
# Text that is scanned at once, and the longest element; longer ones are cut and become bad records.
BUFFER_BYTES = 1 << 20
MAX_ELEMENT_BYTES = 1 << 28

BACKSLASH = 0x5C
QUOTE, COMMA, OPEN, CLOSE, OPEN_ARRAY, CLOSE_ARRAY = range(1, 7)
_KINDS = np.zeros(256, dtype=np.int8)
for _mark, _kind in zip(b'",{}[]', (QUOTE, COMMA, OPEN, CLOSE, OPEN_ARRAY, CLOSE_ARRAY), strict=True):
    _KINDS[_mark] = _kind
_WHITE = b" \t\r\n\x0b\x0c"
_BYTE_ORDER_MARK = "﻿".encode()


def structure(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and kinds of all marks that can carry structure; escaped quotes are left out."""
    codes = _KINDS[np.frombuffer(data, dtype=np.uint8)]
    places = np.flatnonzero(codes)
    kinds = codes[places]
    if b'\\"' in data:
        escaped = []
        for at in np.flatnonzero(kinds == QUOTE).tolist():
            place = before = int(places[at])
            while before and data[before - 1] == BACKSLASH:
                before -= 1
            if (place - before) % 2:
                escaped.append(at)
        places, kinds = np.delete(places, escaped), np.delete(kinds, escaped)
    return places, kinds


def nesting(kinds: np.ndarray, quoted: int, depth: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Per mark whether it stands outside quotations and the depth after it, and the state at the end."""
    quotes = kinds == QUOTE
    seen = np.cumsum(quotes)
    outside = (seen - quotes + quoted) % 2 == 0
    opens = (kinds == OPEN) | (kinds == OPEN_ARRAY)
    closes = (kinds == CLOSE) | (kinds == CLOSE_ARRAY)
    depths = depth + np.cumsum(np.where(outside, opens.astype(np.int64) - closes, 0))
    if not len(kinds):
        return outside, depths, quoted, depth
    return outside, depths, int((quoted + seen[-1]) % 2), int(depths[-1])


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes | None]]:
    """((path, file, split, entry state), text) in order; text None ends a split. The separator that
    stood before each fragment is put back, but for the first of a file."""
    current, held, size = None, [], 0
    for batch in batches:
        columns = [batch[name].to_pylist() for name in batch.schema.names]
        for path, name, start, value, *entry in zip(*columns, strict=True):
            key = (path, name, start, *entry)
            if key != current:
                if current is not None:
                    yield current, b"".join(held)
                    yield current, None
                current, size, data = key, 0, value.encode("utf-8")
                held = [data if start == 0 else b"," + data]
            else:
                data = value.encode("utf-8")
                held += (b",", data)
            size += len(data)
            if size >= BUFFER_BYTES and data[-1:] != b"\\":
                yield current, b"".join(held)
                held, size = [], 0
    if current is not None:
        yield current, b"".join(held)
        yield current, None


_SUMMARY = "source_path string, split_start long, quotes int, straight long, flipped long"


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    state: list[tuple[int, int]] = [(0, 0), (1, 0)]
    for (path, _, start), data in _buffers(batches):
        if data is None:
            out.append((path, start, state[0][0], state[0][1], state[1][1]))
            state = [(0, 0), (1, 0)]
            continue
        kinds = structure(data)[1]
        state = [nesting(kinds, *own)[2:] for own in state]
    columns = list(zip(*out, strict=True)) or [()] * 5
    types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    names = [field.split()[0] for field in _SUMMARY.split(", ")]
    yield pa.record_batch([pa.array(own, kind) for own, kind in zip(columns, types, strict=True)], names=names)


def entry_states(lines: DataFrame) -> DataFrame:
    """(source_path, split_start, quoted, depth): the state in which each later split of a file is entered."""
    located = lines.select("source_path", "source_file", "split_start", "value")
    splits = located.mapInArrow(_summarise, _SUMMARY)
    earlier = Window.partitionBy("source_path").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    entered = splits.withColumn("quoted", F.pmod(F.coalesce(F.sum("quotes").over(earlier), F.lit(0)), F.lit(2)).cast("int"))
    change = F.when(F.col("quoted") == 0, F.col("straight")).otherwise(F.col("flipped"))
    return (
        entered.withColumn("change", change)
        .withColumn("depth", F.coalesce(F.sum("change").over(earlier), F.lit(0)))
        .filter("split_start > 0")
        .select("source_path", "split_start", "quoted", "depth")
    )


_PIECE = "source_path string, source_file string, split_start long, line_id long, part int, value string"
#: what a piece is: a whole element, the start of one that the split does not end, or more of an earlier one
WHOLE, START, MORE = range(3)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in _PIECE.split(", ")]
    types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    out: list[tuple] = []
    held, inside, number, state = [], WHOLE, 0, None

    def put(key: tuple, data: bytes, part: int) -> None:
        nonlocal number
        text = data.removeprefix(_BYTE_ORDER_MARK) if key[2] == 0 and number == 0 else data
        if part != WHOLE or text.strip(_WHITE):
            out.append((*key[:3], number, part, text.decode("utf-8")))
            number += 1

    for key, data in _buffers(batches):
        if state is None:
            state = (key[3] or 0, key[4] or 0)
            inside = MORE if state[1] else WHOLE
        if data is None:
            # an element stays open at the end of a split, even if none of its text has come yet
            put(key, b"".join(held), START if inside == WHOLE and state[1] else inside)
            held, inside, number, state = [], WHOLE, 0, None
        else:
            places, kinds = structure(data)
            outside, depths, *state = nesting(kinds, *state)
            cuts = outside & (
                ((kinds == COMMA) & (depths == 1))
                | ((kinds == OPEN_ARRAY) & (depths == 1))
                | ((kinds == CLOSE_ARRAY) & (depths == 0))
            )
            at = 0
            for place in places[cuts].tolist():
                held.append(data[at:place])
                put(key, b"".join(held), inside)
                held, inside, at = [], WHOLE, place + 1
            held.append(data[at:])
            if sum(map(len, held)) >= BUFFER_BYTES:
                # an element longer than the buffer goes on in pieces
                put(key, b"".join(held), START if inside == WHOLE else inside)
                held, inside = [], MORE
        if len(out) >= 1000:
            yield pa.record_batch([pa.array(own, kind) for own, kind in zip(zip(*out), types)], names=names)
            out.clear()
    columns = list(zip(*out, strict=True)) or [()] * 6
    yield pa.record_batch([pa.array(own, kind) for own, kind in zip(columns, types, strict=True)], names=names)


def _join_pieces(pieces: DataFrame) -> DataFrame:
    """Elements that run over split ends, from their start and what follows it; too long ones are cut."""
    in_order = Window.partitionBy("source_path").orderBy("split_start", "line_id")
    opened = F.last(F.when(F.col("part") == START, F.struct("split_start", "line_id")), ignorenulls=True)
    placed = pieces.withColumn("opened", F.coalesce(opened.over(in_order), F.struct("split_start", "line_id")))
    so_far = F.sum(F.octet_length("value").cast("bigint")).over(
        Window.partitionBy("source_path", "opened").orderBy("split_start", "line_id")
    )
    parts = F.array_sort(F.collect_list(F.struct("split_start", "line_id", "value")))
    return (
        placed.withColumn("so_far", so_far)
        .filter((F.col("so_far") <= MAX_ELEMENT_BYTES) | (F.col("part") == START))
        .groupBy("source_path", "source_file", "opened")
        .agg(F.array_join(F.transform(parts, lambda part: part["value"]), "").alias("value"))
        .select("source_path", "source_file", "opened.split_start", "opened.line_id", "value")
    )


def split_elements(fragments: DataFrame, whole: bool = False) -> DataFrame:
    """Lines table of comma-ended fragments to a lines table of array elements.

    Each split's fragments must be in order in one partition, as they come from a scan.  With
    ``whole`` every line is a text of its own and nothing is carried from split to split.
    """
    names = ["source_path", "source_file", "split_start", "value"]
    if whole:
        nothing = {"quoted": F.lit(None).cast("int"), "depth": F.lit(None).cast("bigint")}
        pieces = fragments.select(*names).withColumns(nothing).mapInArrow(_cut, _PIECE)
        elements = pieces.select("source_path", "source_file", "split_start", "line_id", "value")
    else:
        states = stored(entry_states(fragments))
        few = states.count() <= DEFAULT_BROADCAST_LIMIT_ROWS
        entered = fragments.join(F.broadcast(states) if few else states, ["source_path", "split_start"], "left")
        if not few:  # a shuffled join loses the order
            key = ["source_path", "split_start"]
            entered = entered.repartition(*key).sortWithinPartitions(*key, "line_id")
        pieces = stored(entered.select(*names, "quoted", "depth").mapInArrow(_cut, _PIECE))
        plain = pieces.filter(F.col("part") == WHOLE).drop("part")
        elements = plain.unionByName(_join_pieces(pieces.filter(F.col("part") != WHOLE)))
    return elements.withColumn("value", strip(F.col("value"))).filter(F.col("value") != "")


def read_array_elements(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return split_elements(read_lines(spark, paths, separator=FRAGMENT_END, in_order=True))
