"""Layouts of the times in a text column, told from the column as a whole.

Reading value by value takes `01/02/2024` month first and `13/02/2024` in the next row day first.
Here every value votes: the shapes of all values are counted, and numeric dates of a column are read
in one order, the one that more of its values allow alone.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.binding import bind
from logloom.functions.literals import strip
from logloom.functions.timestamps import MONTH, Layout, clean_time_text
from logloom.session import quoted, stored

# A shape is the cleaned text with numbers and names replaced: N one or two digits, Y four digits,
# B a month's name, P am or pm, Z an offset. All else is lower case.
SHAPE_STEPS = (
    (r"(?<=:[0-9]{2})( ?)[+-][0-9]{4}$", "$1Z"),
    (rf"(?<![a-z]){MONTH}(?![a-z])", "B"),
    (r"(?<=[0-9])( ?)[ap]m(?![a-z])", "$1P"),
    (r"(?<![0-9])[0-9]{4}(?![0-9])", "Y"),
    (r"(?<![0-9])[0-9]{1,2}(?![0-9])", "N"),
)
_GAP = r"(?:, ?|[ ./-])"
_DATE = rf"(?:N{_GAP}N{_GAP}[YN]|N{_GAP}?B{_GAP}?[YN]|B{_GAP}N{_GAP}[YN]|Y{_GAP}(?:N|B){_GAP}N)"
_CLOCK = r"N:N(?::N)?(?: ?P)?"
# Dates of which only the order of the column tells day from month.
_NUMERIC_DATE = rf"N{_GAP}N{_GAP}[YN]"


def _whole_shape(date: str) -> str:
    return rf"^(?:{_CLOCK},? ({date})|({date})(?:(?:,? |t){_CLOCK}(?: ?Z)?)?)$"


TIME_SHAPE, NUMERIC_SHAPE = _whole_shape(_DATE), _whole_shape(_NUMERIC_DATE)
_NUMBERS = r"(?<![0-9:])([0-9]{1,2})(?:, ?|[ ./-])([0-9]{1,2})(?:, ?|[ ./-])(?:[0-9]{4}|[0-9]{1,2})(?![0-9:])"
_TOKEN_REGEX = {"N": "[0-9]{1,2}", "Y": "[0-9]{4}", "B": MONTH, "P": "(?i:am|pm)", "Z": "[+-][0-9]{4}", "t": "(?i:t)"}


@dataclass(frozen=True)
class ColumnTimes:
    """Layouts of a column, most frequent first, and its order of day and month ('month' or 'day' first).

    `decided` is false if numeric dates occur and as many values speak for one order as for the other.
    """

    layouts: tuple[Layout, ...]
    order: str
    decided: bool


def shape_of(cleaned: Column) -> Column:
    """Shape of a cleaned text, null where it is none of a time."""
    shape = F.lower(cleaned)
    for pattern, token in SHAPE_STEPS:
        shape = F.regexp_replace(shape, pattern, token)
    return bind(shape, lambda found: F.when(found.rlike(TIME_SHAPE), found))


def time_shapes(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, shape, rows, month_votes, day_votes) of the filled values of text columns.

    A vote is a numeric date that only one order can read: 02/13 for month first, 13/02 for day
    first. Values that are no times have a null shape. One scan, counted before the shuffle; the
    grammar has a bounded number of shapes, so the result is small however long the table is.
    """
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("column"), quoted(name).alias("text")) for name in columns]))
    cleaned = table.select(named.alias("cell")).select("cell.column", clean_time_text(strip(F.col("cell.text"))).alias("text"))
    shaped = cleaned.filter("text != ''").select("column", "text", shape_of(F.col("text")).alias("shape"))
    numeric = F.coalesce(F.col("shape").rlike(NUMERIC_SHAPE), F.lit(False))
    first, second = (F.regexp_extract("text", _NUMBERS, number).try_cast("int") for number in (1, 2))
    return shaped.groupBy("column", "shape").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(numeric & first.between(1, 12) & second.between(13, 31)).alias("month_votes"),
        F.count_if(numeric & first.between(13, 31) & second.between(1, 12)).alias("day_votes"),
    )


def time_orders(shapes: DataFrame, default_order: str = "month") -> DataFrame:
    """One row per column of ``time_shapes``: values, times, numeric dates, votes, order and whether it is decided."""
    times = F.col("shape").isNotNull()
    numeric = F.coalesce(F.col("shape").rlike(NUMERIC_SHAPE), F.lit(False))
    sums = shapes.groupBy("column").agg(
        F.sum("rows").alias("filled"),
        F.sum(F.when(times, F.col("rows")).otherwise(0)).alias("times"),
        F.sum(F.when(numeric, F.col("rows")).otherwise(0)).alias("numeric_dates"),
        F.sum("month_votes").alias("month_votes"),
        F.sum("day_votes").alias("day_votes"),
    )
    order = (
        F.when(F.col("month_votes") > F.col("day_votes"), "month")
        .when(F.col("month_votes") < F.col("day_votes"), "day")
        .otherwise(default_order)
    )
    decided = (F.col("numeric_dates") == 0) | (F.col("month_votes") != F.col("day_votes"))
    return sums.withColumns({"date_order": order, "decided": decided})


def layout_of(shape: str, order: str) -> Layout:
    """Gate and datetime pattern of a shape whose numeric dates have one order."""
    gate = "".join(_TOKEN_REGEX.get(char, re.escape(char)) for char in shape)
    whole = re.match(TIME_SHAPE, shape)
    start, end = whole.span(1) if whole.group(1) else whole.span(2)
    date = shape[start:end]
    if re.fullmatch(_NUMERIC_DATE, date):
        fields = iter(("M", "d", "yy") if order == "month" else ("d", "M", "yy"))
    elif date.startswith("Y"):
        fields = iter(("d",) if "B" in date else ("M", "d"))
    else:
        fields = iter(("d", "yy"))
    clock = iter(("h" if "P" in shape else "H", "m", "s"))
    named = {"Y": "yyyy", "B": "MMM", "P": "a", "Z": "xx", "t": "'T'"}
    pattern = ""
    for at, char in enumerate(shape):
        if char == "N":
            pattern += next(fields if start <= at < end else clock)
        else:
            pattern += named.get(char, char)
    return Layout(f"^{gate}$", pattern)


def column_layouts(
    table: DataFrame, columns: Sequence[str], default_order: str = "month"
) -> dict[str, ColumnTimes]:
    """Layouts for ``parse_timestamp``, ``map_fields`` and ``ingest`` of each text column.

    With these a column never mixes both orders: numeric dates that the column's order cannot read
    are no times. Two-digit years are years 2000 to 2099. Columns without times get no layouts and
    null columns none either. What travels to the driver is bounded by the grammar of shapes.
    """
    counted = stored(time_shapes(table, columns))
    orders = {row["column"]: row for row in time_orders(counted, default_order).collect()}
    found = counted.filter("shape IS NOT NULL").orderBy(F.desc("rows"), "shape").collect()
    out = {}
    for name in columns:
        order, decided = (orders[name]["date_order"], orders[name]["decided"]) if name in orders else (default_order, True)
        own = tuple(layout_of(row["shape"], order) for row in found if row["column"] == name)
        out[name] = ColumnTimes(own, order, decided)
    return out
