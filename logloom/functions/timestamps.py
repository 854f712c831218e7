"""Timestamp normalisation to UTC with second precision.

Branch order matters and is part of the semantics: numbers and all-digit text are always
epochs (so '20240115' is a second count, not a date), then the web-server layout, then
ISO-8601, then a closed list of other layouts.  Everything else is null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.binding import bind
from logloom.functions.literals import strip

# Epochs above this many seconds (2100-01-01) are read as milliseconds.
MILLISECOND_THRESHOLD = 4102444800
# Range of representable years 1..9999 in epoch seconds.
MIN_EPOCH, MAX_EPOCH = -62135596800, 253402300799

OUTPUT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"

WEB_SERVER_PREFIX = r"^(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4})"
# Forms the engine's own cast reads; the common case stays one check and one cast.
STRICT_ISO = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?)?(?:Z|[+-][0-9]{2}:[0-9]{2})?$"
)
ISO_TEXT = (
    r"^([0-9]{4}-[0-9]{2}-[0-9]{2})"
    r"(?:[T ]([0-9]{2}:[0-9]{2}(?::[0-9]{2})?)(?:[.,]([0-9]+))?)?"
    r"\s*(Z|z|UTC|GMT|[+-][0-9]{2}(?::?[0-9]{2})?)?$"
)


@dataclass(frozen=True)
class Layout:
    """One extra layout: a gate on the cleaned text and a Spark datetime pattern for it."""

    gate: str
    pattern: str


_TIME = r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?"
_CLOCK = "H:mm[:ss]"
MONTH = r"(?i:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"

# The text is cleaned before these apply: weekday and fraction dropped, month names cut to
# three letters, white space collapsed.  First parsable layout wins, so month-first comes
# before day-first for slashed dates.
DEFAULT_LAYOUTS: tuple[Layout, ...] = (
    Layout(rf"^[0-9]{{1,2}} {MONTH} [0-9]{{4}}(?: {_TIME})?$", f"d MMM yyyy[ {_CLOCK}]"),
    Layout(rf"^[0-9]{{1,2}} {MONTH} [0-9]{{4}} {_TIME} [+-][0-9]{{4}}$", f"d MMM yyyy {_CLOCK} xx"),
    Layout(rf"^[0-9]{{1,2}}-{MONTH}-[0-9]{{4}}(?: {_TIME})?$", f"d-MMM-yyyy[ {_CLOCK}]"),
    Layout(rf"^{MONTH} [0-9]{{1,2}},? [0-9]{{4}}(?: {_TIME})?$", f"MMM d[,] yyyy[ {_CLOCK}]"),
    Layout(rf"^{MONTH} [0-9]{{1,2}} {_TIME} [0-9]{{4}}$", f"MMM d {_CLOCK} yyyy"),
    Layout(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
    Layout(rf"^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}} {_TIME}$", f"M/d/yyyy {_CLOCK}"),
    Layout(rf"^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}} {_TIME} (?i:am|pm)$", "M/d/yyyy h:mm[:ss] a"),
    Layout(rf"^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}(?: {_TIME})?$", f"d/M/yyyy[ {_CLOCK}]"),
    Layout(rf"^[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}(?: {_TIME})?$", f"yyyy/M/d[ {_CLOCK}]"),
    Layout(rf"^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}(?: {_TIME})?$", f"yyyy-M-d[ {_CLOCK}]"),
    Layout(r"^[0-9]{8}T[0-9]{6}$", "yyyyMMdd'T'HHmmss"),
)
YEARLESS_LAYOUT = Layout(rf"^{MONTH} [0-9]{{1,2}} {_TIME}$", f"yyyy MMM d {_CLOCK}")


def from_epoch(value: Column) -> Column:
    """Timestamp of a numeric epoch in seconds, or milliseconds when beyond the threshold."""
    seconds = F.floor(F.when(value > MILLISECOND_THRESHOLD, value / 1000).otherwise(value))
    in_range = seconds.between(MIN_EPOCH, MAX_EPOCH) & ~F.isnan(value.cast("double"))
    return F.when(in_range, F.timestamp_seconds(F.when(in_range, seconds)))


def _from_digit_text(text: Column) -> Column:
    # 17 digits of milliseconds are beyond year 9999, so a bounded cast loses nothing.
    digits = F.regexp_replace(text, "^0+(?=[0-9])", "")
    return F.when(F.length(digits) <= 17, from_epoch(digits.try_cast("bigint")))


def _from_web_server(text: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(text, WEB_SERVER_PREFIX, 1), F.lit("dd/MMM/yyyy:HH:mm:ss Z"))


def _from_iso(text: Column) -> Column:
    date = F.regexp_extract(text, ISO_TEXT, 1)
    clock = F.regexp_extract(text, ISO_TEXT, 2)
    zone = F.regexp_replace(
        F.upper(F.regexp_extract(text, ISO_TEXT, 4)), r"^([+-][0-9]{2}):?([0-9]{2})?$", "$1:$2"
    )
    zone = F.when(zone.endswith(":"), F.concat(zone, F.lit("00"))).otherwise(zone)
    clock = F.when(clock == "", F.lit("00:00")).otherwise(clock)
    return F.concat(date, F.lit("T"), clock, zone).try_cast("timestamp")


def clean_time_text(text: Column) -> Column:
    text = F.regexp_replace(text, r"\s+", " ")
    text = F.regexp_replace(
        text, r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)(?:[a-z]*day|s|nes|rs|ur)?,? ", ""
    )
    text = F.regexp_replace(
        text,
        r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
        r"(?:uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)?\b\.?",
        "$1",
    )
    text = F.regexp_replace(text, r"(:[0-9]{2}:[0-9]{2})[.,][0-9]+", "$1")
    text = F.regexp_replace(text, r" (?:Z|[A-Z]{3,4})(?= [0-9]{4}$|$)(?<! AM| PM)", "")
    return F.regexp_replace(text, r"([0-9]) ([+-][0-9]{2}):([0-9]{2})$", "$1 $2$3")


def _from_layouts(cleaned: Column, layouts: tuple[Layout, ...], default_year: int | None) -> Column:
    branches = [F.lit(None).cast("timestamp")] + [
        F.when(cleaned.rlike(layout.gate), F.try_to_timestamp(cleaned, F.lit(layout.pattern)))
        for layout in layouts
    ]
    if default_year is not None:
        dated = F.concat(F.lit(f"{default_year:04d} "), cleaned)
        branches.append(
            F.when(cleaned.rlike(YEARLESS_LAYOUT.gate), F.try_to_timestamp(dated, F.lit(YEARLESS_LAYOUT.pattern)))
        )
    return F.coalesce(*branches)


def from_text(
    text: Column,
    layouts: tuple[Layout, ...] = DEFAULT_LAYOUTS,
    default_year: int | None = None,
) -> Column:
    text = strip(text)
    other = bind(clean_time_text(text), lambda cleaned: _from_layouts(cleaned, layouts, default_year))
    return (
        F.when(text == "", F.lit(None).cast("timestamp"))
        .when(text.rlike(STRICT_ISO), text.try_cast("timestamp"))
        .when(text.rlike("^[0-9]+$"), _from_digit_text(text))
        .when(text.rlike(WEB_SERVER_PREFIX), _from_web_server(text))
        .when(text.rlike(ISO_TEXT), bind(text, _from_iso))
        .otherwise(other)
    )


def parse_timestamp(
    value: Column,
    data_type: T.DataType,
    layouts: tuple[Layout, ...] = DEFAULT_LAYOUTS,
    default_year: int | None = None,
) -> Column:
    """UTC TIMESTAMP of a column of any type, null when it cannot be read as a time."""
    if isinstance(data_type, T.BooleanType):
        return from_epoch(value.cast("int"))
    if isinstance(data_type, T.NumericType):
        return from_epoch(value)
    if isinstance(data_type, T.StringType):
        return F.date_trunc("second", from_text(value, layouts, default_year))
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.date_trunc("second", value.cast("timestamp"))
    return F.lit(None).cast("timestamp")


def format_utc(moment: Column) -> Column:
    return F.date_format(moment, OUTPUT_FORMAT)
