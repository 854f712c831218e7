"""Line formats as column expressions: text in, map / struct / array out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.binding import bind, capture_groups
from logloom.functions.literals import strip

WIDE_GAP = r"\s{2,}"

# Line layouts of the two syslog generations and of logfmt pairs.
SYSLOG_5424 = r"^<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(?:\[.*?\]\s*)?(.*)$"
SYSLOG_3164 = r"^<(\d+)>(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?):\s*(.*)$"
LOGFMT_PAIR = r"""[\p{L}\p{N}_]+=(?:"[^"]*"|'[^']*'|\S+)"""

SYSLOG_5424_FIELDS = (
    "priority", "version", "timestamp", "hostname", "app_name", "proc_id", "msg_id", "message",
)
SYSLOG_3164_FIELDS = ("priority", "timestamp", "hostname", "app_name", "message")


# Marks put around the pairs found in a line; lines that hold one take the exact slower way.
_PAIR_MARK, _VALUE_MARK = "\x02", "\x01"
_LTSV_CELL = r"(?<=^|\t)([^:\t]*):([^\t]*)"
_PADDED_MARK = r"(?U)\s*([\x01\x02])\s*"
_LOGFMT_GROUPS = r"""(?U)([\p{L}\p{N}_]+)=(?:"([^"]*)"|'([^']*)'|(\S+))"""


def _pair_arrays(marked: Column, empty_is_null: bool) -> Column:
    """Parallel arrays of the marked pairs, last pair first; null when there is none."""

    def value_of(pair: Column) -> Column:
        value = F.substring_index(pair, _VALUE_MARK, -1)
        return F.nullif(value, F.lit("")) if empty_is_null else value

    def to_arrays(pairs: Column) -> Column:
        keys = F.transform(pairs, lambda pair: F.substring_index(pair, _VALUE_MARK, 1))
        return F.when(F.size(pairs) > 0, F.struct(keys.alias("keys"), F.transform(pairs, value_of).alias("values")))

    pairs = F.filter(F.split(marked, _PAIR_MARK, -1), lambda part: part.contains(_VALUE_MARK))
    return bind(F.reverse(pairs), to_arrays)


def pair_value(pairs: Column, key: str) -> Column:
    """Last value of a key, null when it is missing."""
    at = F.array_position(pairs["keys"], F.lit(key))
    return F.when(at > 0, F.get(pairs["values"], (at - 1).cast("int")))


def pairs_to_map(pairs: Column) -> Column:
    """Map with keys in order of first appearance and their last values."""

    def to_map(arrays: Column) -> Column:
        keys = F.array_distinct(F.reverse(arrays["keys"]))
        latest = F.transform(
            keys, lambda key: F.get(arrays["values"], (F.array_position(arrays["keys"], key) - 1).cast("int"))
        )
        simple = F.map_from_arrays(F.reverse(arrays["keys"]), F.reverse(arrays["values"]))
        return F.when(F.size(keys) == F.size(arrays["keys"]), simple).otherwise(F.map_from_arrays(keys, latest))

    return F.when(pairs.isNotNull(), bind(pairs, to_map))


def _mark(line: Column, regex: str, groups: str) -> Column:
    return F.regexp_replace(line, regex, f"{_PAIR_MARK}$1{_VALUE_MARK}{groups}{_PAIR_MARK}")


def _one_by_one(line: Column, regex: str, groups: Sequence[int], trim: bool, empty_is_null: bool) -> Column:
    """The same arrays by one regex run per group, for lines that hold a mark themselves."""

    def found(group: int) -> Column:
        texts = F.regexp_extract_all(line, F.lit(regex), F.lit(group))
        return F.reverse(F.transform(texts, strip) if trim else texts)

    values = found(groups[0])
    for group in groups[1:]:
        # only one of the groups took part in a pair, the others are empty
        values = F.zip_with(values, found(group), lambda one, other: F.concat(one, other))
    if empty_is_null:
        values = F.transform(values, lambda value: F.nullif(value, F.lit("")))
    pairs = F.struct(found(1).alias("keys"), values.alias("values"))
    return F.when(F.size(found(1)) > 0, pairs)


def _marked(line: Column) -> Column:
    return line.contains(_PAIR_MARK) | line.contains(_VALUE_MARK)


def ltsv_pairs(line: Column) -> Column:
    """label:value pairs; null for a line without any pair."""
    text = strip(line)
    tabbed = F.when(text.contains("\t"), text).otherwise(F.regexp_replace(text, WIDE_GAP, "\t"))
    trimmed = F.regexp_replace(_mark(tabbed, _LTSV_CELL, "$2"), _PADDED_MARK, "$1")
    exact = _one_by_one(tabbed, _LTSV_CELL, [2], trim=True, empty_is_null=False)
    return F.when(_marked(text), exact).otherwise(_pair_arrays(trimmed, empty_is_null=False))


def logfmt_pairs(line: Column) -> Column:
    """key=value pairs, values bare or quoted; null for a line without any pair."""
    exact = _one_by_one(line, _LOGFMT_GROUPS, [2, 3, 4], trim=False, empty_is_null=True)
    return F.when(_marked(line), exact).otherwise(
        _pair_arrays(_mark(line, _LOGFMT_GROUPS, "$2$3$4"), empty_is_null=True)
    )


def syslog_record(line: Column) -> Column:
    """Struct of the syslog fields: RFC 5424, then RFC 3164, then the whole line as message."""
    text = strip(line)
    newer = capture_groups(text, "(?dU)" + SYSLOG_5424, range(1, len(SYSLOG_5424_FIELDS) + 1))
    older = capture_groups(text, "(?dU)" + SYSLOG_3164, range(1, len(SYSLOG_3164_FIELDS) + 1))

    def to_record(groups: Column) -> Column:
        def pick(order: tuple[str, ...], name: str) -> Column:
            return F.get(groups, F.lit(order.index(name) + 1)) if name in order else F.lit(None).cast("string")

        is_newer = F.size(groups) == len(SYSLOG_5424_FIELDS) + 1
        is_older = F.size(groups) == len(SYSLOG_3164_FIELDS) + 1
        columns = []
        for name in SYSLOG_5424_FIELDS:
            value = F.when(is_newer, pick(SYSLOG_5424_FIELDS, name)).when(is_older, pick(SYSLOG_3164_FIELDS, name))
            if name == "message":
                value = value.otherwise(F.get(groups, F.lit(0)))
            columns.append(value.alias(name))
        return F.struct(*columns)

    either = bind(newer, lambda groups: F.when(F.size(groups) > 1, groups).otherwise(older))
    return bind(either, to_record)


def spaced_cells(line: Column) -> Column:
    """Cells of a row whose columns are two or more blanks apart."""
    return F.split(strip(line), WIDE_GAP, -1)
