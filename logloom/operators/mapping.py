"""The mapping step: file name, exclude, rename, timestamp, coerce — as one projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.coercion import coerce
from logloom.functions.timestamps import DEFAULT_LAYOUTS, Layout, format_utc, parse_timestamp
from logloom.session import quoted

TIMESTAMP_FIELD = "@timestamp"
DEFAULT_FILENAME_FIELD = "source_file"

_Typed = tuple[Column, T.DataType]


def map_fields(
    records: DataFrame,
    mappings: Mapping[str, str] | None = None,
    excluded: Sequence[str] = (),
    timestamp_field: str | None = None,
    field_types: Mapping[str, str] | None = None,
    filename_field: str | None = None,
    filename: Column | None = None,
    passthrough: Sequence[str] = (),
    layouts: tuple[Layout, ...] = DEFAULT_LAYOUTS,
    default_year: int | None = None,
) -> DataFrame:
    """Rename, drop, normalise and coerce the data columns of ``records``.

    ``passthrough`` columns are bookkeeping: kept as they are at the end.  The timestamp is
    read from the original value even when its field is excluded; if it cannot be read the
    original value stays.  When two fields get one name the later one wins.
    """
    mappings, field_types = mappings or {}, field_types or {}
    source: dict[str, _Typed] = {
        field.name: (quoted(field.name), field.dataType)
        for field in records.schema.fields
        if field.name not in passthrough
    }
    if filename_field:
        source[filename_field] = (filename if filename is not None else F.lit(None).cast("string"), T.StringType())
    result: dict[str, _Typed] = {}
    for name, typed in source.items():
        if name not in excluded:
            result[mappings.get(name, name)] = typed
    if timestamp_field is not None and timestamp_field in source:
        _apply_timestamp(result, source, mappings, timestamp_field, layouts, default_year)
    for name, target in field_types.items():
        mapped = mappings.get(name, name)
        if mapped in result:
            result[mapped] = coerce(*result[mapped], target)
    return records.select(
        *[value.alias(name) for name, (value, _) in result.items()], *[quoted(name) for name in passthrough]
    )


def _apply_timestamp(
    result: dict[str, _Typed],
    source: Mapping[str, _Typed],
    mappings: Mapping[str, str],
    field: str,
    layouts: tuple[Layout, ...],
    default_year: int | None,
) -> None:
    value, data_type = source[field]
    parsed = format_utc(parse_timestamp(value, data_type, layouts, default_year))

    def over(previous: _Typed | None) -> _Typed:
        if previous is None:
            return parsed, T.StringType()
        return F.coalesce(parsed, coerce(*previous, "string")[0]), T.StringType()

    mapped = mappings.get(field, field)
    result[TIMESTAMP_FIELD] = over(result.get(TIMESTAMP_FIELD))
    if mapped in result and mapped != TIMESTAMP_FIELD:
        result[mapped] = over(result[mapped])
