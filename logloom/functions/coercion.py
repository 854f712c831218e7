"""Value coercion to the four user-selectable types; failures become null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.binding import bind
from logloom.functions.literals import float_from_text, strip

# The words accepted for booleans.
TRUE_WORDS = ("true", "1", "yes", "on")
FALSE_WORDS = ("false", "0", "no", "off")

TARGET_TYPES = ("integer", "float", "boolean", "string")


def _is_nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StructType, T.ArrayType, T.MapType, T.VariantType))


def _as_double(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.BooleanType):
        return value.cast("int").cast("double")
    if isinstance(data_type, T.NumericType):
        return value.cast("double")
    if isinstance(data_type, T.StringType):
        return float_from_text(value)
    return F.lit(None).cast("double")


def to_integer(value: Column, data_type: T.DataType) -> Column:
    """Truncate towards zero; text goes through a float first, so '1.9' gives 1."""

    def truncate(number: Column) -> Column:
        # 2^63 itself would be saturated to the largest long
        return F.when((number >= -(2.0**63)) & (number < 2.0**63), number.try_cast("bigint"))

    return bind(_as_double(value, data_type), truncate)


def to_float(value: Column, data_type: T.DataType) -> Column:
    return _as_double(value, data_type)


def to_boolean(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.BooleanType):
        return value
    if isinstance(data_type, T.NumericType):
        return value != 0
    if _is_nested(data_type):
        return F.lit(None).cast("boolean")
    word = F.lower(strip(value.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def to_text(value: Column, data_type: T.DataType) -> Column:
    return F.to_json(value) if _is_nested(data_type) else value.cast("string")


def coerce(value: Column, data_type: T.DataType, target: str) -> tuple[Column, T.DataType]:
    """Coerced column and its type. An unknown target keeps the value; '' is null for all."""
    if isinstance(data_type, T.StringType):
        value = F.nullif(value, F.lit(""))
    if target == "integer":
        return to_integer(value, data_type), T.LongType()
    if target == "float":
        return to_float(value, data_type), T.DoubleType()
    if target == "boolean":
        return to_boolean(value, data_type), T.BooleanType()
    if target == "string":
        return to_text(value, data_type), T.StringType()
    return value, data_type
