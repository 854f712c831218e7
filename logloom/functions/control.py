"""Decoding of JSON text columns in the control tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.binding import bind


def filename_list(text: Column) -> Column:
    """File names from a JSON list, or a single plain name from older rows."""
    parsed = F.from_json(text, "array<string>")
    is_list = F.ltrim(text).startswith("[") & parsed.isNotNull()
    return F.when(text.isNull() | (text == ""), F.lit(None)).when(is_list, parsed).otherwise(F.array(text))


def filename_display(text: Column) -> Column:
    return bind(filename_list(text), lambda names: F.array_join(names, ", "))


def mapping_column(text: Column) -> Column:
    """JSON object text to a map; bad JSON gives an empty map."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.when(text.isNotNull() & (text != ""), F.coalesce(F.from_json(text, "map<string,string>"), empty))


def list_column(text: Column) -> Column:
    """JSON list text to an array; bad JSON gives an empty array."""
    empty = F.array().cast("array<string>")
    return F.when(text.isNotNull() & (text != ""), F.coalesce(F.from_json(text, "array<string>"), empty))
