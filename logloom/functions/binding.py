"""Small expression helpers shared by the column builders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP_SEPARATOR = "\x01"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it many times, which also keeps generated code small."""
    return F.transform(F.array(value), body)[0]


def capture_groups(text: Column, regex: str, numbers: Sequence[int]) -> Column:
    """Array of the chosen groups after one leading empty element, from a single regex run.

    ``regex`` must span the whole text.  Without a match the array has exactly one element,
    so ``size(groups) > 1`` is the match test.  Text holding the separator itself takes the
    slower one-run-per-group way.
    """
    template = GROUP_SEPARATOR + GROUP_SEPARATOR.join(f"${number}" for number in numbers)
    one_by_one = F.array(F.lit(""), *[F.regexp_extract(text, regex, number) for number in numbers])
    return F.when(
        text.contains(GROUP_SEPARATOR), F.when(text.rlike(regex), one_by_one).otherwise(F.array(text))
    ).otherwise(F.split(F.regexp_replace(text, regex, template), GROUP_SEPARATOR, -1))


def with_parsed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add an expensive column that later filters cannot push down and evaluate again.

    A filter on a plain projected column is rewritten over the parsing expression itself,
    once per reference; it does not move through a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
