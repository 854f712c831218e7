"""Queries over the sample tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from logloom.session import spread

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Workload:
    build: Build
    sql: str | None


REGISTRY: dict[str, Workload] = {}


def workload(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        REGISTRY[name] = Workload(build, sql)
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """A table about to be parsed row by row, over all cores even when it is a single split."""
    return spread(table(spark, folder, name), key)


def load_all() -> dict[str, Workload]:
    from logloom.workloads import control, files, formats, guards, patterns, profiles  # noqa: F401

    return REGISTRY
