"""Connected components of very large graphs by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import stored


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _hooked(edges: DataFrame, with_self: bool) -> DataFrame:
    """Hang the neighbours `b` of each `a` (and `a` itself) on the smallest of them."""
    lowest = edges.groupBy("a").agg(F.min("b").alias("low"))
    if not with_self:
        lowest = lowest.withColumn("low", F.least("a", "low"))
    hung = edges.join(lowest, "a")
    if with_self:
        ends = hung.select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
    else:
        ends = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return ends.where(F.col("a") > F.col("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in `edges` (a, b); component is the smallest node reachable.

    Each round hangs a node's larger neighbours on its smallest neighbour, then its smaller ones;
    the number of rounds grows with the logarithm of the number of nodes. Minima are combined
    before the shuffle and rounds are written to the shared folder; nothing passes the driver but
    a checksum. Null ends and loops are left out.
    """
    now = stored(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = _signature(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        now = stored(_hooked(_hooked(both, False), True))
        after = _signature(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
