"""Access log against per-key address allowlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.addresses import (
    address_hex,
    address_zone,
    allowlist_ranges,
    digit_bit,
    digit_rules,
    in_ranges,
)
from logloom.functions.literals import strip
from logloom.session import broadcast_if_small, stored

# Longer allowlists are not carried along with every access but joined entry by entry.
LISTED_RANGES = 64


def check_allowlists(
    access: DataFrame,
    keys: DataFrame,
    key: str,
    address: str = "ip",
    allowlist: str = "allowed_ips",
    listed_ranges: int = LISTED_RANGES,
) -> DataFrame:
    """Adds ``allowed``. A blank list allows all; unknown or bad addresses and keys are rejected.

    Each allowlist is parsed once, on the side of the keys, into an array of ranges, so the
    join neither multiplies rows nor needs an aggregation afterwards.  Keys beyond the
    broadcast limits are joined by shuffle, where adaptive execution splits hot keys.

    Of keys with more than ``listed_ranges`` ranges only a mark travels that way; their
    accesses are looked up in a table of entries (``_long_list_hits``).
    """
    blank = F.coalesce(strip(F.col(allowlist)) == "", F.lit(True))
    rules = keys.select(
        key, blank.alias("_open"), allowlist_ranges(F.coalesce(F.col(allowlist), F.lit(""))).alias("_ranges")
    )
    located = access.withColumn("_address", address_hex(F.col(address))).withColumn(
        "_zone", address_zone(F.col(address))
    )
    is_long = F.size("_ranges") > listed_ranges
    any_long = not rules.filter(is_long).isEmpty()
    if any_long:
        long_rules = stored(rules.filter(is_long))
        nothing = F.array().cast(rules.schema["_ranges"].dataType)
        rules = rules.select(
            key, "_open", is_long.alias("_long"), F.when(is_long, nothing).otherwise(F.col("_ranges")).alias("_ranges")
        )
    joined = located.join(broadcast_if_small(rules), key, "left")
    hit = in_ranges(F.col("_address"), F.col("_zone"), F.col("_ranges"))
    if any_long:
        seen = joined.filter(F.col("_long") & F.col("_address").isNotNull()).select(key, "_address", "_zone").distinct()
        hits = _long_list_hits(seen, long_rules, key).select(
            F.col(key).alias("_hit_key"), F.col("_address").alias("_hit_address"), F.col("_zone").alias("_hit_zone")
        )
        joined = joined.join(
            hits,
            (F.col(key) == F.col("_hit_key"))
            & (F.col("_address") == F.col("_hit_address"))
            & F.col("_zone").eqNullSafe(F.col("_hit_zone")),
            "left",
        )
        hit = F.when(F.col("_long"), F.col("_hit_key").isNotNull()).otherwise(hit)
    allowed: Column = F.when(F.col("_open"), True).otherwise(F.coalesce(hit, F.lit(False)))
    marks = ("_address", "_zone", "_open", "_ranges", "_long", "_hit_key", "_hit_address", "_hit_zone")
    return joined.withColumn("allowed", allowed).drop(*marks)


def _long_list_hits(seen: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """The (key, address, zone) of ``seen`` that the key's entries allow.

    Networks become rules on leading digits, united per (key, width, head) before the join, and an
    address is looked up once for each length of head its key uses, at most 8 for IPv4 and 32 for
    IPv6.  Single addresses are looked up with their zone.  Both joins are equalities on a hash of
    the address's own digits, so one key's accesses and entries spread over all tasks.
    """
    networks = rules.select(
        key, F.inline(digit_rules(F.filter("_ranges", lambda r: r["is_network"])))
    ).groupBy(key, "width", "head").agg(F.bit_or("digits").alias("digits"))
    lengths = networks.groupBy(key, "width").agg(F.collect_set(F.length("head")).alias("_lengths"))
    probes = (
        seen.withColumn("width", F.length("_address"))
        .join(broadcast_if_small(lengths), [key, "width"])
        .select(key, "_address", "_zone", "width", F.explode("_lengths").alias("_length"))
        .withColumn("head", F.expr("substring(_address, 1, _length)"))
    )
    inside = probes.join(networks, [key, "width", "head"]).filter(
        F.col("digits").bitwiseAND(digit_bit(F.col("_address"), F.col("head"))) != 0
    )
    singles = rules.select(key, F.inline(F.filter("_ranges", lambda r: ~r["is_network"]))).select(
        key, F.col("low").alias("_single"), F.col("zone").alias("_single_zone")
    )
    same = seen.join(
        singles.distinct().withColumnRenamed(key, "_single_key"),
        (F.col(key) == F.col("_single_key"))
        & (F.col("_address") == F.col("_single"))
        & F.col("_zone").eqNullSafe(F.col("_single_zone")),
        "left_semi",
    )
    return inside.select(key, "_address", "_zone").union(same.select(key, "_address", "_zone")).distinct()
