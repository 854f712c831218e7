"""SimHash fingerprints, linked through covering masks that miss no pair within the radius."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import BROADCAST_ROWS, SEED, map_slices, shingles, stored
from logloom.llm.components import connected_components

__all__ = ["keep_one", "fingerprint", "near_links", "simhash_groups"]

BITS = 64
BLOCK = 4096


def hashes_of(pieces: list[bytes], seed: int = SEED) -> np.ndarray:
    """The XXH64 of each piece, repeats included."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(piece, seed) for piece in pieces), np.uint64, len(pieces))


def majority_bits(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; 0 without any."""
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), BLOCK):
        block = hashes[start : start + BLOCK]
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 4) -> int:
    return majority_bits(hashes_of(shingles(text, width)))


def fingerprints(documents: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) for every row; fp holds the 64 bits as a signed long."""

    def handle(batch: pa.RecordBatch) -> dict[str, object]:
        prints = np.array([fingerprint(text, width) for text in batch.column(1).to_pylist()], dtype=np.uint64)
        return {"doc_id": batch.column(0), "fp": prints.view(np.int64)}

    return map_slices(documents.select("doc_id", "text"), handle, "doc_id long, fp long")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2**(radius + 1) - 1 masks, one of which leaves out any `radius` given bits.

    Bit i carries a non-zero vector of radius + 1 bits, and mask v holds the bits whose vectors
    have an odd product with v. Any `radius` vectors are orthogonal to some v, whose mask then
    misses all of these bits: two prints that differ in them agree under the mask.
    """
    vectors = (1 << (radius + 1)) - 1
    carried = [1 + at % vectors for at in range(bits)]
    return [
        sum(1 << at for at in range(bits) if (carried[at] & v).bit_count() % 2) for v in range(1, vectors + 1)
    ]


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def chain_within(prints: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links that span the groups of prints which steps of at most `radius` bits connect."""
    left, low, high = prints.copy(), [], []
    while len(left) > 1:
        root, left, front = left[0], left[1:], left[:1]
        while len(front) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for start in range(0, len(front), 256):
                apart = np.bitwise_count(front[start : start + 256, None] ^ left[None, :])
                near |= (apart <= radius).any(axis=0)
            front, left = left[near], left[~near]
            low += [int(root)] * len(front)
            high += front.tolist()
    return low, high


def _light_links(buckets: DataFrame, radius: int) -> DataFrame:
    """Links inside buckets of bounded size; at most one per member leaves a bucket."""

    def handle(batch: pa.RecordBatch) -> dict[str, object]:
        a, b = [], []
        for members in batch.column(0):
            prints = np.asarray(members.values, dtype=np.int64).view(np.uint64)
            low, high = chain_within(np.sort(prints), radius)
            a += low
            b += high
        both = np.array([a, b], dtype=np.uint64).view(np.int64)
        return {"a": both[0], "b": both[1]}

    return map_slices(buckets, handle, "a long, b long")


def _heavy_links(entries: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Links inside buckets of any size, by midpoints instead of pairs.

    Two prints are within `radius` exactly if some midpoint is within radius // 2 of one and
    within the rest of the other. Members of a bucket differ only outside its mask, so each names
    its midpoints there, and at each midpoint all hang on the smallest: the work is linear in the
    members. For an odd radius prints name the midpoints at both distances, of which only the
    nearer half may be shared with any other.
    """
    near, far = radius // 2, radius - radius // 2
    flips = []
    for mask in masks:
        free = [at for at in range(BITS) if not mask >> at & 1]
        flips.append(
            [
                (signed(sum(1 << at for at in chosen)), size)
                for size in range(far + 1)
                for chosen in combinations(free, size)
            ]
        )
    spark = entries.sparkSession
    table = F.broadcast(
        spark.createDataFrame(
            [(t, [f[0] for f in rows], [f[1] for f in rows]) for t, rows in enumerate(flips)],
            "t int, flip array<long>, size array<int>",
        )
    )
    named = entries.join(table, "t").select(
        "t", "key", "fp", F.explode(F.arrays_zip("flip", "size")).alias("flip")
    )
    named = named.select("t", "key", "fp", F.col("fp").bitwiseXOR(F.col("flip.flip")).alias("mid"), "flip.size")
    lowest = named.where(F.col("size") <= near).groupBy("t", "key", "mid").agg(F.min("fp").alias("b"))
    return named.join(lowest, ["t", "key", "mid"]).select(F.col("fp").alias("a"), "b").where("a != b").distinct()


def near_links(prints: DataFrame, radius: int = 4, bucket_rows: int = 4096) -> DataFrame:
    """Links (a, b) that connect all distinct prints `fp` within `radius` bits, directly or by steps.

    Every print goes into one bucket per covering mask. Buckets of up to `bucket_rows` are
    compared in blocks; larger ones use midpoints. No bucket is dropped and no pairs are listed.
    """
    masks = covering_masks(radius)
    entries = prints.select(
        "fp",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("key"))
                    for t, mask in enumerate(masks)
                ]
            )
        ).alias("entry"),
    ).select("entry.t", "entry.key", "fp")
    heavy = stored(entries.groupBy("t", "key").count().where(F.col("count") > bucket_rows).select("t", "key"))
    n_heavy = heavy.count()
    light = entries
    if n_heavy:
        marked = F.broadcast(heavy) if n_heavy <= BROADCAST_ROWS else heavy
        light = entries.join(marked, ["t", "key"], "left_anti")
    buckets = (
        light.groupBy("t", "key")
        .agg(F.collect_list("fp").alias("members"))
        .where(F.size("members") > 1)
        .select("members")
    )
    links = _light_links(buckets, radius)
    if n_heavy:
        links = links.unionByName(_heavy_links(entries.join(marked, ["t", "key"]), masks, radius))
    return links


def rooted_prints(prints: DataFrame, radius: int, bucket_rows: int) -> DataFrame:
    """(fp, root) of all distinct prints; prints have one root if links within `radius` connect them."""
    joined = connected_components(near_links(prints, radius, bucket_rows)).withColumnRenamed("node", "fp")
    return prints.join(joined, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"))


def simhash_groups(documents: DataFrame, width: int = 4, radius: int = 4, bucket_rows: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `documents`.

    Documents link when their fingerprints differ in at most `radius` bits; component_id is the
    smallest doc_id reachable. Null, empty and blank texts have fingerprint 0 and link like any
    other. A row with a null id takes part and gets its group's smallest id, null if none has one.
    Equal fingerprints are one node, so copies are never compared. An empty table gives no rows.
    """
    printed = stored(fingerprints(documents, width))
    classes = stored(printed.groupBy("fp").agg(F.min("doc_id").alias("first")))
    rooted = stored(classes.join(rooted_prints(classes.select("fp"), radius, bucket_rows), "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return printed.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(documents: DataFrame, block_rows: int = 256) -> DataFrame:
    """One row of each group of near copies, see :func:`logloom.llm.near_copies.keep_one`."""
    from logloom.llm.near_copies import keep_one as keep  # which takes its groups from here

    return keep(documents, block_rows)
