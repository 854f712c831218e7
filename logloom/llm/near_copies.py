"""One row of each group of near copies: candidates by SimHash and min-wise prints, each link confirmed exactly."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import SEED, broadcast_checked, map_slices, shingles, stored
from logloom.llm.components import connected_components
from logloom.llm.simhash import hashes_of, majority_bits, rooted_prints

WIDTH = 5
#: bits in which two SimHash fingerprints of a group may differ
RADIUS = 4
#: a pair with similarity s shares none of the keys with probability (1 - s**BAND_ROWS) ** BANDS: 0.00022 at 0.8
BANDS, BAND_ROWS = 16, 4
BLOCK = 4096
BLOCK_SHINGLES = 1 << 20
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    return np.unique(hashes_of(shingles(text, width)))


def set_key(values: np.ndarray) -> int:
    """One number for equal sets; 0 for texts without words."""
    return xxhash.xxh64_intdigest(values.tobytes(), SEED) if len(values) else 0


def band_keys(values: np.ndarray) -> np.ndarray:
    """BANDS keys, each of BAND_ROWS independent minima; two sets share a minimum with their Jaccard similarity."""
    if not len(values):
        return np.zeros(0, dtype=np.uint64)
    lowest = np.full(len(FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(values), BLOCK):
        np.minimum(lowest, (FACTORS[:, None] * values[None, start : start + BLOCK]).min(axis=1), out=lowest)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(own.tobytes(), SEED) for own in lowest.reshape(BANDS, BAND_ROWS)], dtype=np.uint64)


def close_pairs(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of 0.8 or more, in whole numbers."""
    sizes = np.array([len(one) for one in sets], dtype=np.int64)
    rows = np.repeat(np.arange(len(sets)), sizes)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[column] > 1
    rows, column = rows[shared], (np.cumsum(held > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, BLOCK):
        low, high = np.searchsorted(column, [start, start + BLOCK])
        holds = np.zeros((len(sets), min(BLOCK, int(column[-1]) + 1 - start)), dtype=np.float32)
        holds[rows[low:high], column[low:high] - start] = 1
        common += (holds @ holds.T).astype(np.int64)
    # common / (a + b - common) >= 4 / 5
    return 9 * common >= 4 * (sizes[:, None] + sizes[None, :])


def spanning_links(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the symmetric matrix `near` connects, one for each row but the first of a group."""
    left, links = np.ones(len(near), dtype=bool), []
    for root in range(len(near)):
        front = [root] if left[root] else []
        left[root] = False
        while front:
            at = front.pop()
            found = np.flatnonzero(near[at] & left)
            left[found] = False
            links += [(at, int(other)) for other in found]
            front += found.tolist()
    return links


def _confirmed(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect all close pairs inside each `part` of `groups` (bucket, part, node)."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node")
        nodes = rows["node"].to_numpy(np.int64)
        links = spanning_links(close_pairs([np.frombuffer(one, np.uint64) for one in rows["shingles"]]))
        a, b = np.array(links, dtype=np.int64).reshape(-1, 2).T
        return pd.DataFrame({"a": nodes[a], "b": nodes[b]})

    return groups.join(sets, "node").groupBy("bucket", "part").applyInPandas(compare, "a long, b long").distinct()


def _blocks(block_rows: int, rows: Column, shingles_in: Column) -> Column:
    """Number of blocks for so many rows with so many shingles in all; bounds a block's memory."""
    needed = F.greatest(F.ceil(rows / block_rows), F.ceil(shingles_in / BLOCK_SHINGLES), F.lit(1))
    return needed.cast("int")


def _first_parts(members: DataFrame, buckets: DataFrame, block_rows: int) -> DataFrame:
    """Every bucket's members in blocks, with its smallest member in each of them."""
    blocks = _blocks(block_rows, F.col("rows"), F.col("shingles_in"))
    own = members.join(buckets.select("bucket", blocks.alias("blocks")), "bucket").select(
        "bucket", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("part"), "node"
    )
    centres = buckets.select(
        "bucket", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("part"), F.col("centre").alias("node")
    )
    return own.unionByName(centres)


def _cross_parts(members: DataFrame, buckets: DataFrame, links: DataFrame, block_rows: int) -> DataFrame:
    """The pairs of blocks that remain in buckets of several blocks whose members aren't all linked.

    The members of a bucket's largest group are connected already, so only pairs of blocks with
    others in one of them are left: `low` blocks of the group come first, and no two of them meet.
    """
    wide = members.join(
        buckets.where(_blocks(block_rows, F.col("rows"), F.col("shingles_in")) > 1).select("bucket"), "bucket"
    )
    groups = connected_components(links)
    placed = stored(
        wide.join(groups, "node", "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("group"))
    )
    largest = (
        placed.groupBy("bucket", "group")
        .agg(F.count("*").alias("rows"))
        .groupBy("bucket")
        .agg(F.max(F.struct("rows", "group"))["group"].alias("largest"), F.count("*").alias("groups"))
        .where("groups > 1")
    )
    split = placed.join(largest, "bucket").withColumn("other", F.col("group") != F.col("largest"))

    def blocks(other: bool) -> Column:
        mine = F.col("other") == F.lit(other)
        return _blocks(block_rows, F.count_if(mine), F.coalesce(F.sum(F.when(mine, F.col("n"))), F.lit(0)))

    counts = split.groupBy("bucket").agg(blocks(False).alias("low"), blocks(True).alias("high"))
    at = F.when(F.col("other"), F.col("low") + F.pmod(F.xxhash64("node"), "high")).otherwise(
        F.pmod(F.xxhash64("node"), "low")
    )
    dealt = split.join(counts, "bucket").withColumn("at", at.cast("int"))
    last = F.col("low") + F.col("high") - 1
    above = F.transform(F.sequence(F.greatest("at", "low"), last), lambda j: F.struct(F.col("at").alias("i"), j.alias("j")))
    below = F.transform(F.sequence(F.lit(0), F.col("at") - 1), lambda i: F.struct(i.alias("i"), F.col("at").alias("j")))
    pairs = F.when(F.col("other"), F.concat(above, below)).otherwise(above)
    part = F.explode(pairs).alias("pair")
    return dealt.select("bucket", part, "node").select(
        "bucket", (F.col("pair.i").cast("long") * F.lit(1 << 31) + F.col("pair.j")).alias("part"), "node"
    )


def printed_sets(documents: DataFrame) -> DataFrame:
    """(doc_id, row_hash, fp, node, n, bands) for every row: SimHash fingerprint, shingle set's key, size and band keys."""

    def handle(batch: pa.RecordBatch) -> dict[str, object]:
        hashes = [hashes_of(shingles(text, WIDTH)) for text in batch.column(2).to_pylist()]
        sets = [np.unique(one) for one in hashes]
        return {
            "doc_id": batch.column(0),
            "row_hash": batch.column(1),
            "fp": np.array([majority_bits(one) for one in hashes], dtype=np.uint64).view(np.int64),
            "node": np.array([set_key(one) for one in sets], dtype=np.uint64).view(np.int64),
            "n": np.array([len(one) for one in sets], dtype=np.int64),
            "bands": [band_keys(one).view(np.int64) for one in sets],
        }

    narrow = documents.select("doc_id", row_hash(documents).alias("row_hash"), "text")
    return map_slices(narrow, handle, "doc_id long, row_hash long, fp long, node long, n long, bands array<long>")


def row_hash(documents: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{name}`") for name in documents.columns])


def rows_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of `documents` that `wanted` (__id, __hash, ...) names, with its columns."""
    return documents.join(
        wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (row_hash(documents) == F.col("__hash"))
    )


def _sets_of(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the texts that `nodes` (__id, __hash) names; the hashes as bytes."""

    def handle(batch: pa.RecordBatch) -> dict[str, object]:
        sets = [shingle_set(text) for text in batch.column(0).to_pylist()]
        keys = np.array([set_key(one) for one in sets], dtype=np.uint64).view(np.int64)
        return {"node": keys, "shingles": [one.tobytes() for one in sets]}

    texts = rows_of(documents, nodes).select("text")
    return map_slices(texts, handle, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _simhash_entries(printed: DataFrame) -> DataFrame:
    """(node, n, t, key) with the SimHash group of each node as its key.

    Groups are what fingerprints within RADIUS bits connect. A node has a key for each fingerprint
    of its texts, which may hold the same shingles in other numbers.
    """
    prints = stored(printed.where("n > 0").select("node", "n", "fp").distinct())
    rooted = rooted_prints(prints.select("fp").distinct(), RADIUS, BLOCK)
    return prints.join(rooted, "fp").select("node", "n", F.lit(BANDS).alias("t"), F.col("root").alias("key")).distinct()


def near_copy_links(documents: DataFrame, printed: DataFrame, block_rows: int = 256) -> DataFrame:
    """Links (a, b) between keys of shingle sets that connect all pairs of candidates with similarity >= 0.8.

    Sets of one SimHash group or with a band key in common are candidates, and either makes a
    bucket. First each bucket's members are compared in
    blocks of about `block_rows`, its smallest member in all of them, which decides every bucket
    of one block. Where a larger bucket is not one group by then, its blocks are compared in
    pairs, but for those inside its largest group. No bucket is dropped or cut.
    """
    nodes = stored(
        printed.where("n > 0")
        .groupBy("node")
        .agg(F.min(F.struct("doc_id", "row_hash")).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    )
    banded = nodes.select("node", "n", F.posexplode("bands").alias("t", "key"))
    entries = banded.unionByName(stored(_simhash_entries(printed)))
    found = (
        entries.groupBy("t", "key")
        .agg(
            F.count("*").alias("rows"),
            F.sum("n").alias("shingles_in"),
            F.min("node").alias("centre"),
            F.bit_xor(F.xxhash64("node")).alias("content"),
        )
        .where("rows > 1")
    )
    # buckets of the same members are one
    buckets = stored(
        found.groupBy("rows", "shingles_in", "centre", "content")
        .agg(F.min(F.struct("t", "key")).alias("bucket"))
        .select("bucket.t", "bucket.key", "rows", "shingles_in", "centre")
        .withColumn("bucket", F.concat_ws("/", F.col("t").cast("string"), F.col("key").cast("string")))
    )
    members = stored(
        entries.join(buckets.select("t", "key", "bucket"), ["t", "key"]).select("bucket", "node", "n")
    )
    candidates = members.select("node").distinct().join(nodes, "node")
    wanted = stored(candidates.select(F.col("first.doc_id").alias("__id"), F.col("first.row_hash").alias("__hash")))
    sets = stored(_sets_of(documents, broadcast_checked(wanted)))
    links = stored(_confirmed(_first_parts(members, buckets, block_rows), sets))
    cross = _confirmed(_cross_parts(members, buckets, links, block_rows), sets)
    return links.unionByName(cross)


def keep_one(documents: DataFrame, block_rows: int = 256) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, null ids last.

    Near copies have five-word shingle sets with a Jaccard similarity of at least 0.8, and groups
    are what such pairs connect. Each link is confirmed on the whole sets. Candidates are the groups
    of op1's SimHash links over fingerprints of these shingles and, as at 0.8 some 10 of 64 bits differ, sets that
    share one of BANDS min-wise keys, so a pair at 0.8 is not seen with probability 0.00022, a
    closer one with less. Of several rows with the smallest id the one with the smallest row hash stays, and
    one of rows that are equal throughout. All texts without words are one group. Columns are those
    of `documents`.
    """
    printed = stored(printed_sets(documents))
    groups = connected_components(near_copy_links(documents, printed, block_rows))
    rows = printed.groupBy("node", "doc_id", "row_hash").agg(F.count("*").alias("n"))
    # the best of each node first, so that a group of many equal texts meets the join as one row
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash", "n")).alias("best")
    keepers = stored(
        rows.groupBy("node")
        .agg(best)
        .join(groups, "node", "left")
        .groupBy(F.coalesce("component", "node").alias("group"))
        .agg(F.min("best").alias("best"))
        .select(
            F.col("best.doc_id").alias("__id"), F.col("best.row_hash").alias("__hash"), F.col("best.n").alias("__n")
        )
    )
    names = [F.col(f"`{name}`") for name in documents.columns]
    kept = rows_of(documents, keepers)
    single = kept.where("__n = 1").select(*names)
    return single.unionByName(kept.where("__n > 1").dropDuplicates(["__id", "__hash"]).select(*names))
