"""Line dedup by probing sharded minimal perfect hashes over the distinct line keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import broadcast_checked, map_slices, stored

STRIPPED = " \t\n\x0b\x0c\r"
GAMMA = 2
NO_DOCUMENT = -(2**63)


def line_key(line: str) -> str:
    """The line without ASCII white space at both ends and with A-Z lower-cased."""
    stripped = line.strip(STRIPPED)
    return stripped.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of each key for one level of the perfect hash."""
    with np.errstate(over="ignore"):
        x = keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bit arrays with rank.

    At each level a key that has its place alone sets a bit there; the others go on to the next
    level. A key's number is the rank of its bit, so n keys get exactly the numbers 0 to n - 1.
    A key that was not indexed gets any number or none (-1).
    """

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            self.ranks.append(total + np.cumsum(bits, dtype=np.int64) - bits)
            total += int(bits.sum())
        self.size = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            width = max(1, GAMMA * len(left))
            place = (mixed(left, len(levels)) % np.uint64(width)).astype(np.int64)
            alone = np.bincount(place, minlength=width) == 1
            levels.append(alone)
            left = left[~alone[place]]
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            place = (mixed(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[place]
            out[left[hit]] = ranks[place[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out

    def pack(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], dtype="<i8").tobytes()
        return head + b"".join(np.packbits(bits).tobytes() for bits in self.levels)

    @classmethod
    def unpack(cls, blob: bytes) -> PerfectHash:
        count = int(np.frombuffer(blob, "<i8", 1)[0])
        widths = np.frombuffer(blob, "<i8", count, 8)
        at, levels = 8 * (count + 1), []
        for width in widths:
            size = (int(width) + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=int(width)).astype(bool))
            at += size
        return cls(levels)


INDEX_SCHEMA = "shard long, hash binary, fingerprints binary, counts binary, last binary"


def index_shard(group: pd.DataFrame) -> pd.DataFrame:
    """Index rows of a shard: perfect hash, then arrays in the order of its numbers.

    A perfect hash needs distinct 64-bit keys. Line keys that agree in them and differ only in
    the fingerprint go to further rows, so there is one row but for such accidents.
    """
    rows = []
    while len(group):
        again = group["high"].duplicated()
        now, group = group[~again], group[again]
        keys = now["high"].to_numpy(np.int64).view(np.uint64)
        function = PerfectHash.build(keys)
        order = np.argsort(function.numbers(keys))
        counts = np.minimum(now["n_docs"].to_numpy(np.int64), np.iinfo(np.uint16).max)
        rows.append(
            {
                "shard": int(now["shard"].iloc[0]),
                "hash": function.pack(),
                "fingerprints": now["low"].to_numpy(np.int64)[order].astype("<i8").tobytes(),
                "counts": counts[order].astype("<u2").tobytes(),
                "last": now["last"].to_numpy(np.int64)[order].astype("<i8").tobytes(),
            }
        )
    return pd.DataFrame(rows)


def find_lines(documents: DataFrame, min_chars: int) -> DataFrame:
    """One row per line with a key of at least `min_chars` code points: 128 hash bits and place.

    `first` marks a key's first line in its document, so that a document counts once.
    """

    def handle(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {name: [] for name in ("high", "low", "doc_id", "text_hash", "line", "first")}
        for doc_id, text_hash, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            seen = set()
            for number, line in enumerate(text.split("\n") if text else ()):
                if len(line) < min_chars:
                    continue
                key = line.strip(STRIPPED)
                if len(key) < min_chars:
                    continue
                digest = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass").lower())
                out["high"].append((digest >> 64) - (1 << 63))
                out["low"].append((digest & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                out["doc_id"].append(doc_id)
                out["text_hash"].append(text_hash)
                out["line"].append(number)
                out["first"].append(digest not in seen)
                seen.add(digest)
        return out

    narrow = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return map_slices(narrow, handle, "high long, low long, doc_id long, text_hash long, line int, first boolean")


def build_index(lines: DataFrame, shards: int) -> DataFrame:
    """One row per shard of the distinct line keys, see index_shard.

    Documents are counted before the shuffle, so a line in a third of all documents costs no more
    than any other.
    """
    counted = lines.groupBy("high", "low").agg(
        F.count(F.when(F.col("first"), 1)).alias("n_docs"),
        F.coalesce(F.max("doc_id"), F.lit(NO_DOCUMENT)).alias("last"),
    )
    return (
        counted.withColumn("shard", F.pmod(F.col("high"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(index_shard, INDEX_SCHEMA)
    )


DROP_SCHEMA = "own long, text_hash long, line int"


def prober(min_docs: int):
    """Probe the arrays of a shard with one part of its lines; lines to drop come back."""

    def probe(index: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        keys = probes["high"].to_numpy(np.int64).view(np.uint64)
        low, own = probes["low"].to_numpy(np.int64), probes["own"].to_numpy(np.int64)
        drop = np.zeros(len(probes), dtype=bool)
        for row in index.itertuples() if len(probes) else ():
            numbers = PerfectHash.unpack(row.hash).numbers(keys)
            known = (numbers >= 0) & (np.frombuffer(row.fingerprints, "<i8")[numbers] == low)
            often = np.frombuffer(row.counts, "<u2")[numbers] >= min_docs
            drop |= known & often & (np.frombuffer(row.last, "<i8")[numbers] != own)
        return probes.loc[drop, ["own", "text_hash", "line"]]

    return probe


def repeated_lines(
    documents: DataFrame,
    min_chars: int = 40,
    min_docs: int = 5,
    shard_keys: int = 65_536,
    task_probes: int = 500_000,
) -> DataFrame:
    """Lines to drop, as (own, text_hash, lines): numbers of lines in documents that lose any.

    A shard's probes are dealt to as many tasks as their number asks for, each with a copy of the
    shard's arrays (about 20 bytes a key), so a line of a third of all documents fills many tasks.
    """
    lines = stored(find_lines(documents, min_chars))
    total = lines.count()
    shards = max(1, -(-total // shard_keys))
    index = build_index(lines, shards)
    sharded = lines.withColumn("shard", F.pmod(F.col("high"), F.lit(shards)))
    parts = broadcast_checked(
        stored(
            sharded.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(task_probes)).cast("int").alias("parts"))
        )
    )
    copies = index.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    probes = sharded.join(parts, "shard").select(
        "shard",
        F.pmod(F.xxhash64("doc_id", "text_hash", "line"), F.col("parts")).cast("int").alias("part"),
        "high",
        "low",
        F.coalesce("doc_id", F.lit(NO_DOCUMENT)).alias("own"),
        "text_hash",
        "line",
    )
    dropped = (
        copies.drop("parts")
        .groupBy("shard", "part")
        .cogroup(probes.groupBy("shard", "part"))
        .applyInPandas(prober(min_docs), DROP_SCHEMA)
    )
    return dropped.groupBy("own", "text_hash").agg(F.collect_set("line").alias("lines"))


def dedup_lines(documents: DataFrame, min_chars: int = 40, min_docs: int = 5, **sizes: int) -> DataFrame:
    """Documents without their repeated lines, with `n_lines` (before) and `n_dropped`.

    A key (see line_key) of at least `min_chars` code points that is found in at least `min_docs`
    documents loses all its lines except in the document with the largest id that holds it. A null
    or empty text is one empty line and stays as it is, a null as null. Rows count as documents
    even if they repeat an id; rows of the largest id all keep the line. A null id is the smallest.
    Input columns of the two result names are replaced. Counts are kept in 16 bits, so `min_docs`
    can't be over 65535.
    """
    if min_docs > np.iinfo(np.uint16).max:
        raise ValueError("min_docs must be at most 65535")
    others = [name for name in documents.columns if name not in ("n_lines", "n_dropped")]
    base = documents.select(*[F.col(f"`{name}`") for name in others])
    drops = stored(repeated_lines(base, min_chars, min_docs, **sizes)).select(
        F.col("own").alias("__id"), F.col("text_hash").alias("__hash"), F.col("lines").alias("__lines")
    )
    joined = base.join(
        drops,
        (F.coalesce("doc_id", F.lit(NO_DOCUMENT)) == F.col("__id")) & (F.xxhash64("text") == F.col("__hash")),
        "left",
    )
    pieces = F.split(F.col("text"), "\n", -1)
    numbers = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("__lines"))
    joined_text = F.array_join(F.transform(numbers, lambda at: F.get(pieces, at)), "\n")
    newlines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n")))
    return (
        joined.withColumn("n_lines", F.coalesce(newlines + 1, F.lit(1)).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("__lines"), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col("__lines").isNull(), F.col("text")).otherwise(joined_text))
        .drop("__id", "__hash", "__lines")
    )
