"""Shards and mixes: laws, exact sums and odd rows."""

from __future__ import annotations

import math
import random
import struct
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from logloom.llm.mixing import mix, mixed_documents, word_count
from logloom.llm.sharding import shard_documents, with_shards, write_shards
from tests.llm.conftest import ODD_ROWS


def test_shards_and_slots(documents_of, odd_documents):
    rows = ODD_ROWS + [(100 + at, f"text {at}") for at in range(3000)]
    got = shard_documents(documents_of(rows, clashes=True), [1.0] * 8).collect()
    assert len(got) == len(rows)
    sizes = sorted((row.doc_id or -1, row.size, row.text_crc32) for row in got)
    assert sizes == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for shard in range(8):
        own = sorted(row.slot for row in got if row.shard == shard)
        assert own == list(range(len(own))) and 300 < len(own) < 460
    assert {row.grown_shard for row in got if row.grown_shard != row.shard} == {8}
    assert len({(row.doc_id, row.shard, row.grown_shard) for row in got}) == len({i for i, _ in rows})
    assert shard_documents(documents_of([]), [1.0] * 8).count() == 0


def test_weights_decide_shares_and_seed_the_place(spark):
    keys = spark.range(40_000).withColumnRenamed("id", "key")
    counts = {row.shard: row["count"] for row in with_shards(keys, "key", [1.0, 3.0]).groupBy("shard").count().collect()}
    assert abs(counts[1] / 40_000 - 0.75) < 0.01
    shrunk = with_shards(keys, "key", [1.0, 3.0], 4.0).where("shard <> grown_shard").agg(
        F.count("*"), F.min("grown_shard"), F.max("grown_shard")
    ).first()
    assert abs(shrunk[0] / 40_000 - 0.5) < 0.01 and shrunk[1] == shrunk[2] == 2
    for weights in ([], [1.0, 0.0]):
        with pytest.raises(ValueError):
            with_shards(keys, "key", weights)


def placed_by_hand(key, weights, seed):
    """The shard of largest -weight / ln(u), with the hash chained over key, seed and shard by the xxhash library."""

    def score(shard):
        state = 42
        for part in (struct.pack("<q", key), struct.pack("<i", seed), struct.pack("<i", shard)):
            state = xxhash.xxh64_intdigest(part, seed=state)
        return weights[shard] / -math.log(((state >> 11) + 0.5) / 2**53)

    return max(range(len(weights)), key=score)


@pytest.mark.parametrize(("weights", "seed"), [([1.0] * 8, 0), ([0.5, 2.0, 1.0], 7)])
def test_places_equal_an_independent_computation(spark, weights, seed):
    keys = [0, 1, -1, 2**62, -(2**63), *range(1000, 3000)]
    frame = spark.createDataFrame([(key,) for key in keys], "key long")
    for row in with_shards(frame, "key", weights, 1.0, seed).collect():
        assert row.shard == placed_by_hand(row.key, weights, seed)
        assert row.grown_shard == placed_by_hand(row.key, [*weights, 1.0], seed)


def test_written_shards(spark, documents_of, tmp_path):
    frame = documents_of([(at, f"t{at}") for at in range(50)])
    write_shards(frame, "doc_id", [1.0, 1.0, 1.0], str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == 50
    want = {row.doc_id: row.shard for row in with_shards(frame, "doc_id", [1.0, 1.0, 1.0]).collect()}
    assert {row.doc_id: row.shard for row in back.collect()} == want


def dealt(sizes, weights, share, most):
    """Targets by dealing again what full sources can't take."""
    total, target, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    rest = total
    while open_:
        whole = sum(weights[at] for at in open_)
        full = {at for at in open_ if rest * weights[at] / whole >= most * sizes[at]}
        if not full:
            for at in open_:
                target[at] = rest * weights[at] / whole
            break
        for at in full:
            target[at] = most * sizes[at]
        rest -= sum(target[at] for at in full)
        open_ -= full
    return target


@pytest.mark.parametrize("seed", range(4))
def test_mix_follows_targets(spark, documents_of, seed):
    random.seed(seed)
    rows = list(ODD_ROWS)
    for source in random.sample(["a", "b", "c", "é", "Z", "", None], 6):
        for _ in range(random.choice([1, 5, 120])):
            rows.append((random.randint(1, 400), "w " * random.choice([0, 1, 7, 40]), source))
    frame = documents_of(rows, clashes=True)
    got = mix(frame.withColumn("size", word_count("text")).select("doc_id", "source", "size")).collect()
    again = mix(frame.withColumn("size", word_count("text")).select("doc_id", "source", "size")).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    sources = sorted({row.source for row in got}, key=lambda name: (name is None, name))
    sizes = [sum(row.size for row in got if row.source == name) for name in sources]
    want = dealt(sizes, [(3, 1, 2)[at % 3] for at in range(len(sources))], 1.5, 2.0)
    for name, size, target in zip(sources, sizes, want, strict=True):
        own = [row for row in got if row.source == name]
        assert all(row.source_size == size and row.target == pytest.approx(target) for row in own)
        assert all(0 <= row.taken <= 2 * row.size for row in own)
        # equal rows at the cut share evenly, so less than a word for each of them is left
        assert target - len(own) <= sum(row.taken for row in own) <= target + 1e-6
        assert target - 2 - max(own.count(row) for row in own) <= sum(row.taken for row in own)


def test_mix_without_rows_or_words(spark, documents_of):
    empty = documents_of([]).select("doc_id", "source", word_count("text").alias("size"))
    assert mix(empty).count() == 0 and mixed_documents(documents_of([])).count() == 0
    blank = documents_of([(1, None), (2, "")]).select("doc_id", "source", word_count("text").alias("size"))
    assert [(row.target, row.taken) for row in mix(blank).collect()] == [(0.0, 0), (0.0, 0)]


def test_whole_documents_of_a_mix(documents_of):
    rows = [(at, f"one two three {at}", "a" if at % 4 else "b") for at in range(400)] + [(999, None, None)]
    frame = documents_of(rows, clashes=True)
    mixed = mixed_documents(frame)
    assert mixed.columns == frame.columns
    counts = {row.source: row["count"] for row in mixed.groupBy("source").count().collect()}
    assert counts == {"a": 450, "b": 150}
