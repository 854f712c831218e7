"""Nearest neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm.neighbours import VantageTree, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, shard string, rank int"


def brute(rows, k, every):
    good = []
    for vec_id, vector in rows:
        if vec_id is None or vector is None or any(x is None or not np.isfinite(x) for x in vector) or not any(vector):
            continue
        good.append((vec_id, np.array(vector, dtype=np.float32).astype(np.float64)))
    out = {}
    for vec_id, own in good:
        if vec_id % every:
            continue
        scored = [
            (-round(float(own @ other / np.linalg.norm(own) / np.linalg.norm(other)), 12), other_id)
            for other_id, other in good
            if other_id != vec_id and len(other) == len(own)
        ]
        out[vec_id] = [(other_id, -score) for score, other_id in sorted(scored)[:k]]
    return out


def vectors(count, seed, width=8):
    state = np.random.default_rng(seed)
    centres = state.normal(size=(6, width))
    own = centres[state.integers(0, 6, count)] + 0.3 * state.normal(size=(count, width))
    rows = [(at, [float(x) for x in vector.astype(np.float32)]) for at, vector in enumerate(own)]
    same = rows[3][1]
    rows += [(count + at, same) for at in range(40)]
    rows += [(5000, None), (5001, [0.0] * width), (5002, [float("nan")] * width), (5003, [1.0, None] * (width // 2))]
    rows += [(None, same), (5010, [float("inf")] * width), (5020, [1.0, 2.0]), (5030, [2.0, 1.0]), (5040, [])]
    return rows


def ask(spark, rows, **options):
    frame = spark.createDataFrame([(*row, 1, "x", 7) for row in rows], SCHEMA)
    found = {}
    for row in nearest(frame, F.col("vec_id") % 10 == 0, **options).orderBy("query_id", "rank").collect():
        found.setdefault(row.query_id, []).append((row.vec_id, row.score))
        assert row.rank == len(found[row.query_id])
    return found


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 200}])
def test_exact_at_factor_one(spark, monkeypatch, sizes):
    import logloom.llm.neighbours as neighbours

    monkeypatch.setattr(neighbours, "LEAF_ROWS", 16)
    rows = vectors(900, 1)
    got, want = ask(spark, rows, k=5, factor=1.0, **sizes), brute(rows, 5, 10)
    assert got.keys() == want.keys()
    for query, hits in want.items():
        assert [one for one, _ in got[query]] == [one for one, _ in hits]
        assert [score for _, score in got[query]] == pytest.approx([score for _, score in hits], abs=1e-12)


def test_relaxed_pruning_keeps_most(spark):
    rows = vectors(3000, 2)
    got, want = ask(spark, rows, k=5, factor=1.5), brute(rows, 5, 10)
    hits = sum(len({one for one, _ in got.get(query, [])} & {one for one, _ in own}) for query, own in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9


def test_few_and_no_rows(spark):
    assert ask(spark, []) == {}
    assert ask(spark, [(0, [1.0, 0.0])]) == {}
    assert ask(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0])], k=5)[0][0] == (2, 1.0)
    repeated = ask(spark, [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])], k=5)
    assert [one for one, _ in repeated[0]] == [1, 1]


def test_smallest_ids_of_many_equal_vectors():
    """A third of a shard's vectors are copies; queries among them get the copies with the smallest ids."""
    missed = []
    for seed in range(150):
        state = np.random.default_rng(seed)
        rows = state.normal(size=(3600, 64)).astype(np.float32).astype(np.float64)
        copies = state.permutation(3600)[:1200]
        rows[copies] = rows[copies[0]]
        ids = np.arange(3600)
        queries = np.concatenate([np.sort(copies)[-int(state.integers(1, 9)) :], [int(state.integers(0, 3600))]])
        queries = queries[np.isin(queries, copies)]
        tree = VantageTree(ids, rows)
        found, _ = tree.search(queries, rows[queries], 5, 1.0)
        for query, own in zip(queries, found, strict=True):
            want = [at for at in np.sort(copies) if at != query][:5]
            if tree.ids[own].tolist() != want:
                missed.append((seed, query))
    assert not missed
