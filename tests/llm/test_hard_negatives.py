"""Hard negatives against brute force in whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm.hard_negatives import Segmented, Summaries, mine_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, shard string, rank int, vector int, anchor int"


def brute(rows, every, n_positives=5, n_negatives=10):
    good = [
        (vec_id, label, [math.floor(256 * x) for x in vector])
        for vec_id, vector, label in rows
        if None not in (vec_id, label, vector) and vector and all(x is not None and math.isfinite(x) for x in vector)
    ]
    good = [row for row in good if sum(x * x for x in row[2]) < 2**62]
    out = []
    for at, (anchor, label, own) in enumerate(good):
        if anchor % every:
            continue
        scored = [
            (-sum(a * b for a, b in zip(own, other)), vec_id, other_label)
            for place, (vec_id, other_label, other) in enumerate(good)
            if place != at and len(other) == len(own)
        ]
        scored.sort()
        for minus, positive, _ in [one for one in scored if one[2] == label][:n_positives]:
            fits = [one for one in scored if one[2] != label and 30 * -minus <= 100 * -one[0] <= 90 * -minus]
            out += [(anchor, positive, rank, one[1], -minus, -one[0]) for rank, one in enumerate(fits[:n_negatives], 1)]
    return sorted(out)


def vectors(count, seed, width, spread):
    state = np.random.default_rng(seed)
    centres = state.normal(size=(4, width)) + 0.5
    rows = []
    for at in range(count):
        own = centres[state.integers(4)] + spread * state.normal(size=width)
        rows.append((at, own.tolist(), int(state.integers(0, 3))))
    same = rows[3][1]
    rows += [(count + at, same, at % 2) for at in range(60)]
    rows += [(10, same, 1), (10, same, 1), (None, same, 1), (5000, None, 1), (5010, [1.0, None], 1), (5020, same, None)]
    rows += [(5030, [float("nan")] * width, 1), (5040, [float("inf")] * width, 1), (5050, [0.0] * width, 2), (5060, [], 1)]
    rows += [(5070, [1.0, 0.5], 1), (5071, [1.0, 0.25], 1), (5072, [0.75, 0.0], 2), (5080, [1e300] * width, 1)]
    rows += [(5090, [-1e-20, 2.0], 1), (5091, [-3.0, -4.0], 1)]
    return rows


def ask(spark, rows, every=10, **options):
    frame = spark.createDataFrame([(*row, "x", 7, 1, 2) for row in rows], SCHEMA).repartition(4)
    return sorted(tuple(row) for row in mine_negatives(frame, F.col("vec_id") % every == 0, **options).collect())


@pytest.mark.parametrize("width, spread", [(8, 0.4), (7, 1.0), (32, 0.05), (1, 1.0)])
@pytest.mark.parametrize("options", [{}, {"shard_rows": 50}])
def test_equals_brute_force(spark, width, spread, options):
    rows = vectors(400, width, width, spread)
    want = brute(rows, 10)
    assert want and ask(spark, rows, **options) == want


def test_scores_beyond_doubles(spark):
    state = np.random.default_rng(1)
    rows = [(at, (state.integers(1, 2**20, size=4) * 1.0).tolist(), at % 3) for at in range(80)]
    assert ask(spark, rows) == brute(rows, 10)


def test_bounds_hold_and_prune():
    """No score leaves its bounds at any level, and rows away from the anchor are never scored."""
    state = np.random.default_rng(2)
    rows = np.floor(256 * (state.normal(size=(20, 64))[state.integers(20, size=5000)] + 0.05 * state.normal(size=(5000, 64))))
    levels = Summaries(rows).levels
    assert [len(sizes) for sizes, _, _ in levels] == [1, 2, 4, 8, 16]
    exact = rows @ rows[0]
    before = None
    for sizes, means, deviations in levels:
        middle, spread = means @ (sizes * means[0]), deviations @ (sizes * deviations[0])
        assert (np.abs(exact - middle) <= spread + 1e-6).all()
        assert before is None or spread.sum() <= before
        before = spread.sum()
    table = Segmented(np.arange(5000), np.arange(5000), np.zeros(5000), rows)
    scored = []
    table.scores = lambda some, anchor, norm: scored.append(len(some)) or (rows[some] @ anchor).astype(np.int64)
    own = [(means[0], deviations[0]) for _, means, deviations in levels]
    found, values = table.best(np.arange(1, 5000), rows[0], own, 5)
    want = sorted(((-int(exact[at]), at) for at in range(1, 5000)))[:5]
    assert list(zip(found.tolist(), values.tolist())) == [(at, -score) for score, at in want]
    assert sum(scored) < 1000


def test_few_and_no_rows(spark):
    assert ask(spark, []) == []
    assert ask(spark, [(0, [1.0, 1.0], 1)]) == []
    assert ask(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []
    assert ask(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]) == [(0, 1, 1, 2, 65536, 32768)]
