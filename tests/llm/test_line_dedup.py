"""Line dedup against a brute-force version."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from logloom.llm.line_dedup import PerfectHash, dedup_lines, index_shard, line_key, prober
from tests.llm.conftest import ODD_ROWS


def plain(rows, min_chars, min_docs):
    lines = [(text or "").split("\n") for _, text in rows]
    holders = {}
    for at, own in enumerate(lines):
        for line in own:
            key = line.strip(" \t\n\x0b\x0c\r")
            key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key)
            if len(key) >= min_chars:
                holders.setdefault(key, set()).add(at)
    gone = {}
    for key, held in holders.items():
        if len(held) >= min_docs:
            ids = [rows[at][0] for at in held if rows[at][0] is not None]
            gone[key] = max(ids) if ids else None
    out = []
    for (doc_id, text), own in zip(rows, lines, strict=True):
        kept = [line for line in own if line_key(line) not in gone or gone[line_key(line)] == doc_id]
        out.append((doc_id, len(own), len(own) - len(kept), None if text is None else "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"shard_keys": 3, "task_probes": 4}])
def test_equals_brute_force(documents_of, sizes):
    random.seed(8)
    pool = [f"{name} line that is long enough {at % 3}" for at, name in enumerate(["A", "ä", "Straße", "x 😀", "Bb"])]
    rows = list(ODD_ROWS)
    for at in range(60):
        own = [random.choice(pool) for _ in range(random.randint(0, 4))]
        own = [random.choice([line, line.upper(), f"  {line}\t", f"{line}\r"]) for line in own] + [f"own {at}", ""]
        random.shuffle(own)
        rows.append((random.choice([None, at, at, 70]), "\n".join(own)))
    rows += [(200, pool[0]), (200, pool[0]), (201, "\n".join([pool[1]] * 50))]
    got = dedup_lines(documents_of(rows, clashes=True), 20, 4, **sizes)
    assert "slot" in got.columns
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=repr) == plain(rows, 20, 4)


def test_empty_table(documents_of):
    assert dedup_lines(documents_of([])).count() == 0


def test_perfect_hash_is_minimal_and_keeps_when_packed():
    keys = np.random.default_rng(0).integers(0, 2**64, 5000, dtype=np.uint64)
    function = PerfectHash.unpack(PerfectHash.build(keys).pack())
    assert sorted(function.numbers(keys).tolist()) == list(range(5000)) and function.size == 5000
    others = function.numbers(np.arange(1000, dtype=np.uint64))
    assert others.max() < 5000 and others.min() >= -1
    assert PerfectHash.build(keys[:0]).numbers(keys[:3]).tolist() == [-1, -1, -1]


def test_keys_that_agree_in_64_bits():
    """Line keys that only the fingerprint tells apart get index rows of their own."""
    group = pd.DataFrame(
        {"shard": [0] * 3, "high": [7, 7, 8], "low": [1, 2, 1], "n_docs": [5, 1, 9], "last": [50, 60, 70]}
    )
    index = index_shard(group)
    assert len(index) == 2
    probes = pd.DataFrame(
        {"high": [7, 7, 7, 8], "low": [1, 2, 1, 3], "own": [1, 1, 50, 1], "text_hash": [0] * 4, "line": [0, 1, 2, 3]}
    )
    assert prober(5)(index, probes)["line"].tolist() == [0]


def test_counts_have_a_limit(documents_of):
    with pytest.raises(ValueError):
        dedup_lines(documents_of([(1, "x")]), min_docs=65536)
