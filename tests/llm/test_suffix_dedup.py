"""Repeated strings against brute force, and the sort against sorted()."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from logloom.llm.suffix_dedup import deep_shallow_sort, remove_repeats
from tests.llm.conftest import ODD_ROWS


@pytest.mark.parametrize("shallow", [0, 8, 64])
def test_sort(shallow):
    random.seed(shallow)
    for _ in range(200):
        base = bytes(random.choice(b"ab") for _ in range(random.choice([3, 50, 200])))
        strings = [
            base[: random.randint(0, len(base))] + bytes(random.choice(b"abc\0") for _ in range(random.randint(0, 60)))
            for _ in range(random.randint(0, 40))
        ]
        order = deep_shallow_sort(strings, 0, shallow) if strings else []
        assert sorted(order) == list(range(len(strings)))
        assert [strings[at] for at in order] == sorted(strings)


def plain(rows, length):
    data = [(doc_id, (text or "").encode()) for doc_id, text in rows]
    counts = Counter(own[at : at + length] for _, own in data for at in range(len(own) - length + 1))
    out = []
    for doc_id, own in data:
        gone = bytearray(len(own))
        for at in range(len(own) - length + 1):
            if counts[own[at : at + length]] > 1:
                gone[at : at + length] = b"\1" * length
        kept = bytes(byte for byte, mark in zip(own, gone, strict=True) if not mark)
        spans = sum(1 for at, mark in enumerate(gone) if mark and not (at and gone[at - 1]))
        out.append((doc_id, len(own), len(own) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"hot_contexts": 1, "group_contexts": 5}])
def test_equals_brute_force(documents_of, sizes):
    random.seed(12)
    alphabet = "abcdefghij éß漢"
    passages = ["".join(random.choice(alphabet) for _ in range(random.choice([150, 420, 700]))) for _ in range(5)]
    rows = [row for row in ODD_ROWS if row[0] != 6] + [(6, "long " * 400)]
    for at in range(40):
        text = ""
        for _ in range(random.randint(0, 4)):
            passage = random.choice(passages)
            first = random.choice([0, 0, random.randint(0, 60)])
            text += passage[first : first + random.choice([100, 399, 400, 401, 2000])]
            text += "".join(random.choice(alphabet) for _ in range(random.choice([0, 1, 30])))
        rows.append((at, text))
    rows += [(50, passages[2] * 2), (51, passages[2]), (52, passages[2]), (53, "x" * 900)]
    got = remove_repeats(documents_of(rows, clashes=True), 400, **sizes).collect()
    found = []
    for row in got:
        text = row.kept
        if text is None:
            assert row.n_removed == 0
        found.append((row.doc_id, row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256, text))
    want = [(*one[:5], one[5] if one[2] else None) for one in plain(rows, 400)]
    assert sorted((one[:5] for one in found), key=repr) == sorted((one[:5] for one in want), key=repr)
    assert {bytes(one[5]) for one in found if one[5] is not None} == {one[5] for one in want if one[5] is not None}
    assert any(one[2] and one[2] < one[1] for one in want)


def test_without_matches_or_rows(documents_of):
    assert remove_repeats(documents_of([])).count() == 0
    row = remove_repeats(documents_of([(1, "short")])).first()
    assert (row.n_bytes, row.n_removed, row.n_spans) == (5, 0, 0)
