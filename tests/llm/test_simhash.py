"""SimHash groups against a brute-force version."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from logloom.llm.components import connected_components
from logloom.llm.simhash import chain_within, covering_masks, fingerprint, keep_one, near_links, signed, simhash_groups
from tests.llm.conftest import ODD_ROWS


def plain_fingerprint(text, width=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    pieces = [" ".join(words[at : at + width]) for at in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(piece.encode(), 42) for piece in pieces]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components(values, radius):
    """Smallest index reachable from each value by steps of at most `radius` bits."""
    root = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for a, x in enumerate(values):
            for b, y in enumerate(values):
                if root[b] < root[a] and (x ^ y).bit_count() <= radius:
                    root[a], changed = root[b], True
    return root


def test_spark_hash_is_the_same(spark):
    text = "a few words here"
    assert spark.sql(f"SELECT xxhash64('{text}')").first()[0] == signed(xxhash.xxh64_intdigest(text, 42))


def test_fingerprint():
    random.seed(1)
    for _ in range(50):
        text = "".join(random.choice("aB cÄ \t\nz.") for _ in range(random.randint(0, 60)))
        assert fingerprint(text) == plain_fingerprint(text)
    assert fingerprint(None) == fingerprint(" \n") == 0


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover_every_pair(radius):
    masks = covering_masks(radius)
    random.seed(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        flipped = sum(1 << bit for bit in random.sample(range(64), radius))
        assert any(mask & flipped == 0 for mask in masks)


def close_prints(count, seed):
    random.seed(seed)
    centres = [random.getrandbits(64) for _ in range(6)]
    out = set()
    while len(out) < count:
        value = random.choice(centres)
        for bit in random.sample(range(64), random.randint(0, 5)):
            value ^= 1 << bit
        out.add(value)
    return sorted(out)


@pytest.mark.parametrize("radius,bucket_rows", [(4, 4096), (4, 8), (3, 8)])
def test_links_connect_what_brute_force_does(spark, radius, bucket_rows):
    """Small and midpoint buckets give the same groups, for even and odd radii."""
    values = close_prints(120, 7)
    frame = spark.createDataFrame([(signed(value),) for value in values], "fp long")
    found = connected_components(near_links(frame, radius, bucket_rows)).collect()
    groups = {}
    for row in found:
        groups.setdefault(row.component, set()).add(row.node)
    want = {}
    for value, root in zip(values, components(values, radius), strict=True):
        want.setdefault(root, set()).add(signed(value))
    assert sorted(map(sorted, groups.values())) == sorted(sorted(group) for group in want.values() if len(group) > 1)


def test_chain_spans_each_group_once():
    prints = np.array(close_prints(60, 3), dtype=np.uint64)
    low, high = chain_within(prints, 4)
    assert len(set(high)) == len(high) and len(high) == 60 - len(set(components(prints.tolist(), 4)))


def test_components_of_paths_and_stars(spark):
    edges = [(at, at + 1) for at in range(200)] + [(1000, 1000 + at) for at in range(1, 50)] + [(7, 7), (5000, 4000)]
    got = {row.node: row.component for row in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[node] == 0 for node in range(201)) and all(got[1000 + at] == 1000 for at in range(50))
    assert got[5000] == 4000 and len(got) == 201 + 50 + 2
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_equal_brute_force(spark, documents_of):
    random.seed(5)
    words = [f"w{at}" for at in range(300)]
    base = [" ".join(random.choices(words, k=200)) for _ in range(8)]
    rows = []
    for doc_id in range(60):
        text = random.choice(base).split()
        for _ in range(random.randint(0, 2)):
            text[random.randrange(len(text))] = "changed"
        rows.append((100 - doc_id, " ".join(text)))
    rows += [row for row in ODD_ROWS]
    got = simhash_groups(documents_of(rows, clashes=True)).collect()
    prints = [plain_fingerprint(text) for _, text in rows]
    roots = components(prints, 4)
    want = []
    for (doc_id, _), value, root in zip(rows, prints, roots, strict=True):
        ids = [other for (other, _), at in zip(rows, roots, strict=True) if at == root and other is not None]
        want.append((doc_id, f"{value:016x}", min(ids) if ids else None))
    key = repr
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert simhash_groups(documents_of([])).count() == 0


def test_keep_one_row_of_each_group(documents_of):
    random.seed(9)
    text = [" ".join(random.choices([f"word{at}" for at in range(2000)], k=300)) for _ in range(3)]
    near = text[0].split()
    near[17] = "other"
    rows = [(9, text[0]), (3, " ".join(near)), (4, text[0]), (5, text[1]), (5, text[1]), (None, text[2]), (None, text[2])]
    rows += [(7, None), (6, " "), (8, "")]
    kept = keep_one(documents_of(rows, clashes=True))
    assert kept.columns == documents_of(rows, clashes=True).columns
    assert sorted((row.doc_id, row.text) for row in kept.where("doc_id is not null").collect()) == [
        (3, " ".join(near)), (5, text[1]), (6, " "),
    ]
    assert kept.where("doc_id is null").count() == 1
    assert keep_one(documents_of([])).count() == 0
