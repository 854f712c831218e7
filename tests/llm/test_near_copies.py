"""The near-copy stage against brute force over five-word shingles."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from logloom.llm.near_copies import BAND_ROWS, BANDS, band_keys, keep_one, near_copy_links, printed_sets, shingle_set
from logloom.llm.simhash import fingerprint

WORDS = [f"word{at}" for at in range(3000)]


def plain_shingles(text, width=5):
    words = text.lower().split()
    return {" ".join(words[at : at + width]) for at in range(max(1, len(words) - width + 1))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def kept_by_brute_force(rows):
    """Smallest id of each group that pairs of a similarity of at least 0.8 connect."""
    sets = {doc_id: plain_shingles(text) for doc_id, text in rows}
    left, kept = set(sets), []
    for doc_id in sorted(sets):
        if doc_id in left:
            kept.append(doc_id)
            front = [doc_id]
            left.discard(doc_id)
            while front:
                own = sets[front.pop()]
                near = [other for other in left if similarity(own, sets[other]) >= 0.8]
                left.difference_update(near)
                front += near
    return kept


def edited(words, changes):
    out = list(words)
    for at in random.sample(range(len(out)), changes):
        out[at] = f"edit{random.randrange(10**9)}"
    return " ".join(out)


@pytest.mark.parametrize("block_rows", [256, 8])
def test_only_confirmed_pairs_merge(documents_of, block_rows):
    """Groups of edits at both sides of 0.8, templates, and the same words in another order or number."""
    random.seed(11)
    rows = []
    for _ in range(3):
        base = random.sample(WORDS, 120)
        rows += [(0, edited(base, random.randint(0, 8))) for _ in range(40)]
    template = random.sample(WORDS, 150)
    rows += [(0, " ".join(template + random.sample(WORDS, 30))) for _ in range(60)]
    words = random.sample(WORDS, 200)
    rows += [(0, " ".join(random.sample(words, 200))) for _ in range(5)]
    rows += [(0, " ".join(words * times)) for times in (1, 3)]
    random.shuffle(rows)
    rows = [(doc_id, text) for doc_id, (_, text) in enumerate(rows)]
    got = sorted(row.doc_id for row in keep_one(documents_of(rows), block_rows=block_rows).collect())
    assert got == kept_by_brute_force(rows)


def test_pairs_at_the_threshold_are_candidates():
    """Of pairs barely above 0.8, long and short, edited or cut, about as few are missed as stated."""
    random.seed(4)
    stated = (1 - 0.8**BAND_ROWS) ** BANDS
    assert stated < 0.0003
    pairs = missed = 0
    while pairs < 2000:
        words = random.sample(WORDS, random.choice([40, 120, 600]))
        text = " ".join(words)
        if random.random() < 0.5:
            other = edited(words, max(1, len(words) // 50 + random.randint(-1, 1)))
        else:
            other = " ".join(words[: int(len(words) * random.uniform(0.8, 0.85)) + 1])
        if not 0.8 <= similarity(plain_shingles(text), plain_shingles(other)) <= 0.85:
            continue
        pairs += 1
        missed += not (band_keys(shingle_set(text)) == band_keys(shingle_set(other))).any()
    assert missed <= 3


def test_simhash_groups_are_candidates(documents_of):
    """Without min-wise keys the pairs within four bits are still compared, and only those at 0.8 link."""
    random.seed(9)
    rows = []
    for base in range(40):
        words = random.sample(WORDS, 150)
        # one more shingle among 1,900 moves few bits or none
        rows += [(10 * base, " ".join(words * 13)), (10 * base + 1, " ".join(words * 13 + ["more"]))]
    documents = documents_of(rows)
    printed = printed_sets(documents).withColumn("bands", F.array().cast("array<long>"))
    prints = {row.doc_id: row for row in printed.collect()}
    assert all(row.fp % 2**64 == fingerprint(text, 5) for (doc_id, text) in rows for row in [prints[doc_id]])
    near = {(at, at + 1) for at in range(0, 400, 10) if ((prints[at].fp ^ prints[at + 1].fp) % 2**64).bit_count() <= 4}
    assert len(near) >= 30
    found = {tuple(sorted(row)) for row in near_copy_links(documents, printed).collect()}
    assert found == {tuple(sorted((prints[a].node, prints[b].node))) for a, b in near}


def test_simhash_groups_are_confirmed(documents_of):
    """Two texts with one fingerprint and too few shingles in common stay apart."""
    rows = [(1, "one two three four five six seven eight"), (2, "nine ten eleven twelve more words of it")]
    documents = documents_of(rows)
    printed = printed_sets(documents).withColumn("bands", F.array().cast("array<long>")).withColumn("fp", F.lit(7).cast("long"))
    assert near_copy_links(documents, printed).count() == 0
