"""Ranked lexical search against brute force."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from logloom.llm.lexical import rank_documents, term_runs
from tests.llm.conftest import ODD_ROWS

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(documents, items, k=10):
    said = [(doc_id, terms(text)) for doc_id, text, *_ in documents]
    n_docs = sum(1 for _, own in said if own)
    n_terms = sum(len(own) for _, own in said)
    found = []
    for item_id, text in items:
        scores = []
        for doc_id, own in said:
            score = 0
            for term in set(terms(text)):
                tf = own.count(term)
                if tf:
                    df = sum(1 for _, other in said if term in other)
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
                    score += w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + 90 * len(own) * n_docs // n_terms)))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        found += [(item_id, rank, one[3], -one[0]) for rank, one in enumerate(sorted(scores)[:k], 1)]
    return sorted(found, key=str)


def corpus():
    state = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "δelta", "漢字", "e5", "rare", "the", "of", "x"]
    rows = [(at, state.choice([" ", "_", ", ", "\n"]).join(state.choices(words, k=state.randint(1, 30)))) for at in range(120)]
    rows += [(200 + at, rows[7][1]) for at in range(40)]  # copies with equal scores
    rows += [(300, "the rare"), (300, "the rare"), (None, "rare rare the"), (None, "rare rare the"), (-5, "rare rare the")]
    return [*rows, *ODD_ROWS]


ITEMS = [(1, "the RARE of"), (2, None), (3, ""), (None, "alpha, beta"), (5, "漢字 δelta"), (5, "漢字 δelta"), (7, "unknown"), (8, rf"{'word ' * 50}long")]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 40}, {"k": 3}])
def test_equals_brute_force(spark, documents_of, monkeypatch, options):
    import logloom.llm.lexical as lexical

    monkeypatch.setattr(lexical, "CELLS", 64)
    rows = corpus()
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("rank", F.lit("x"))
    got = rank_documents(documents_of(rows, clashes=True).repartition(5), items, **options).collect()
    assert sorted((tuple(row) for row in got), key=str) == brute(rows, ITEMS, options.get("k", 10))


def test_empty_tables(spark, documents_of):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rank_documents(documents_of([]), items).count() == 0
    assert rank_documents(documents_of(ODD_ROWS), items.limit(0)).count() == 0
    assert rank_documents(documents_of([(1, None), (2, " ")]), items).count() == 0


def test_long_texts_in_runs(monkeypatch):
    import logloom.llm.lexical as lexical

    text = "ab cde f\tghi—j KLM " * 50
    whole = [term for run in term_runs(text) for term in run]
    monkeypatch.setattr(lexical, "RUN_BYTES", 5)
    assert [term for run in term_runs(text) for term in run] == whole == [term.encode() for term in terms(text)]
