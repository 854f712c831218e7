"""Statistics, exact bounds and held-out accuracy."""

from __future__ import annotations

import random
import re
from math import comb

import numpy as np
import pytest

from logloom.llm.quality import LEVELS, binomial_cdf, chosen_cutoff, judge_quality, safe_cutoff, text_stats
from logloom.llm.toxicity import drop_toxic, gram_buckets, score_toxicity, train_toxicity
from tests.llm.conftest import ODD_ROWS


def plain_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[at : at + 5]) for at in range(len(words) - 4)]
    covered = {at + step for at, own in enumerate(windows) if windows.count(own) > 1 for step in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        sum(1 for at, line in enumerate(lines) if line in lines[:at]),
        len(covered),
    )


def test_stats_equal_brute_force():
    random.seed(3)
    for _ in range(400):
        text = "".join(random.choice(["a ", "b ", "\n", "é# ", "\t", "\x1f", "\xa0", "| a\n"]) for _ in range(random.randint(0, 60)))
        assert text_stats(text)[:5] == plain_stats(text), repr(text)
    assert text_stats(None)[:5] == (0, 0, 0, 0, 0)


def test_binomial_tails():
    for n, p in ((1, 0.3), (7, 0.5), (40, 0.01), (300, 0.007), (300, 0.9)):
        total = 0.0
        for k in range(n + 1):
            total += comb(n, k) * p**k * (1 - p) ** (n - k)
            assert binomial_cdf(k, n, p) == pytest.approx(total, rel=1e-9, abs=1e-15)
    assert binomial_cdf(10**7 // 100 - 3000, 10**7, 0.01) < 1e-15


def test_cutoffs_keep_their_promise():
    """Over many holdouts the true loss is above the limit at most as often as allowed."""
    random_state = np.random.default_rng(1)
    shape = np.exp(-np.arange(LEVELS + 1) / 6.0)
    shape /= shape.sum()
    broken = 0
    for _ in range(400):
        good = random_state.multinomial(800, shape)
        broken += shape[safe_cutoff(good, 0.02, 0.05) + 1 :].sum() > 0.02
    assert broken / 400 <= 0.05 + 3 * (0.05 * 0.95 / 400) ** 0.5
    assert safe_cutoff(np.zeros(LEVELS + 1, dtype=int), 0.02, 0.05) == LEVELS


def test_choice_parts_bad_from_good():
    good, bad = np.zeros(LEVELS + 1, dtype=int), np.zeros(LEVELS + 1, dtype=int)
    good[10], bad[60] = 1000, 50
    assert chosen_cutoff(good, bad, 0.01, 0.05) == 59
    assert chosen_cutoff(good, np.zeros_like(bad), 0.01, 0.05) == LEVELS
    assert chosen_cutoff(good[:], good, 0.01, 0.05) == LEVELS


def test_quality_of_documents(spark, documents_of):
    random.seed(2)
    words = [f"word{at}" for at in range(500)]
    rows, labels = list(ODD_ROWS), []
    for at in range(2500):
        text = " ".join(random.choices(words, k=30))
        bad = at % 10 == 0
        rows.append((100 + at, text.replace(" ", " ## ") if bad else text))
        labels.append((100 + at, 0 if bad else 1, 0))
    labels += [(None, 1, 0), (100, None, None), (7, 1, 1)]
    frame = documents_of(rows, clashes=True)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = judge_quality(frame, table).collect()
    assert len(got) == len(rows)
    by_id = {row.doc_id: row for row in got}
    assert all(by_id[100 + at].kept == (at % 10 != 0) for at in range(2500))
    assert [by_id[at].base_failed for at in (1, 2, 3, 6)] == [True] * 4 and not by_id[6].kept
    assert by_id[6].n_words == 30_000 == by_id[6].n_repeat_words
    assert judge_quality(documents_of([]), table).count() == 0
    assert judge_quality(frame, table.limit(0)).where("kept = base_failed").count() == 0


def test_grams_do_not_depend_on_blocks(monkeypatch):
    import logloom.llm.toxicity as toxicity

    text = "Some  Text\nwith repeated repeated repeated grams ünd mehr " * 5
    whole = gram_buckets(text)
    monkeypatch.setattr(toxicity, "BLOCK_CHARS", 11)
    assert gram_buckets(text).tolist() == whole.tolist()
    assert gram_buckets(" some text\twith repeated repeated repeated grams ünd mehr" * 5).tolist() == whole.tolist()
    assert len(gram_buckets(None)) == len(gram_buckets(" \n")) == 0


def test_toxicity_learns_and_is_held_out(spark, documents_of):
    random.seed(4)
    words = ["".join(random.choices("abcdefgh", k=5)) for _ in range(400)]
    rows, labels = list(ODD_ROWS), []
    for at in range(600):
        text = random.choices(words, k=random.choice([12, 80, 300]))
        toxic = at % 5 == 0
        if toxic:
            for _ in range(max(2, len(text) // 20)):
                text[random.randrange(len(text))] = random.choice(["zwockig", "plurz", "ZWOCKEN"])
        rows.append((1000 + at, " ".join(text)))
        labels.append((1000 + at, 1, int(toxic)))
    labels += [(1001, 1, None), (None, 0, 1)]
    frame = documents_of(rows, clashes=True)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = train_toxicity(frame, table, max_rows=400)
    scores = {row.doc_id: row.score for row in score_toxicity(frame, model).collect()}
    import zlib

    wrong = [at for at in range(600) if zlib.crc32(str(1000 + at).encode()) % 3 == 1 and (scores[1000 + at] >= 0.7) != (at % 5 == 0)]
    assert len(wrong) <= 6
    assert 0 <= scores[1] == scores[2] == scores[3] < 0.7
    kept = drop_toxic(frame, model)
    assert kept.columns == frame.columns
    assert kept.count() == sum(scores[row[0]] < 0.7 for row in rows)
    again = train_toxicity(frame, table, max_rows=400)
    assert again.bias == model.bias and (again.weights == model.weights).all()
    assert score_toxicity(documents_of([]), model).count() == 0
    assert {row.score for row in score_toxicity(frame, train_toxicity(frame, table.limit(0))).collect()} == {0.5}


def test_held_out_labels_are_never_learnt(spark, documents_of):
    import zlib

    rows = [(at, f"some text of number {at} " * 3) for at in range(200)]
    labels = [(at, 1, at % 2) for at, _ in rows]
    changed = [(at, 1, 1 - toxic if zlib.crc32(str(at).encode()) % 3 == 1 else toxic) for at, _, toxic in labels]
    schema = "doc_id long, quality int, toxic int"
    one, two = (train_toxicity(documents_of(rows), spark.createDataFrame(own, schema)) for own in (labels, changed))
    assert one.bias == two.bias and (one.weights == two.weights).all()
