"""Quality rules whose cutoffs are chosen so that few good documents are lost in any stratum."""

from __future__ import annotations

from collections import Counter
from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import broadcast_checked, map_slices, source_key, stored, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEVELS = 400
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
STAT_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_cries")


def repeated_words(words: list[bytes]) -> int:
    """Words covered by `WINDOW`-word windows that the text holds twice or more."""
    if len(words) <= WINDOW:
        return 0
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(word) + 1 for word in words], out=starts[1:])
    ends = (starts[WINDOW:] - 1).tolist()
    windows = [joined[start:end] for start, end in zip(starts.tolist(), ends, strict=False)]
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    again = np.fromiter((counts[window] > 1 for window in windows), bool, len(windows))
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    edges[: len(again)] += again
    edges[WINDOW : WINDOW + len(again)] -= again
    return int((np.cumsum(edges)[: len(words)] > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The values of STAT_COLUMNS for a text; all 0 for a null or blank one."""
    words = words_of(text)
    if not words:
        return (0,) * len(STAT_COLUMNS)
    encoded = text.encode("utf-8", "surrogatepass")
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    return (
        len(words),
        len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(encoded) - len(encoded.translate(None, CAPITALS)),
        text.count("!"),
    )


def document_stats(documents: DataFrame) -> DataFrame:
    """doc_id, lang and a hash of the text with the values of STAT_COLUMNS, for every row."""

    def handle(batch: pa.RecordBatch) -> dict[str, object]:
        rows = [text_stats(text) for text in batch.column(3).to_pylist()]
        columns = zip(*rows, strict=True) if rows else [[]] * len(STAT_COLUMNS)
        return {
            "doc_id": batch.column(0),
            "lang": batch.column(1),
            "text_hash": batch.column(2),
            **{name: list(values) for name, values in zip(STAT_COLUMNS, columns, strict=True)},
        }

    narrow = documents.select("doc_id", "lang", F.xxhash64("text").alias("text_hash"), "text")
    schema = "doc_id long, lang string, text_hash long, " + ", ".join(f"{name} long" for name in STAT_COLUMNS)
    return map_slices(narrow, handle, schema)


def base_failed() -> Column:
    """Too few words, or over a fifth of them in windows that repeat."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_levels() -> dict[str, Column]:
    """Each rule's badness as a whole level from 0 to LEVELS; a document above the cutoff is rejected.

    The levels are fixed before any label is seen, which the bounds below rely on.
    """
    words = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / words

    def level(value: Column) -> Column:
        return F.least(F.greatest(F.ceil(value), F.lit(0)), F.lit(LEVELS)).cast("int")

    return {
        "symbols": level(F.col("n_symbols") / words * LEVELS),
        "dup_lines": level(F.col("n_dup_lines") * 20 / words * LEVELS),
        "repeats": level(F.col("n_repeat_words") / words * LEVELS),
        "capitals": level(F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)) * LEVELS),
        "cries": level(F.col("n_cries") / words * LEVELS),
        "long_words": level((mean - 4.0) * 20),
        "short_words": level((8.0 - mean) * 40),
    }


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable, 0 < p < 1.

    The terms of the shorter tail are added from the one next to k outwards until they no longer
    count; they fall at least geometrically, so millions of trials take a few thousand terms.
    """
    if k >= n:
        return 1.0
    upper = k >= n * p
    at = k + 1 if upper else k
    term = exp(lgamma(n + 1) - lgamma(at + 1) - lgamma(n - at + 1) + at * log(p) + (n - at) * log1p(-p))
    total = 0.0
    while term > 1e-17 * total and 0 <= at <= n:
        total += term
        if upper:
            term, at = term * (n - at) / (at + 1) * p / (1 - p), at + 1
        else:
            term, at = term * at / (n - at + 1) * (1 - p) / p, at - 1
    return 1.0 - total if upper else total


def safe_cutoff(histogram: np.ndarray, limit: float, error: float) -> int:
    """The strictest cutoff that, but with probability `error`, rejects at most `limit` of the good.

    `histogram` counts good holdout documents by level. Cutoffs are tested from the mildest on; each
    is accepted if so few rejections as were seen have a probability of at most `error` were the
    true rate `limit` (the exact one-sided binomial bound). The first that isn't ends the row, so
    the order of tests needs no further correction. LEVELS rejects nothing.
    """
    rejected = histogram.sum() - np.cumsum(histogram)
    total, cutoff = int(histogram.sum()), LEVELS
    while cutoff > 0 and binomial_cdf(int(rejected[cutoff - 1]), total, limit) <= error:
        cutoff -= 1
    return cutoff


def chosen_cutoff(good: np.ndarray, bad: np.ndarray, limit: float, error: float) -> int:
    """Of the safe cutoffs the one that parts bad from good best, the mildest of equals.

    All safe cutoffs hold at once, so any choice among them keeps the bound.
    """
    shares = [
        (histogram.sum() - np.cumsum(histogram)) / max(1, int(histogram.sum())) for histogram in (bad, good)
    ]
    gain = (shares[0] - shares[1])[safe_cutoff(good, limit, error) :]
    return int(LEVELS - np.argmax(gain[::-1]))


def rule_cutoffs(stats: DataFrame, labels: DataFrame, false_rejection: float, error: float) -> DataFrame:
    """One row per stratum (lang) with a cutoff per rule, from labelled documents.

    Good documents (quality 1) that pass the base rules are the holdout; equal texts count once, as
    copies are no independent trials. Each rule may lose an equal share of `false_rejection`, so
    their union loses no more than that; `error` is split evenly over all strata and rules
    (Bonferroni), so all bounds hold at once. A stratum with few labels rejects nothing. Ids with
    both labels count as good.
    """
    rules = rule_levels()
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    held = (
        stats.where(~base_failed())
        .join(known, "doc_id")
        .groupBy("stratum", "text_hash")
        .agg(F.max("quality").alias("quality"), *[F.max(level).alias(rule) for rule, level in rules.items()])
    )
    entries = held.select(
        "stratum",
        "quality",
        F.explode(
            F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("level")) for rule in rules])
        ).alias("entry"),
    ).select("stratum", "quality", "entry.rule", "entry.level")
    counts = stored(entries.groupBy("stratum", "quality", "rule", "level").count())
    share = false_rejection / len(rules)
    chance = error / max(1, counts.select("stratum").distinct().count() * len(rules))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        histograms = np.zeros((2, LEVELS + 1), dtype=np.int64)
        np.add.at(histograms, (group["quality"].to_numpy(np.int64), group["level"].to_numpy(np.int64)), group["count"])
        cutoff = chosen_cutoff(histograms[1], histograms[0], share, chance)
        own = group.iloc[0]
        return pd.DataFrame({"stratum": [own["stratum"]], "rule": [own["rule"]], "cutoff": [cutoff]})

    chosen = counts.groupBy("stratum", "rule").applyInPandas(choose, "stratum string, rule string, cutoff int")
    return chosen.groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"{rule}_cutoff") for rule in rules]
    )


def judge_quality(
    documents: DataFrame, labels: DataFrame, false_rejection: float = 0.05, error: float = 0.05
) -> DataFrame:
    """doc_id, STAT_COLUMNS, base_failed and kept for every row of `documents`.

    kept is false where the base rules fail or a rule's level is above its stratum's cutoff. With
    probability 1 - `error` at most `false_rejection` of the good documents of any stratum that pass
    the base rules are lost. A null lang is a stratum; a stratum without labels only has the base
    rules. Null and blank texts fail the base rules. Rows with null or repeated ids are judged each.
    """
    stats = stored(document_stats(documents).withColumn("stratum", source_key("lang")))
    rules = rule_levels()
    cutoffs = broadcast_checked(stored(rule_cutoffs(stats, labels, false_rejection, error)))
    rejected = F.lit(False)
    for rule, level in rules.items():
        rejected = rejected | (level > F.coalesce(F.col(f"{rule}_cutoff"), F.lit(LEVELS)))
    return stats.join(cutoffs, "stratum", "left").select(
        "doc_id", *STAT_COLUMNS, base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept")
    )
