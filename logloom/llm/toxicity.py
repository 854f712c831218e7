"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import SLICE_ROWS, map_slices, stored

GRAMS = (3, 4, 5)
TIMES = (2, 3, 5)
BUCKET_BITS = 20
TOXIC_SHARE = 0.25
BLOCK_CHARS = 1 << 20
_FACTORS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


def bucket_of(value: np.ndarray) -> np.ndarray:
    """The leading bits of mixed 64-bit values."""
    value = (value ^ (value >> np.uint64(29))) * _FACTORS[1]
    value = (value ^ (value >> np.uint64(32))) * _FACTORS[2]
    return (value >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32)


def gram_buckets(text: str | None) -> np.ndarray:
    """Sorted hash buckets of the character n-grams that a text holds at all, and `TIMES` times or more.

    Capitals are lower-cased, white space is one space, and the text stands between spaces. The
    whole text is read, in blocks that overlap by the longest n-gram.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint32)
    codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    grams, counts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    for start in range(0, len(codes), BLOCK_CHARS):
        found = [grams]
        for n in GRAMS:
            # starts in this block only; the last ones reach into the next block
            block = codes[start : start + BLOCK_CHARS + n - 1]
            if len(block) < n:
                continue
            value = np.full(len(block) - n + 1, n, dtype=np.uint64)
            for at in range(n):
                value *= _FACTORS[0]
                value += block[at : len(block) - n + 1 + at]
            found.append(bucket_of(value))
        once = np.concatenate(found)
        weights = np.concatenate([counts, np.ones(len(once) - len(grams), dtype=np.int64)]) if start else None
        if weights is None:
            grams, counts = np.unique(once, return_counts=True)
        else:
            grams, place = np.unique(once, return_inverse=True)
            counts = np.bincount(place, weights=weights).astype(np.int64)
    levels = [grams]
    for times in TIMES:
        often = grams[counts >= times].astype(np.uint64)
        levels.append(bucket_of((often + np.uint64(times << 32)) * _FACTORS[0]))
    return np.unique(np.concatenate(levels))


@dataclass(frozen=True)
class ToxicityModel:
    """Weights per bucket, with the log-count ratios multiplied in, and a bias."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """Probability of label 1; a text without words scores by the bias alone."""
        total = float(self.weights[gram_buckets(text)].sum(dtype=np.float64)) + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -500.0, 500.0))))


def log_count_ratios(buckets: list[np.ndarray], labels: np.ndarray, min_docs: int, errors: float) -> np.ndarray:
    """Log of a bucket's share in label 1 over its share in label 0, drawn to 0 by `errors` standard errors.

    Shares are smoothed by one; what chance alone explains, and buckets of few documents, get 0.
    """
    counts = np.zeros((2, 1 << BUCKET_BITS))
    for own, label in zip(buckets, labels, strict=True):
        counts[int(label)][own] += 1
    documents = np.bincount(labels.astype(np.int64), minlength=2)
    ratios = np.log((counts[1] + 1) / (documents[1] + 2)) - np.log((counts[0] + 1) / (documents[0] + 2))
    spread = np.sqrt(1 / (counts[0] + 1) + 1 / (counts[1] + 1))
    sure = np.sign(ratios) * np.maximum(0.0, np.abs(ratios) - errors * spread)
    return np.where(counts.sum(axis=0) >= min_docs, sure, 0.0)


def fit(
    buckets: list[np.ndarray],
    labels: np.ndarray,
    prior: float | None = None,
    epochs: int = 12,
    rate: float = 4.0,
    min_docs: int = 3,
    errors: float = 1.5,
) -> ToxicityModel:
    """Logistic regression on features scaled by their log-count ratios.

    Steps are divided by the squared length of the document's scaled features, so that long
    documents don't outweigh short ones, and taken in a fixed random order. `prior` is the share of
    label 1 among all labels; where the sample has another, the bias is moved to it at the end.
    """
    ratios = log_count_ratios(buckets, labels, min_docs, errors)
    known = [own[ratios[own] != 0.0] for own in buckets]
    lengths = [1.0 + float(ratios[own] @ ratios[own]) for own in known]
    positive = float(labels.sum())
    bias = float(np.log((positive + 1.0) / (len(labels) - positive + 1.0)))
    learned = np.zeros(len(ratios))
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for at in order.permutation(len(known)):
            own = known[at]
            value = float(learned[own] @ ratios[own]) + bias
            error = 1.0 / (1.0 + np.exp(-np.clip(value, -500.0, 500.0))) - labels[at]
            step = rate * error / lengths[at]
            learned[own] -= step * ratios[own]
            bias -= step
    if prior is not None and 0 < positive < len(labels) and 0 < prior < 1:
        bias += float(np.log(prior / (1 - prior)) - np.log(positive / (len(labels) - positive)))
    return ToxicityModel((learned * ratios).astype(np.float32), bias)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are kept from training, by their id; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, max_rows: int) -> tuple[DataFrame, float | None]:
    """(doc_id, toxic, text) of at most `max_rows` labelled documents, and the share of label 1.

    `TOXIC_SHARE` of the rows at most are toxic; each class is taken in hash order of its ids. Ids
    without a label, null labels and held-out rows take no part; an id with both labels counts as
    toxic; of different texts with one id the smallest is taken.
    """
    known = stored(
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    prior = known.agg(F.avg("toxic")).first()[0]
    toxic_rows = int(max_rows * TOXIC_SHARE)
    parts = [
        known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        for label, rows in ((0, max_rows - toxic_rows), (1, toxic_rows))
    ]
    ids = F.broadcast(stored(parts[0].unionByName(parts[1])))  # bounded by max_rows
    texts = (
        documents.select("doc_id", "text")
        .join(ids, "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    )
    return texts, prior


def train_toxicity(documents: DataFrame, labels: DataFrame, max_rows: int = 6000, **options: float) -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows that are not held out, in one task.

    `max_rows` bounds the sample and with it the task's memory (some 20 kB a document). Without
    any labels every score is one half.
    """
    sample, prior = labelled_sample(documents, labels, max_rows)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS).to_pydict()
                rows += [
                    (doc_id, toxic, gram_buckets(text))
                    for doc_id, toxic, text in zip(part["doc_id"], part["toxic"], part["text"], strict=True)
                ]
        rows.sort(key=lambda row: row[0])
        model = fit([row[2] for row in rows], np.array([row[1] for row in rows], dtype=np.float64), prior, **options)
        yield pa.RecordBatch.from_pydict({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    rows = sample.repartition(1).mapInArrow(train, "weights binary, bias double").collect() if prior is not None else []
    if not rows:
        return ToxicityModel(np.zeros(1 << BUCKET_BITS, dtype=np.float32), 0.0)
    return ToxicityModel(np.frombuffer(bytes(rows[0]["weights"]), dtype=np.float32), rows[0]["bias"])


def score_toxicity(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row from its whole text; the model has a fixed size of 4 MB."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def handle(batch: pa.RecordBatch) -> dict[str, object]:
        known = shared.value
        return {"doc_id": batch.column(0), "score": [known.score(text) for text in batch.column(1).to_pylist()]}

    return map_slices(documents.select("doc_id", "text"), handle, "doc_id long, score double")


def drop_toxic(documents: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The documents that score below `threshold`, with all their columns and in place."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                yield part.filter(pa.array([known.score(text) < threshold for text in texts], type=pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
