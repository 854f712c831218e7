"""Hard negatives of anchor vectors, by bounds on scores from summaries of vector segments.

Cut into segments, a vector is summed up by each segment's mean and deviation. For two vectors the
inner product over a segment of w components lies within w * (mean * mean -+ deviation * deviation).
Bounds over few long segments are cheap and discard most rows; the others are bounded again over
segments of half the length, and so on, and only what is left is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.llm.common import probe_shards, shard_count, stored

SCALE = 256
FINEST = 4
#: inner products of vectors up to this length fit 64 bits
MOST_NORM = float(2**31)
EXACT_NORMS = float(2**52)
NEVER = np.iinfo(np.int64).min


class Summaries:
    """Means and deviations of a table of vectors over 1, 2, 4, ... segments."""

    def __init__(self, vectors: np.ndarray) -> None:
        width = vectors.shape[1]
        self.levels = []
        parts = 1
        while parts == 1 or width // parts >= FINEST:
            edges = np.linspace(0, width, parts + 1).astype(int)
            sizes = np.diff(edges).astype(np.float64)
            means = np.add.reduceat(vectors, edges[:-1], axis=1) / sizes
            squares = np.add.reduceat((vectors - np.repeat(means, np.diff(edges), axis=1)) ** 2, edges[:-1], axis=1)
            self.levels.append((sizes, means, np.sqrt(squares / sizes)))
            parts *= 2


class Segmented:
    """The rows of one shard with equal width, ready to be searched."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.rows, self.ids, self.labels, self.vectors = rows, ids, labels, vectors
        self.norms = np.linalg.norm(vectors, axis=1)
        self.most_norm = float(self.norms.max())
        self.levels = Summaries(vectors).levels

    def scores(self, some: np.ndarray, anchor: np.ndarray, norm: float) -> np.ndarray:
        """Exact integer inner products."""
        if norm * self.most_norm < EXACT_NORMS:
            return (self.vectors[some] @ anchor).astype(np.int64)
        return self.vectors[some].astype(np.int64) @ anchor.astype(np.int64)

    def best(
        self, some: np.ndarray, anchor: np.ndarray, own: list, k: int, low: int = NEVER, high: int | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """The k of the rows `some` with the highest scores from `low` to `high`, ties to the smaller id.

        `own` holds the anchor's summaries by level.
        """
        norm = float(np.linalg.norm(anchor))
        floor = low
        for (sizes, means, deviations), (own_means, own_deviations) in zip(self.levels, own, strict=True):
            if len(some) <= 4 * k:
                break
            middle = means[some] @ (sizes * own_means)
            spread = deviations[some] @ (sizes * own_deviations)
            spread += 1e-9 * norm * self.norms[some] + 1e-6  # covers rounding
            upper = middle + spread
            kept = upper >= floor
            if high is not None:
                kept &= middle - spread <= high
            some, upper = some[kept], upper[kept]
            if len(some) > 4 * k:
                # scores of the most promising rows raise the bar for the others
                leading = some[np.argpartition(upper, -2 * k)[-2 * k :]]
                known = self.scores(leading, anchor, norm)
                known = known[(known >= low) & (known <= high)] if high is not None else known
                if len(known) >= k:
                    floor = max(floor, int(np.partition(known, -k)[-k]))
                    some = some[upper >= floor]
        values = self.scores(some, anchor, norm)
        inside = values >= floor
        if high is not None:
            inside &= values <= high
        some, values = some[inside], values[inside]
        order = np.lexsort((self.ids[some], -values))[:k]
        return some[order], values[order]


def _stack(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1)


def _by_width(parts: list[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for part in parts:
        widths = part["width"].to_numpy()
        for width in np.unique(widths):
            yield int(width), part.filter(pa.array(widths == width))


def build_shard(parts: list[pa.RecordBatch]) -> dict[int, Segmented]:
    """Rows of one shard as one table per vector width."""
    held: dict[int, list[pa.RecordBatch]] = {}
    for width, part in _by_width(parts):
        held.setdefault(width, []).append(part)
    return {
        width: Segmented(
            *(np.concatenate([part[name].to_numpy() for part in own]) for name in ("row", "vec_id", "label")),
            np.concatenate([_stack(part["vector"]) for part in own]),
        )
        for width, own in held.items()
    }


def _anchors(index: dict[int, Segmented], batch: pa.RecordBatch) -> Iterator[tuple]:
    """(table, anchor's columns, its vector, its summaries by level) of a batch of anchors."""
    for width, part in _by_width([batch]):
        if width not in index:
            continue
        vectors = _stack(part["vector"])
        levels = Summaries(vectors).levels
        for at, (row, label, needs) in enumerate(
            zip(part["row"].to_pylist(), part["label"].to_pylist(), part["needs"].to_pylist(), strict=True)
        ):
            own = [(means[at], deviations[at]) for _, means, deviations in levels]
            yield index[width], row, label, needs, vectors[at], own


def find_positives(k: int):
    def probe(index: dict[int, Segmented], batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"anchor": [], "vec_id": [], "score": []}
        for table, row, label, _, vector, own in _anchors(index, batch):
            some = np.flatnonzero((table.labels == label) & (table.rows != row))
            found, scores = table.best(some, vector, own, k)
            out["anchor"] += [row] * len(found)
            out["vec_id"] += table.ids[found].tolist()
            out["score"] += scores.tolist()
        return out

    return probe


def find_negatives(k: int, least: int, most: int):
    def probe(index: dict[int, Segmented], batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"anchor": [], "need": [], "vec_id": [], "score": []}
        for table, row, label, needs, vector, own in _anchors(index, batch):
            some = np.flatnonzero(table.labels != label)
            for need in dict.fromkeys(needs):
                low, high = -(-least * need // 100), most * need // 100
                if low > high:
                    continue
                found, scores = table.best(some, vector, own, k, low, high)
                out["anchor"] += [row] * len(found)
                out["need"] += [need] * len(found)
                out["vec_id"] += table.ids[found].tolist()
                out["score"] += scores.tolist()
        return out

    return probe


def scaled(vector: str) -> Column:
    """floor(256 * x) of every component, still a double."""

    def one(x: Column) -> Column:
        own = F.lit(float(SCALE)) * x.cast("double")
        return F.when(F.abs(own) < 2.0**62, F.floor(own).cast("double")).otherwise(own)

    return F.transform(vector, one)


def mine_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    n_positives: int = 5,
    n_negatives: int = 10,
    least: int = 30,
    most: int = 90,
    shard_rows: int = 65_536,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components are scaled to floor(256 * x), a score is the integer inner product. An anchor's
    positives are the best other rows of its label; per positive the best rows of other labels
    follow whose score is between `least` and `most` percent of the positive's. Higher scores come
    first, ties to the smaller id. Rows with a null id, label or vector, or a null or non-finite
    component take no part, nor do scaled vectors longer than 2**31, whose scores may not fit 64
    bits. Vectors only meet those of their own width. Repeated ids are rows of their own, anchors
    included. Anchors without positives or fitting negatives, and empty tables, give no rows.

    Rows stay in shards of at most about `shard_rows`; anchors pass every shard as a stream, first
    for the positives and then, with the scores found, for the negatives.
    """
    column = F.col(vector)
    finite = ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    short = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x) < MOST_NORM**2
    good = stored(
        vectors.select(
            F.col(id_column).cast("long").alias("vec_id"),
            (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
            F.when(column.isNotNull() & finite, scaled(vector)).alias("vector"),
            is_anchor.alias("anchor"),
        )
        .where("vec_id IS NOT NULL AND label IS NOT NULL AND size(vector) > 0")
        .where(short)
        .select("vec_id", "label", "vector", F.coalesce("anchor", F.lit(False)).alias("anchor"))
    )
    numbered = good.withColumn("row", F.monotonically_increasing_id()).withColumn("width", F.size("vector"))
    shards = shard_count(good, shard_rows)
    names = ["row", "vec_id", "label", "vector", "width", "needs"]
    rows = numbered.withColumn("needs", F.expr("array()").cast("array<long>")).select(
        F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), *names
    )
    anchors = numbered.where("anchor")

    def probes(asked: DataFrame) -> DataFrame:
        return asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), *names)

    first = probe_shards(
        rows,
        probes(anchors.withColumn("needs", F.expr("array()").cast("array<long>"))),
        shards,
        build_shard,
        find_positives(n_positives),
        "anchor long, vec_id long, score long",
    )
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    positives = stored(
        first.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n_positives)
    )
    needs = positives.groupBy("anchor").agg(F.array_sort(F.collect_set("score")).alias("needs"))
    second = probe_shards(
        rows,
        probes(anchors.join(needs.withColumnRenamed("anchor", "row"), "row")),
        shards,
        build_shard,
        find_negatives(n_negatives, least, most),
        "anchor long, need long, vec_id long, score long",
    )
    best = Window.partitionBy("anchor", "need").orderBy(F.desc("score"), "vec_id")
    negatives = second.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_negatives)
    return (
        positives.select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("need"))
        .join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
        .join(negatives, ["anchor", "need"])
        .select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("vec_id").alias("negative_id"),
            F.col("need").alias("positive_score"),
            F.col("score").alias("negative_score"),
        )
    )
