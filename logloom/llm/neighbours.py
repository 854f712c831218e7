"""Nearest neighbours by cosine: vantage-point trees per shard, through which queries stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.llm.common import probe_shards, stored

LEAF_ROWS = 256


class VantageTree:
    """A vantage-point tree over unit vectors; on the sphere the chord is a metric that orders as cosine.

    Each inner node has a vantage point and two halves by distance from it, each with its range of
    distances. Halves are cut by rank, so equal vectors can't make the tree deep. Rows are laid out
    so that every subtree is a run of rows, its vantage point first.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        self.order = np.arange(len(ids))
        self.nodes: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        self._grow(0, len(ids))
        self.ids, self.vectors = ids[self.order], vectors[self.order]
        self.norms = np.linalg.norm(self.vectors, axis=1)
        self.units = self.vectors / self.norms[:, None]
        self.slack = chord_slack(self.vectors.shape[1])

    def _grow(self, start: int, end: int) -> None:
        spans = [(start, end)]
        while spans:
            start, end = spans.pop()
            if end - start <= LEAF_ROWS:
                continue
            rows = self.order[start:end]
            # the point farthest from an arbitrary one lies at the rim and separates well
            rim = int(np.argmin(self.units[rows] @ self.units[rows[0]]))
            rows[0], rows[rim] = rows[rim], rows[0]
            apart = chord(self.units[rows[1:]] @ self.units[rows[0]])
            near = len(apart) // 2
            ranked = np.argpartition(apart, near)
            rows[1:], apart = rows[1:][ranked], apart[ranked]
            middle = start + 1 + near
            ranges = np.array([apart[:near].min(), apart[:near].max(), apart[near:].min(), apart[near:].max()])
            self.nodes[start, end] = (middle, ranges)
            spans += [(start + 1, middle), (middle, end)]

    def search(
        self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float
    ) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and cosines of each query's k best, -1 where there are fewer.

        A subtree is left out when the triangle inequality puts all of it farther than the k-th
        best so far divided by `factor`. At factor 1 nothing nearer is missed.
        """
        best = Best(self, query_ids, queries, k)
        self._visit(0, len(self.ids), np.arange(len(queries)), best, factor)
        return best.rows, best.scores

    def _visit(self, start: int, end: int, some: np.ndarray, best: Best, factor: float) -> None:
        if not len(some) or start >= end:
            return
        if (start, end) not in self.nodes:
            best.offer(start, end, some)
            return
        middle, (near_low, near_high, far_low, far_high) = self.nodes[start, end]
        best.offer(start, start + 1, some)
        apart = chord(best.units[some] @ self.units[start])
        halves = ((start + 1, middle, near_low, near_high), (middle, end, far_low, far_high))
        nearer = np.abs(apart - (near_low + near_high) / 2) <= np.abs(apart - (far_low + far_high) / 2)
        for turn in (0, 1):
            for half, (low_row, high_row, low, high) in enumerate(halves):
                own = nearer == (half == turn)
                gap = np.maximum(np.maximum(low - apart[own], apart[own] - high), 0.0)
                open_ = gap <= best.radius(some[own]) / factor + self.slack
                self._visit(low_row, high_row, some[own][open_], best, factor)


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def chord_slack(width: int) -> float:
    """What rounding may add to or take from a gap less a radius, of vectors with `width` components.

    A cosine is off by less than 2 * width + 16 units of the last place, and the root of twice
    that is the most a chord is off, as it is between equal vectors. Three chords are compared:
    the query's, the half's bound and the radius.
    """
    return 3 * float(np.sqrt(2 * (2 * width + 16) * np.finfo(np.float64).eps))


class Best:
    """The k best rows so far of every query: largest cosine, ties to the smaller id."""

    def __init__(self, tree: VantageTree, query_ids: np.ndarray, queries: np.ndarray, k: int) -> None:
        self.tree, self.query_ids, self.queries, self.k = tree, query_ids, queries, k
        self.norms = np.linalg.norm(queries, axis=1)
        self.units = queries / self.norms[:, None]
        self.rows = np.full((len(queries), k), -1, dtype=np.int64)
        self.scores = np.full((len(queries), k), -np.inf)

    def radius(self, some: np.ndarray) -> np.ndarray:
        worst = self.scores[some, self.k - 1]
        return np.where(np.isneginf(worst), np.inf, chord(worst))

    def offer(self, start: int, end: int, some: np.ndarray) -> None:
        tree = self.tree
        # einsum adds up every pair in the same order, so equal vectors tie exactly; a matrix product may not
        products = np.einsum("ij,kj->ik", self.queries[some], tree.vectors[start:end], optimize=False)
        scores = products / (self.norms[some, None] * tree.norms[None, start:end])
        scores[self.query_ids[some, None] == tree.ids[None, start:end]] = -np.inf
        if end - start > 4 * self.k:
            # rows that can't be among the k best, ties included, need no sorting
            floor = np.maximum(np.partition(scores, -self.k, axis=1)[:, -self.k], self.scores[some, -1])
            rows, columns = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        else:
            rows, columns = np.nonzero(scores > -np.inf)
        for at in np.unique(rows):
            query, mine = some[at], columns[rows == at]
            held = self.rows[query] >= 0
            numbers = np.concatenate([self.rows[query][held], mine + start])
            values = np.concatenate([self.scores[query][held], scores[at, mine]])
            chosen = np.lexsort((tree.ids[numbers], -values))[: self.k]
            self.rows[query, : len(chosen)], self.scores[query, : len(chosen)] = numbers[chosen], values[chosen]


def usable(vector: str) -> Column:
    """Vectors with only finite components, not all zero."""
    column = F.col(vector)
    bad = F.exists(
        column,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
    )
    return column.isNotNull() & ~bad & F.exists(column, lambda x: x != 0)


def by_width(rows: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(components, ids, vectors as a matrix) of each length of vector among the rows."""
    sizes = rows["width"].to_numpy()
    for size in np.unique(sizes).tolist():
        some = rows.filter(pa.array(sizes == size))
        flat = some["vector"].combine_chunks() if isinstance(some, pa.Table) else some["vector"]
        yield size, some["vec_id"].to_numpy(), flat.flatten().to_numpy().reshape(-1, size)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    factor: float = 1.0,
    shard_rows: int = 16_384,
    id_column: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows by cosine of every query row.

    Rows are dealt by hash to shards of about `shard_rows`, each indexed by a vantage-point tree.
    Queries stream through every shard's tree, which is built once, where it is searched; each
    shard gives k rows per query, and the best k of them are ranked, ties to the smaller id. Larger `factor`s prune more and may
    miss neighbours; factor 1 is exact. Null, zero and non-finite vectors and null ids take no
    part, nor vectors of another length than the query's. Rows with the query's own id are not
    candidates; other repeated ids are candidates each. A repeated query id is searched once, with
    the smallest of its vectors. No rows, no results.
    """
    good = stored(
        vectors.select(
            F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("vector"), is_query.alias("q")
        )
        .where(F.col("vec_id").isNotNull() & usable("vector"))
        .select("vec_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"), "q")
    )
    queries = good.where("q").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    shards = max(1, -(-good.count() // shard_rows))
    width = F.size("vector")
    # repeated ids must not meet in one shard, so the row's place is dealt and not its id
    dealt = good.select(
        "vec_id",
        "vector",
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"),
        width.alias("width"),
    )

    def build(parts: list[pa.RecordBatch]) -> dict[int, VantageTree]:
        rows = pa.Table.from_batches(parts)
        return {
            size: VantageTree(ids[order], stack[order])
            for size, ids, stack in by_width(rows)
            for order in [np.argsort(ids, kind="stable")]
        }

    def probe(trees: dict[int, VantageTree], part: pa.RecordBatch) -> dict[str, object]:
        found = []
        for size, ids, stack in by_width(part):
            if size in trees:
                rows, scores = trees[size].search(ids, stack, k, factor)
                hit = rows >= 0
                found.append((np.repeat(ids, k)[hit.ravel()], trees[size].ids[rows[hit]], scores[hit]))
        columns = zip(*found, strict=True) if found else ((np.zeros(0),),) * 3
        return dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, columns), strict=True))

    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asked = queries.select("vec_id", "vector", every_shard.alias("shard"), width.alias("width"))
    found = probe_shards(dealt, asked, shards, build, probe, "query_id long, vec_id long, score double")

    # the window's limit is applied in every task before the shuffle, so k rows per query travel
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
