"""Ranked lexical search the other way round: documents stream through an index of the items.

The items, a set far smaller than the corpus, are indexed by term and broadcast; each document's
counts of item terms pass the index once, and every task keeps a bounded heap per item. Heaps are
merged in the end, so k rows per item and task travel and no document does.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.llm.common import map_slices, stored

RUN_BYTES = 1 << 20
CELLS = 1 << 21
LATEST = np.iinfo(np.int64).max
#: every byte that is not in a term becomes a space; A-Z become small letters
TO_TERMS = bytes(
    byte + 32 if 0x41 <= byte <= 0x5A else byte if byte >= 0x80 or chr(byte).isalnum() else 0x20 for byte in range(256)
)


def term_runs(text: str | None) -> Iterator[list[bytes]]:
    """Terms in order, in runs that bound the memory of very long texts."""
    data = (text or "").encode("utf-8").translate(TO_TERMS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + RUN_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def count_terms(documents: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of every row: all its terms, and how often it has the numbered ones."""
    shared = documents.sparkSession.sparkContext.broadcast(numbers)

    def handle(batch: pa.RecordBatch) -> dict[str, object]:
        number_of = shared.value.get
        sizes, terms, counts = [], [], []
        for text in batch.column(1).to_pylist():
            size, found = 0, Counter()
            for run in term_runs(text):
                size += len(run)
                found.update(map(number_of, run))
            found.pop(None, None)
            sizes.append(size)
            terms.append(list(found))
            counts.append(list(found.values()))
        return {"doc_id": batch.column(0), "n": sizes, "terms": terms, "counts": counts}

    schema = "doc_id long, n long, terms array<int>, counts array<int>"
    return map_slices(documents.select("doc_id", "text"), handle, schema)


def document_frequencies(counted: DataFrame, terms: int) -> np.ndarray:
    """In how many rows each numbered term is; tasks send one row per term they have met."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(), minlength=terms)
        met = np.flatnonzero(held)
        yield pa.record_batch({"term": pa.array(met, pa.int32()), "df": pa.array(held[met], pa.int64())})

    partial = counted.select("terms").mapInArrow(add_up, "term int, df long")
    out = np.zeros(terms, dtype=np.int64)
    for row in partial.groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[row.term] = row.df
    return out


@dataclass
class ItemIndex:
    """Items by term: `items[starts[t]:starts[t + 1]]` hold term t, whose weight is `weights[t]`."""

    starts: np.ndarray
    items: np.ndarray
    weights: np.ndarray
    count: int
    most_terms: int
    n_docs: int
    n_terms: int


class Heaps:
    """The k best documents per item: highest score, ties to the smaller id, ids that are null last."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.heaps: list[list[tuple]] = [[] for _ in range(items)]
        self.worst = np.zeros(items, dtype=np.int64)
        self.worst_id = np.full(items, -1, dtype=np.int64)

    def offer(self, ids: np.ndarray, known: np.ndarray, scores: np.ndarray) -> None:
        """Scores of documents (rows) for items (columns); only those above the item's worst are looked at."""
        tied = (scores == self.worst) & (scores > 0) & (ids[:, None] <= self.worst_id)
        better = (scores > self.worst) | tied
        for row, item in zip(*(part.tolist() for part in np.nonzero(better)), strict=True):
            heap = self.heaps[item]
            entry = (int(scores[row, item]), bool(known[row]), -int(ids[row]))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.worst[item], self.worst_id[item] = heap[0][0], -heap[0][2]

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for item, heap in enumerate(self.heaps):
            for score, known, minus_id in heap:
                yield item, -minus_id if known else None, score


def score_batch(
    index: ItemIndex, sizes: np.ndarray, ends: np.ndarray, terms: np.ndarray, counts: np.ndarray
) -> np.ndarray:
    """Scores (documents x items) of documents whose terms end at `ends` in the flat arrays; exact."""
    lengths = 10 + (90 * sizes * index.n_docs) // index.n_terms
    owner = np.repeat(np.arange(len(sizes)), np.diff(ends, prepend=0))
    values = index.weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * lengths[owner]))
    degree = index.starts[terms + 1] - index.starts[terms]
    stops = np.cumsum(degree)
    places = np.arange(stops[-1] if len(stops) else 0) + np.repeat(index.starts[terms] - stops + degree, degree)
    cells = np.repeat(owner * index.count, degree) + index.items[places]
    shape = len(sizes) * index.count
    if index.most_terms < 100_000:  # each value is below 2**36, so sums of so many are exact in doubles
        flat = np.bincount(cells, np.repeat(values, degree), shape).astype(np.int64)
    else:
        flat = np.zeros(shape, dtype=np.int64)
        np.add.at(flat, cells, np.repeat(values, degree))
    return flat.reshape(len(sizes), index.count)


def search_counts(counted: DataFrame, index: ItemIndex, k: int) -> DataFrame:
    """(item, doc_id, score): the k best rows per item of every task."""
    shared = counted.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        heaps = Heaps(own.count, k)
        most_rows = max(1, CELLS // own.count)
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            terms, counts = lists.values.to_numpy(), batch.column(3).values.to_numpy().astype(np.int64)
            shift = batch.column(3).offsets[0].as_py() - offsets[0]
            ids = batch.column(0).fill_null(LATEST).to_numpy()
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            sizes = batch.column(1).to_numpy()
            work = np.zeros(len(terms) + 1, dtype=np.int64)
            np.cumsum(own.starts[terms + 1] - own.starts[terms], out=work[1:])
            start = 0
            while start < batch.num_rows:
                # as many documents as keep both the score table and the postings met within bounds
                fit = int(np.searchsorted(work[offsets], work[offsets[start]] + CELLS, side="right")) - 1
                end = min(max(fit, start + 1), start + most_rows, batch.num_rows)
                low, high = offsets[start], offsets[end]
                scores = score_batch(
                    own, sizes[start:end], offsets[start + 1 : end + 1] - low, terms[low:high], counts[low + shift : high + shift]
                )
                heaps.offer(ids[start:end], known[start:end], scores)
                start = end
        rows = list(heaps.rows())
        columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        yield pa.record_batch(
            {
                "item": pa.array(columns[0], pa.int32()),
                "doc_id": pa.array(columns[1], pa.int64()),
                "score": pa.array(columns[2], pa.int64()),
            }
        )

    return counted.select("doc_id", "n", "terms", "counts").mapInArrow(run, "item int, doc_id long, score long")


def number_terms(items: list[Row]) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Numbers of the items' terms, and the items of each term in one array with starts."""
    numbers: dict[bytes, int] = {}
    pairs = [
        (numbers.setdefault(term, len(numbers)), at)
        for at, item in enumerate(items)
        for term in dict.fromkeys(term for run in term_runs(item.text) for term in run)
    ]
    pairs.sort()
    terms = np.array([term for term, _ in pairs], dtype=np.int64)
    starts = np.searchsorted(terms, np.arange(len(numbers) + 1))
    return numbers, starts, np.array([item for _, item in pairs], dtype=np.int64)


def rank_documents(documents: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = 16 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item by term weights.

    A term is a run of letters and digits, all characters beyond ASCII included; A-Z are lowered. A
    term's weight follows from its document frequency over all `documents`; frequent terms of long
    documents count less. Equal scores are ranked by smaller doc_id, null ids last; documents
    without an item's terms are not ranked for it. Null and empty texts have no terms and are not
    counted as documents. Repeated rows are documents, or items, of their own. Empty tables give no
    rows; other columns are ignored.

    Items are searched in blocks of about `block_bytes` of text, whose index is broadcast; a larger
    set of items takes more passes over the documents.
    """
    spark = documents.sparkSession
    asked = stored(items.select("item_id", F.coalesce("text", F.lit("")).alias("text"))).withColumn(
        "place", F.monotonically_increasing_id()
    )
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("place"), F.lit(blocks)) == block).orderBy("place").collect()
        numbers, starts, postings = number_terms(own)
        counted = stored(count_terms(documents, numbers))
        total = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
        n_docs = total.docs
        frequencies = document_frequencies(counted, len(numbers))
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in frequencies.tolist()]
        most = int(np.bincount(postings, minlength=1).max())
        index = ItemIndex(
            starts, postings, np.array(weights, dtype=np.int64), max(1, len(own)), most, n_docs, max(1, total.terms or 0)
        )
        best = search_counts(counted, index, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(
            [(at, item.item_id) for at, item in enumerate(own)],
            f"item int, item_id {items.schema['item_id'].dataType.simpleString()}",
        )
        part = ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    return found
