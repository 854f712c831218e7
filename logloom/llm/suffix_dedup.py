"""Removal of repeated byte strings, by deep-shallow sorting of the suffixes at shared anchors.

Sorting every suffix of a corpus is out of reach, and only those count that share a long prefix
with another. Winnowing finds them: in each string of `length` bytes the gram with the smallest
hash is its anchor, chosen by the string alone, so equal strings have anchors at the same place.
Anchors whose gram occurs once are done. The others are sorted by what follows them and by what
precedes them; longest common prefixes on both sides then tell how far each match reaches.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import map_slices, stored, worker_cache

GRAM = 100
CHUNK = 1 << 16
PLACE_BITS = 20
FACTOR = 0x9E3779B97F4A7C15
SHALLOW = 64
STEP = 8
_MASK = (1 << 64) - 1


def _powers(base: int, count: int) -> np.ndarray:
    """The first powers of a base modulo 2**64, kept by the worker."""
    held = worker_cache("powers")
    if len(held.get(base, ())) < count:
        out = np.full(count, base, dtype=np.uint64)
        out[0] = 1
        held[base] = np.cumprod(out, dtype=np.uint64)
    return held[base]


def anchors(data: bytes, length: int, gram: int = GRAM) -> list[int]:
    """Places of the anchors of all `length`-byte strings of `data`, in order.

    The anchor of a string is its `gram`-byte substring of smallest hash, the last of equals.
    """
    width = length - gram + 1
    size = len(data) - gram + 1
    if len(data) < length:
        return []
    span = CHUNK + width - 1
    powers = _powers(FACTOR, span + gram)
    inverse = _powers(pow(FACTOR, -1, 1 << 64), span + gram)
    found: list[int] = []
    for start in range(0, size - width + 1, CHUNK):
        grams = min(span, size - start)
        values = np.frombuffer(data, np.uint8, grams + gram - 1, start).astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * powers[: len(values)], out=sums[1:])
        ranks = (sums[gram:] - sums[:grams]) * inverse[:grams]
        ranks ^= ranks >> np.uint64(32)
        ranks *= np.uint64(0xD6E8FEB86659FD93)
        ranks ^= ranks >> np.uint64(29)
        # the leading hash bits, then the place from behind, so that the last of equals is smallest
        ranks >>= np.uint64(PLACE_BITS)
        ranks <<= np.uint64(PLACE_BITS)
        ranks |= np.uint64((1 << PLACE_BITS) - 1) - np.arange(grams, dtype=np.uint64)
        reach = 1
        while 2 * reach <= width:
            ranks = np.minimum(ranks[:-reach], ranks[reach:])
            reach *= 2
        if reach < width:
            ranks = np.minimum(ranks[: len(ranks) - (width - reach)], ranks[width - reach :])
        changed = np.ones(len(ranks), dtype=bool)
        changed[1:] = ranks[1:] != ranks[:-1]
        places = (1 << PLACE_BITS) - 1 - (ranks[changed] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64) + start
        found += [place for place in places.tolist() if not found or place > found[-1]]
    return found


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    size = min(len(a), len(b))
    differ = int.from_bytes(a[:size], "big") ^ int.from_bytes(b[:size], "big")
    return size - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Patricia trie that orders strings with a long common prefix by few looks at them.

    Inner nodes are [depth, {byte: child}], leaves lists of equal strings' numbers. To insert, the
    trie is walked by branching bytes alone; one comparison with the leaf met tells how deep the new
    string follows the old ones, and there it branches off.
    """

    END = -1

    def __init__(self, strings: list[bytes], first: int) -> None:
        self.strings = strings
        self.root: list | tuple = (first,), [first]

    def _byte(self, number: int, depth: int) -> int:
        own = self.strings[number]
        return own[depth] if depth < len(own) else self.END

    @staticmethod
    def _is_leaf(node) -> bool:
        return isinstance(node, tuple)

    def insert(self, number: int) -> None:
        node = self.root
        while not self._is_leaf(node):
            node = node[1].get(self._byte(number, node[0])) or next(iter(node[1].values()))
        other = node[0][0]
        depth = common_prefix(self.strings[number], self.strings[other])
        if depth == len(self.strings[number]) == len(self.strings[other]):
            node[1].append(number)
            return
        leaf = ((number,), [number])
        parent, node = None, self.root
        while not self._is_leaf(node) and node[0] < depth:
            parent, node = node, node[1][self._byte(number, node[0])]
        if not self._is_leaf(node) and node[0] == depth:
            node[1][self._byte(number, depth)] = leaf
            return
        branch = [depth, {self._byte(other, depth): node, self._byte(number, depth): leaf}]
        if parent is None:
            self.root = branch
        else:
            parent[1][self._byte(number, parent[0])] = branch

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if self._is_leaf(node):
                out += node[1]
            else:
                stack += [child for _, child in sorted(node[1].items(), reverse=True)]
        return out


def deep_shallow_sort(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> list[int]:
    """Numbers of `strings` in byte order; all agree in their first `depth` bytes.

    Multikey quicksort, `STEP` bytes at a time, down to `shallow` bytes below `depth`; groups that
    still agree there are ordered by a blind trie.
    """
    limit, out = depth + shallow, []
    stack = [(list(range(len(strings))), depth)]
    while stack:
        numbers, at = stack.pop()
        if len(numbers) == 1:
            out.append(numbers[0])
            continue
        if at >= limit:
            trie = BlindTrie(strings, numbers[0])
            for number in numbers[1:]:
                trie.insert(number)
            out += trie.ordered()
            continue
        keys = [strings[number][at : at + STEP] for number in numbers]
        pivot = keys[len(keys) // 2]
        below = [number for number, key in zip(numbers, keys, strict=True) if key < pivot]
        same = [number for number, key in zip(numbers, keys, strict=True) if key == pivot]
        above = [number for number, key in zip(numbers, keys, strict=True) if key > pivot]
        if above:
            stack.append((above, at))
        if len(pivot) < STEP:  # these strings end here and are equal
            stack += [([number], at) for number in reversed(same)]
        else:
            stack.append((same, at + STEP))
        if below:
            stack.append((below, at))
    return out


def reaches(before: list[bytes], after: list[bytes], length: int, gram: int = GRAM) -> tuple[list[int], list[int]]:
    """How far the matches of each context go to the left and right of its anchor; 0 without any.

    `after` starts at the anchor, `before` goes backwards from it; all agree in the gram. A match
    with another context counts if both sides together have `length` bytes. Contexts are merged in
    the order of decreasing common prefix to the right; of each smaller set every member looks at
    its two neighbours by left context in the larger set, as all others match less on both sides.
    So no pairs are listed: the work is n log n.
    """
    count = len(after)
    lefts, rights = [0] * count, [0] * count

    def meet(a: int, b: int, right: int) -> None:
        left = common_prefix(before[a], before[b])
        if left + right >= length:
            for own in (a, b):
                lefts[own], rights[own] = max(lefts[own], left), max(rights[own], right)

    if count == 2:
        meet(0, 1, common_prefix(after[0], after[1]))
        return lefts, rights
    order = deep_shallow_sort(after, gram)
    by_left = deep_shallow_sort(before)
    rank = [0] * count
    for place, number in enumerate(by_left):
        rank[number] = place
    joints = [(common_prefix(after[a], after[b]), at) for at, (a, b) in enumerate(zip(order, order[1:], strict=False))]
    joints.sort(key=lambda joint: -joint[0])
    owner, members = list(range(count)), [[rank[number]] for number in order]

    def find(at: int) -> int:
        while owner[at] != at:
            owner[at] = owner[owner[at]]
            at = owner[at]
        return at

    for right, at in joints:
        small, large = sorted((find(at), find(at + 1)), key=lambda one: len(members[one]))
        known = members[large]
        for own in members[small]:
            place = bisect_left(known, own)
            for other in known[max(0, place - 1) : place + 1]:
                meet(by_left[own], by_left[other], right)
        if 8 * len(members[small]) < len(known):
            for own in members[small]:
                insort(known, own)
        else:
            members[large] = sorted(known + members[small])
        members[small], owner[small] = [], large
    return lefts, rights


ANCHOR_SCHEMA = (
    "gram_hash long, high long, low long, text_1 long, text_2 long, place long, before int, after int"
)
CONTEXT_SCHEMA = "gram_hash long, high long, low long, before binary, after binary"
REACH_SCHEMA = "gram_hash long, high long, low long, before int, after int"


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def context_of(data: bytes, place: int, length: int) -> tuple[bytes, int]:
    """The bytes that a match of `length` around an anchor can have, and how many stand before it."""
    first = max(0, place - (length - GRAM))
    return data[first : place + length], place - first


def find_anchors(texts: DataFrame, length: int) -> DataFrame:
    """Every anchor with hashes of its gram (64 bits) and of its whole context (128 bits)."""

    def handle(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {name.split()[0]: [] for name in ANCHOR_SCHEMA.split(", ")}
        for text_1, text_2, data in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            for place in anchors(data or b"", length):
                context, before = context_of(data, place, length)
                whole = xxhash.xxh3_128_intdigest(context, seed=before)
                out["gram_hash"].append(signed(xxhash.xxh3_64_intdigest(data[place : place + GRAM])))
                out["high"].append(signed(whole >> 64))
                out["low"].append(signed(whole & _MASK))
                out["text_1"].append(text_1)
                out["text_2"].append(text_2)
                out["place"].append(place)
                out["before"].append(before)
                out["after"].append(len(context) - before)
        return out

    return map_slices(texts, handle, ANCHOR_SCHEMA)


def read_contexts(wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted contexts: (data, anchors) rows to one row per context."""

    def handle(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {name: [] for name in ("gram_hash", "high", "low", "before", "after")}
        for data, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for one in places:
                context, before = context_of(data, one["place"], length)
                out["gram_hash"].append(one["gram_hash"])
                out["high"].append(one["high"])
                out["low"].append(one["low"])
                out["before"].append(context[:before][::-1])
                out["after"].append(context[before:])
        return out

    return map_slices(wanted, handle, CONTEXT_SCHEMA)


def _sorted_reaches(contexts: DataFrame, length: int, group_contexts: int) -> DataFrame:
    """Reaches of all contexts of grams with boundedly many; several grams share a task."""
    groups = max(1, contexts.count() // group_contexts)

    def sort_group(group: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for gram_hash, own in group.groupby("gram_hash", sort=False):
            own = own.drop_duplicates(["high", "low"])
            if len(own) < 2:
                continue
            lefts, rights = reaches(own["before"].tolist(), own["after"].tolist(), length)
            parts.append(
                pd.DataFrame(
                    {"gram_hash": gram_hash, "high": own["high"], "low": own["low"], "before": lefts, "after": rights}
                )
            )
        if not parts:
            return pd.DataFrame({name.split()[0]: [] for name in REACH_SCHEMA.split(", ")})
        return pd.concat(parts)

    return (
        contexts.withColumn("group", F.pmod(F.xxhash64("gram_hash"), F.lit(groups)))
        .groupBy("group")
        .applyInPandas(sort_group, REACH_SCHEMA)
        .where("after > 0")
    )


def _counted_reaches(contexts: DataFrame, length: int) -> DataFrame:
    """The same for grams with any number of contexts: equal strings are counted by 128-bit hashes.

    Each context names all its `length`-byte strings; those named twice or more are repeated. The
    work is linear in the contexts, and counts are combined before the shuffle.
    """

    def handle(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {name: [] for name in ("gram_hash", "high", "low", "before", "s_high", "s_low")}
        for gram_hash, high, low, before, after in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            data = before[::-1] + after
            for start in range(len(data) - length + 1):
                digest = xxhash.xxh3_128_intdigest(data[start : start + length])
                row = (gram_hash, high, low, len(before) - start, signed(digest >> 64), signed(digest & _MASK))
                for name, value in zip(out, row, strict=True):
                    out[name].append(value)
        return out

    schema = "gram_hash long, high long, low long, before int, s_high long, s_low long"
    named = map_slices(contexts, handle, schema).where(F.col("before").between(0, length - GRAM))
    strings = ["gram_hash", "before", "s_high", "s_low"]
    often = named.groupBy(*strings).count().where("count > 1").drop("count")
    return (
        named.join(often, strings)
        .groupBy("gram_hash", "high", "low")
        .agg(F.max("before").alias("before"), (F.lit(length) - F.min("before")).cast("int").alias("after"))
    )


def repeated_spans(
    documents: DataFrame, length: int = 400, group_contexts: int = 4096, hot_contexts: int = 20_000
) -> tuple[DataFrame, DataFrame]:
    """(text_1, text_2, spans) of all texts with repeated bytes, and the input with both text keys.

    Spans are sorted, disjoint, not adjacent [start, end) byte ranges, each a union of strings of
    `length` bytes that also start elsewhere in the corpus. A text is known by two 64-bit hashes.
    """
    keyed = documents.select(
        "doc_id", F.xxhash64("text").alias("text_1"), F.xxhash64(F.lit(1), "text").alias("text_2"), "text"
    )
    data = F.col("text").cast("binary")
    found = stored(find_anchors(keyed.select("text_1", "text_2", data.alias("data")), length))
    context = ["gram_hash", "high", "low"]
    place = F.struct("text_1", "text_2", "place")
    classes = found.groupBy(*context).agg(
        F.count("*").alias("n"),
        F.min(place).alias("at"),
        F.first("before").alias("before"),
        F.first("after").alias("after"),
    )
    # anchors that occur once, most of them, end here
    grams = classes.groupBy("gram_hash").agg(
        F.sum("n").alias("total"), F.count("*").alias("contexts"), F.min("n").alias("rarest")
    )
    shared = stored(classes.join(grams.where("total > 1"), "gram_hash"))
    # a context that occurs again as a whole matches as far as it goes; others must be compared
    whole = shared.where("n > 1").select(*context, "before", "after")
    open_ = shared.where("contexts > 1 AND rarest = 1")
    wanted = open_.groupBy("at.text_1", "at.text_2").agg(
        F.collect_list(F.struct(*context, F.col("at.place").alias("place"))).alias("places")
    )
    one_each = keyed.groupBy("text_1", "text_2").agg(F.min("doc_id").alias("first"))
    asked = wanted.join(one_each, ["text_1", "text_2"])
    texts = keyed.join(
        asked.withColumnsRenamed({"text_1": "t1", "text_2": "t2"}),
        (F.col("text_1") == F.col("t1"))
        & (F.col("text_2") == F.col("t2"))
        & F.col("doc_id").eqNullSafe(F.col("first")),
    )
    contexts = stored(
        read_contexts(texts.select(data.alias("data"), "places"), length).join(
            open_.select("gram_hash", (F.col("contexts") > hot_contexts).alias("hot")).distinct(), "gram_hash"
        )
    )
    names = [name.split()[0] for name in CONTEXT_SCHEMA.split(", ")]
    compared = _sorted_reaches(contexts.where("NOT hot").select(*names), length, group_contexts)
    hot = contexts.where("hot").select(*names)
    if not hot.isEmpty():
        compared = compared.unionByName(_counted_reaches(hot, length))
    reached = stored(
        compared.join(whole.select(*context), context, "left_anti").unionByName(whole)
    ).withColumnsRenamed({"before": "left", "after": "right"})
    ranges = found.join(reached, context).select(
        "text_1",
        "text_2",
        (F.col("place") - F.col("left")).alias("start"),
        (F.col("place") + F.col("right")).alias("end"),
    )
    lists = ranges.groupBy("text_1", "text_2").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("ranges")
    )

    def merge(batch: pa.RecordBatch) -> dict[str, object]:
        merged = [united([(one["start"], one["end"]) for one in own]) for own in batch.column(2).to_pylist()]
        spans = [[{"start": start, "end": end} for start, end in own] for own in merged]
        return {"text_1": batch.column(0), "text_2": batch.column(1), "spans": spans}

    schema = "text_1 long, text_2 long, spans array<struct<start: long, end: long>>"
    return map_slices(lists, merge, schema), keyed


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges without overlaps and neighbours."""
    out: list[tuple[int, int]] = []
    for start, end in ranges:
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def remove_repeats(documents: DataFrame, length: int = 400, **sizes: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of `documents`.

    Removed is each byte that a string of `length` bytes covers which also starts elsewhere in the
    corpus, the same text included; `kept` holds the other bytes in order (null where none are
    removed: the text is kept as it is). Texts are UTF-8 bytes, null ones empty; matches never
    cross documents. Rows with equal texts repeat each other, whatever their ids. An empty table
    gives no rows; other input columns are ignored.
    """
    spans, keyed = repeated_spans(documents, length, **sizes)
    spans = stored(spans)
    text = F.coalesce("text", F.lit(""))
    plain = keyed.select(
        "doc_id", "text_1", "text_2", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha")
    )
    one_each = plain.groupBy("text_1", "text_2").agg(F.min("doc_id").alias("first"))
    affected = spans.join(one_each, ["text_1", "text_2"]).withColumnsRenamed({"text_1": "t1", "text_2": "t2"})
    cut = keyed.join(
        affected,
        (F.col("text_1") == F.col("t1"))
        & (F.col("text_2") == F.col("t2"))
        & F.col("doc_id").eqNullSafe(F.col("first")),
    ).select("text_1", "text_2", F.col("text").cast("binary").alias("data"), "spans")

    def handle(batch: pa.RecordBatch) -> dict[str, object]:
        names = ("text_1", "text_2", "n_removed", "n_spans", "kept_sha256", "kept")
        out: dict[str, list] = {name: [] for name in names}
        for text_1, text_2, data, ranges in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            parts, done = [], 0
            for one in ranges:
                parts.append(data[done : one["start"]])
                done = one["end"]
            kept = b"".join([*parts, data[done:]])
            row = (text_1, text_2, len(data) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest(), kept)
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        return out

    schema = "text_1 long, text_2 long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    changed = map_slices(cut, handle, schema).dropDuplicates(["text_1", "text_2"])
    return plain.join(changed, ["text_1", "text_2"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        "kept",
    )
