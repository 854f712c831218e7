"""Token pieces of documents and vector best-fit packing of them into sequences."""

from __future__ import annotations

import os
import string
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import map_slices, stored, worker_cache

CACHE_CHUNKS = 1_000_000
RUN_CHUNKS = 100_000
SIGNS = string.punctuation.encode()
END_ID = 1


class ChunkTokenizer:
    """Ids of texts by a public word tokenizer, with a cache over chunks between white space.

    The tokenizer's splitting never joins text across white space, so a text's ids are its chunks'
    ids in a row. Signs that follow plain letters are split off likewise, since letters and other
    signs never share a token. Ids are kept as little-endian bytes. The cache starts anew when it
    is full, which bounds memory and changes no ids.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks: dict[bytes, bytes] = {}
        self.letters = {byte: letter for letter, byte in byte_letters().items()}

    @classmethod
    def of(cls, path: str) -> ChunkTokenizer:
        """The tokenizer of this Python worker; workers live on from task to task."""
        held = worker_cache(cls.__name__)
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece.

        Normalising and splitting leave words of plain letters whole and only lower them, so these
        go straight to the library's model, in the letters that stand for their bytes.
        """
        model, out = self.tokenizer.model, {}
        others = []
        for piece in pieces:
            if not plain_letters(piece):
                others.append(piece)
                continue
            if piece.isascii():
                word = piece.lower().decode("ascii")
            else:
                word = piece.decode("utf-8").lower().encode("utf-8").decode("latin-1").translate(self.letters)
            ids = [token.id for token in model.tokenize(word)]
            out[piece] = struct.pack(f"<{len(ids)}I", *ids)
        found = self.tokenizer.encode_batch_fast([piece.decode("utf-8") for piece in others], add_special_tokens=False)
        out.update((piece, np.array(one.ids, dtype="<u4").tobytes()) for piece, one in zip(others, found, strict=True))
        return [out[piece] for piece in pieces]

    def learn(self, chunks: Iterable[bytes]) -> None:
        known, split = self.chunks, {}
        for chunk in chunks:
            core = chunk.rstrip(SIGNS)
            split[chunk] = (core, chunk[len(core) :]) if len(core) < len(chunk) and plain_letters(core) else (chunk,)
        unknown = [part for part in {part for parts in split.values() for part in parts} if part not in known]
        known.update(zip(unknown, self.encode(unknown), strict=True))
        known.update((chunk, b"".join(known[part] for part in parts)) for chunk, parts in split.items() if len(parts) > 1)

    def ids_of_run(self, run: list[bytes]) -> list[bytes]:
        found = list(map(self.chunks.get, run))
        if None in found:
            missing = {chunk for chunk, ids in zip(run, found, strict=True) if ids is None}
            if len(self.chunks) + len(missing) > CACHE_CHUNKS:
                self.chunks.clear()
                missing = set(run)
            self.learn(missing)
            found = list(map(self.chunks.__getitem__, run))
        return found

    def ids_of(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of every text; chunks of several short texts are looked up together, long texts in runs."""
        out: list[list[bytes]] = []
        run: list[bytes] = []
        spans: list[tuple[int, int]] = []

        def settle() -> None:
            found, at = self.ids_of_run(run), 0
            for number, count in spans:
                out[number].append(b"".join(found[at : at + count]))
                at += count
            run.clear()
            spans.clear()

        for number, text in enumerate(texts):
            words = text.encode("utf-8").split()
            out.append([])
            for start in range(0, len(words), RUN_CHUNKS):
                part = words[start : start + RUN_CHUNKS]
                spans.append((number, len(part)))
                run += part
                if len(run) >= RUN_CHUNKS:
                    settle()
        settle()
        return [b"".join(parts) for parts in out]

    def ids(self, text: str) -> bytes:
        return self.ids_of([text])[0]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes of Latin-1 stand for themselves, the others are numbered from 256 on.
    """
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [byte for byte in range(256) if byte not in set(shown)]
    return {chr(byte): byte for byte in shown} | {chr(256 + at): byte for at, byte in enumerate(hidden)}


def plain_letters(chunk: bytes) -> bool:
    """Letters of the Latin blocks whose lower case is a letter too."""
    if chunk.isascii():
        return chunk.isalpha()
    text = chunk.decode("utf-8")
    return text.isalpha() and max(text) < "\u0250" and text.lower().isalpha()


def cut_ids(ids: bytes, most: int) -> Iterator[tuple[int, int, bytes]]:
    """(piece, start, ids) of a document: one piece unless it has over `most` ids."""
    for piece, start in enumerate(range(0, len(ids) // 4, most)):
        yield piece, start, ids[4 * start : 4 * (start + most)]


def token_pieces(documents: DataFrame, tokenizer: str, most: int = 4096, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of all documents.

    A document's ids are those of its text, then id 1; only those of more than `most` ids are cut.
    A null or empty text has the one id 1. `tokenizer` is the path of the vocabulary file, which
    is installed on every executor with its library.
    """
    end = np.array([END_ID], dtype="<u4").tobytes()

    def handle(batch: pa.RecordBatch) -> dict[str, object]:
        encoder = ChunkTokenizer.of(tokenizer)
        out: dict[str, list] = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        texts = (text or "" for text in batch.column(1).to_pylist())
        for doc_id, found in zip(batch.column(0).to_pylist(), encoder.ids_of(texts), strict=True):
            for piece, start, ids in cut_ids(found + end, most):
                row = (doc_id, piece, start, len(ids) // 4, zlib.crc32(ids))
                for name, value in zip(out, row, strict=False):
                    out[name].append(value)
                if with_ids:
                    out["ids"].append(np.frombuffer(ids, "<u4").astype(np.int32))
        return out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_slices(documents.select("doc_id", "text"), handle, schema)


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds: tokens, documents, and attention cost (sum of squared lengths)."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], dtype=np.float64)


class Bins:
    """Open sequences with their residual capacities; rows grow by doubling."""

    def __init__(self, capacity: np.ndarray) -> None:
        self.capacity, self.n = capacity, 0
        self.left = np.zeros((256, 3))
        self.name = np.zeros(256, dtype=np.int64)

    def add(self, name: int, left: np.ndarray) -> None:
        if self.n == len(self.name):
            self.left = np.concatenate([self.left, np.zeros_like(self.left)])
            self.name = np.concatenate([self.name, np.zeros_like(self.name)])
        self.left[self.n], self.name[self.n] = left, name
        self.n += 1

    def close(self, at: int) -> None:
        self.n -= 1
        self.left[at], self.name[at] = self.left[self.n], self.name[self.n]

    def best(self, demand: np.ndarray, weights: np.ndarray, rule: str) -> int | None:
        left = self.left[: self.n]
        fits = np.flatnonzero((left >= demand).all(axis=1))
        if not len(fits):
            return None
        if rule == "dot":
            score = -((left[fits] / self.capacity) @ (weights * demand / self.capacity))
        else:
            score = (((left[fits] - demand) / self.capacity) ** 2) @ weights
        tied = fits[score == score.min()]
        return int(tied[np.argmin(self.name[tied])])


def best_fit(
    lengths: np.ndarray, capacity: Capacity, weights: Sequence[float], rule: str
) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece, the longest placed first.

    Of the sequences with room in every dimension a piece goes to the one that leaves the smallest
    weighted norm of residuals (`norm`), or whose residual has the largest weighted product with
    the piece's demand (`dot`); else it opens one. Runs of equal pieces go to the same sequence
    while they fit, as best fit would choose it again.
    """
    full, weight = capacity.vector(), np.asarray(weights, dtype=np.float64)
    order = np.argsort(-lengths, kind="stable")
    smallest = float(lengths.min()) if len(lengths) else 0.0
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    bins, names = Bins(full), 0
    for at in order:
        length = float(lengths[at])
        demand = np.array([length, 1.0, length * length])
        if (demand > full).any():
            raise ValueError(f"a piece of {int(length)} tokens fits no sequence")
        chosen = bins.best(demand, weight, rule)
        if chosen is None:
            bins.add(names, full.copy())
            chosen, names = bins.n - 1, names + 1
        sequence[at] = bins.name[chosen]
        offset[at] = full[0] - bins.left[chosen, 0]
        bins.left[chosen] -= demand
        if bins.left[chosen, 0] < smallest or bins.left[chosen, 1] < 1:
            bins.close(chosen)
    return sequence, offset


def pack(
    pieces: DataFrame,
    capacity: Capacity | None = None,
    weights: Sequence[float] = (1.0, 1.0, 1.0),
    rule: str = "norm",
    block_pieces: int = 8192,
) -> DataFrame:
    """All pieces with `sequence_id` and `offset`, packed by best fit under every capacity.

    All three residuals weigh in the choice by default. With the default capacities only tokens can
    run out, but of the sequences a piece fits, documents and attention cost help to choose.

    Pieces are dealt at random to blocks of about `block_pieces`, and each block is packed alone:
    a block leaves about one sequence part empty, so blocks of thousands of sequences cost next
    to nothing. Blocks follow the row's place in the stored table, so repeated rows spread out.
    Sequence numbers are block * 2**32 + number in block. Keep `pieces` narrow; columns named like
    the results are replaced. No pieces, no sequences.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    kept = stored(pieces.drop("sequence_id", "offset", "__block"))
    blocks = max(1, round(kept.count() / block_pieces))
    dealt = kept.withColumn(
        "__block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    )
    limits = capacity or Capacity()

    def pack_block(group: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = best_fit(group["length"].to_numpy(np.int64), limits, weights, rule)
        block = int(group["__block"].iloc[0])
        return group.drop(columns="__block").assign(sequence_id=(block << 32) + sequence, offset=offset)

    from pyspark.sql.types import LongType, StructType

    schema = StructType([*kept.schema.fields]).add("sequence_id", LongType()).add("offset", LongType())
    return dealt.groupBy("__block").applyInPandas(pack_block, schema)


def pack_documents(documents: DataFrame, tokenizer: str, capacity: Capacity | None = None, **options) -> DataFrame:
    """Token pieces of all documents with their place in the packed sequences."""
    limits = capacity or Capacity()
    return pack(token_pieces(documents, tokenizer, limits.tokens), limits, **options)


def sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """One row per sequence with its ids in order: the packed batch as it goes to training.

    `pieces` must hold `ids`, see token_pieces.
    """
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    content = pieces.dropDuplicates(keys)
    same = [packed[key].eqNullSafe(content[key]) for key in keys]
    return (
        packed.join(content, same)
        .groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct(packed["offset"], content["ids"]))).alias("parts"))
        .select(
            "sequence_id",
            F.flatten(F.transform("parts", lambda part: part["ids"])).alias("ids"),
            F.transform("parts", lambda part: part["offset"]).alias("offsets"),
        )
    )
