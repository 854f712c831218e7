"""Exact byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

Merging pair by pair looks at a word again after each merge. Here a word is read from left to
right: an Aho-Corasick automaton names the longest token that starts at a place, and the token is
taken if merging would keep it beside the token before it. If not, shorter tokens are tried, and
where none is left the token before is given up too; a place that was given up is not entered
again, so the work is linear in the word. Two tokens can stand beside each other exactly if no
merge older than both crosses their border at any time of their making.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.llm.common import map_slices, worker_cache
from logloom.llm.packing import ChunkTokenizer, byte_letters, plain_letters

WORD_END = 256
KNOWN_PAIRS = 1_000_000
GATHER_IDS = 1 << 20


class PairTable:
    """Which tokens merging can leave side by side, from the list of merges in order.

    Tokens below `base` are single symbols, every later one joins two earlier ones, and later ones
    are made later. Answers are kept; the table starts anew when it is full.
    """

    def __init__(self, joined: list[tuple[int, int]], base: int) -> None:
        self.base, self.parts = base, joined
        self.merges = {pair: base + at for at, pair in enumerate(joined)}
        self.known: dict[int, bool] = {}

    def stays(self, left: int, right: int, until: int) -> bool:
        """Whether no merge that is made before token `until` crosses the border of both.

        Walks back in time: the newer of the two is parted, and what touches the border then must
        not have merged either. Equal merges run from left to right, so the right one is newer.
        """
        base, parts, merges = self.base, self.parts, self.merges
        while True:
            if merges.get((left, right), until) < until:
                return False
            if left > right:
                if left < base:
                    return True
                until, left = left, parts[left - base][1]
            else:
                if right < base:
                    return True
                until, right = right + 1, parts[right - base][0]

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        answer = self.known.get(key)
        if answer is None:
            if len(self.known) >= KNOWN_PAIRS:
                self.known.clear()
            answer = self.known[key] = self.stays(left, right, 1 << 62)
        return answer


class BacktrackEncoder:
    """Tokens of a word given as symbols: character n for byte n, 256 + n for the word's last byte."""

    def __init__(self, strings: list[str], joined: list[tuple[int, int]], base: int) -> None:
        import ahocorasick

        self.table = PairTable(joined, base)
        # a token that merging makes of its parts in no word is never a result
        usable = [True] * base
        for at, (left, right) in enumerate(joined):
            usable.append(usable[left] and usable[right] and self.table.stays(left, right, base + at))
        numbers = {own: number for number, own in enumerate(strings) if usable[number]}
        self.lengths = [len(own) for own in strings]
        self.shorter: list[int | None] = [None] * len(strings)
        self.matches = ahocorasick.Automaton()
        for own, number in numbers.items():
            self.matches.add_word(own, number)
            self.shorter[number] = next(
                (numbers[own[:size]] for size in range(len(own) - 1, 0, -1) if own[:size] in numbers), None
            )
        self.matches.make_automaton()

    def longest(self, word: str, at: int) -> int:
        return next(self.matches.iter_long(word, at))[1]

    def encode(self, word: str) -> list[int]:
        # longest matches one after the other are the result wherever they are compatible
        compatible = self.table.compatible
        tokens = [number for _, number in self.matches.iter_long(word)]
        if all(map(compatible, tokens, tokens[1:])):
            return tokens
        return self.backtrack(word)

    def backtrack(self, word: str) -> list[int]:
        compatible, lengths, size = self.table.compatible, self.lengths, len(word)
        open_ = bytearray(b"\1") * (size + 1)
        tokens: list[int] = []
        at, token = 0, self.longest(word, 0)
        while at < size:
            while token is not None and not (
                open_[at + lengths[token]] and (not tokens or compatible(tokens[-1], token))
            ):
                token = self.shorter[token]
            if token is not None:
                tokens.append(token)
                at += lengths[token]
                token = self.longest(word, at) if at < size else None
            else:
                open_[at] = 0
                token = tokens.pop()
                at -= lengths[token]
        return tokens


class BacktrackTokenizer(ChunkTokenizer):
    """The chunk cache over backtracked words. Normalising and splitting are the library's own steps."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        merges = [tuple(own.split(" ")) if isinstance(own, str) else tuple(own) for own in model["merges"]]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        base = len(vocabulary) - len(merges)
        bytes_of = byte_letters()
        symbols: dict[int, str] = {}
        for token, number in vocabulary.items():
            if number < base:
                letter = token.removesuffix(suffix) or token
                symbols[number] = chr(bytes_of[letter] + WORD_END * (letter != token))
        strings = [symbols[number] for number in range(base)]
        joined = []
        for at, (left, right) in enumerate(merges):
            pair = vocabulary[left], vocabulary[right]
            if vocabulary[left + right] != base + at or max(pair) >= base + at:
                raise ValueError("every merge must make a token of its own, numbered in order")
            joined.append(pair)
            strings.append(strings[pair[0]] + strings[pair[1]])
        self.encoder = BacktrackEncoder(strings, joined, base)
        self.added = {one["content"]: one["id"] for one in described["added_tokens"]}
        self.added_places = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        self.bytes_of = str.maketrans({letter: chr(byte) for letter, byte in bytes_of.items()})

    def word_ids(self, word: str) -> list[int]:
        return self.encoder.encode(word[:-1] + chr(WORD_END + ord(word[-1])))

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        out = []
        for piece in pieces:
            if plain_letters(piece):
                ids = self.word_ids(piece.decode("utf-8").lower().encode("utf-8").decode("latin-1"))
            else:
                ids = self.chunk_ids(piece.decode("utf-8"))
            out.append(np.array(ids, dtype="<u4").tobytes())
        return out

    def chunk_ids(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for part in self.added_places.split(chunk) if self.added else [chunk]:
            if part in self.added:
                ids.append(self.added[part])
                continue
            plain = self.tokenizer.normalizer.normalize_str(part)
            for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain):
                ids += self.word_ids(word.translate(self.bytes_of))
        return ids


class OffsetDecoder:
    """Decoding by gathering: all tokens' UTF-8 bytes in one array, and where each token starts in it."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if tokenizer.decoder is not None:
            raise ValueError("only vocabularies without a decoder step, whose tokens are joined by spaces")
        tokens = [tokenizer.id_to_token(number) for number in range(tokenizer.get_vocab_size())]
        encoded = [token.encode("utf-8") + b" " for token in tokens]
        self.bytes = np.frombuffer(b"".join(encoded), dtype=np.uint8)
        self.lengths = np.array([len(own) for own in encoded], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    @classmethod
    def of(cls, path: str) -> OffsetDecoder:
        held = worker_cache(cls.__name__)
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the tokens joined by spaces."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        places = np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + lengths, lengths)
        return self.bytes[places[:-1]].tobytes()

    def digest(self, ids: np.ndarray) -> str:
        """SHA-256 of the decoded bytes; very long texts are decoded in parts."""
        state = hashlib.sha256()
        for start in range(0, len(ids), GATHER_IDS):
            state.update(b" " * (start > 0))
            state.update(self.decode(ids[start : start + GATHER_IDS]))
        return state.hexdigest()


def encode_documents(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids): the token ids of every row's whole text, without special tokens added.

    A null or empty text has no ids. Repeated rows are encoded each; other columns are ignored; an
    empty table gives no rows. `tokenizer` is the path of a byte-level vocabulary file with word
    ends, installed on every executor with its library.
    """

    def handle(batch: pa.RecordBatch) -> dict[str, object]:
        texts = (text or "" for text in batch.column(1).to_pylist())
        found = BacktrackTokenizer.of(tokenizer).ids_of(texts)
        return {"doc_id": batch.column(0), "ids": [np.frombuffer(ids, "<u4").astype(np.int32) for ids in found]}

    return map_slices(documents.select("doc_id", "text"), handle, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text): texts of rows of token ids, special tokens included; null ids give null."""

    def handle(batch: pa.RecordBatch) -> dict[str, object]:
        decoder = OffsetDecoder.of(tokenizer)
        texts = [
            None if ids is None else decoder.decode(np.array(ids, dtype=np.int64)).decode("utf-8")
            for ids in batch.column(1).to_pylist()
        ]
        return {"doc_id": batch.column(0), "text": texts}

    return map_slices(encoded.select("doc_id", "ids"), handle, "doc_id long, text string")


def round_trip_digests(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, encoded and decoded in one pass.

    Ids are hashed as little-endian unsigned 32-bit integers, decoded texts as UTF-8.
    """

    def handle(batch: pa.RecordBatch) -> dict[str, object]:
        encoder, decoder = BacktrackTokenizer.of(tokenizer), OffsetDecoder.of(tokenizer)
        found = encoder.ids_of(text or "" for text in batch.column(1).to_pylist())
        return {
            "doc_id": batch.column(0),
            "n_tokens": [len(ids) // 4 for ids in found],
            "ids_sha256": [hashlib.sha256(ids).hexdigest() for ids in found],
            "decoded_sha256": [decoder.digest(np.frombuffer(ids, "<u4")) for ids in found],
        }

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_slices(documents.select("doc_id", "text"), handle, schema)
