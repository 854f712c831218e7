"""Backtracked encoding against the library, and decoding against its decoder."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from logloom.llm.bpe import (
    BacktrackEncoder,
    BacktrackTokenizer,
    OffsetDecoder,
    decode_documents,
    encode_documents,
    round_trip_digests,
)
from logloom.llm.queries import tokenizer_path
from tests.llm.conftest import ODD_ROWS
from tests.llm.test_packing import ODD_TEXTS


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def own():
    return BacktrackTokenizer(tokenizer_path())


def merged(word, merges):
    """Plain byte-pair encoding: the oldest merge found, leftmost first, until none is left."""
    tokens = [ord(symbol) - 97 for symbol in word]
    while True:
        found = [(merges[pair], at) for at, pair in enumerate(zip(tokens, tokens[1:])) if pair in merges]
        if not found:
            return tokens
        number, at = min(found)
        tokens[at : at + 2] = [number]


@pytest.mark.parametrize("seed", range(40))
def test_backtracking_equals_merging(seed):
    """Random merge lists over few symbols, where longest matches are often wrong."""
    state = random.Random(seed)
    base = state.randint(1, 4)
    strings, joined = [chr(97 + at) for at in range(base)], []
    for _ in range(state.randint(1, 25)):
        pair = state.randrange(len(strings)), state.randrange(len(strings))
        if strings[pair[0]] + strings[pair[1]] not in strings:
            joined.append(pair)
            strings.append(strings[pair[0]] + strings[pair[1]])
    merges = {pair: base + at for at, pair in enumerate(joined)}
    encoder = BacktrackEncoder(strings, joined, base)
    for _ in range(300):
        word = "".join(chr(97 + state.randrange(base)) for _ in range(state.randint(1, 24)))
        assert encoder.encode(word) == merged(word, merges), (joined, word)
        assert encoder.backtrack(word) == merged(word, merges)


def test_ids_are_the_librarys(own, library):
    random.seed(5)
    alphabet = "aeıİΣσß.,'!-1 \t\n\x1c\xa0́é漢😀<|>"
    words = [*ODD_TEXTS, "", *(text or "" for _, text in ODD_ROWS)]
    words += ["".join(random.choices(alphabet, k=random.randint(0, 40))) for _ in range(1500)]
    words += ["".join(random.choices("abcdefghinorst", k=random.randint(1, 30))) for _ in range(3000)]
    words += ["".join(chr(random.randrange(0x20, 0x3000)) for _ in range(20)) for _ in range(500)]
    for text, ids in zip(words, own.ids_of(words), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_plain_letter_is_lowered_alike(own, library):
    letters = [chr(at) for at in range(0x250) if chr(at).isalpha() and chr(at).lower().isalpha()]
    for letter in letters:
        assert library.normalizer.normalize_str(letter) == letter.lower()


def test_every_token_decodes(library):
    decoder = OffsetDecoder(tokenizer_path())
    ids = list(range(library.get_vocab_size()))
    random.shuffle(ids)
    assert decoder.decode(np.array(ids)).decode("utf-8") == library.decode(ids, skip_special_tokens=False)
    assert decoder.decode(np.array([], dtype=int)) == b""


def test_long_texts_are_digested_in_parts(monkeypatch, library):
    import logloom.llm.bpe as bpe

    monkeypatch.setattr(bpe, "GATHER_IDS", 7)
    decoder = OffsetDecoder(tokenizer_path())
    for count in (0, 1, 6, 7, 8, 14, 30):
        ids = [random.randrange(49408) for _ in range(count)]
        want = hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert decoder.digest(np.array(ids, dtype=int)) == want


def test_tables(spark, documents_of, library):
    rows = ODD_ROWS + [(10 + at, text) for at, text in enumerate(ODD_TEXTS)]
    frame = documents_of(rows, clashes=True)
    plain = [library.encode(text or "", add_special_tokens=False).ids for _, text in rows]
    decoded = [library.decode(ids, skip_special_tokens=False) for ids in plain]
    encoded = encode_documents(frame, tokenizer_path())
    got = encoded.collect()
    assert sorted((str(row.doc_id), row.ids) for row in got) == sorted((str(a), ids) for (a, _), ids in zip(rows, plain))
    back = decode_documents(encoded, tokenizer_path()).collect()
    assert sorted((str(row.doc_id), row.text) for row in back) == sorted((str(a), t) for (a, _), t in zip(rows, decoded))
    want = sorted(
        (str(doc_id), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        for (doc_id, _), ids, text in zip(rows, plain, decoded)
    )
    digests = round_trip_digests(frame, tokenizer_path()).collect()
    assert sorted((str(row[0]), *row[1:]) for row in digests) == want
    assert round_trip_digests(documents_of([]), tokenizer_path()).count() == 0
    assert decode_documents(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), tokenizer_path()).collect()[0].text is None
