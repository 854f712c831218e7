from __future__ import annotations

import pytest

DOCUMENT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: names that operators use inside or return, as further input columns
CLASHES = (
    "shard slot size taken target kept spans lines n_lines group fp place length offset score rank block level"
).split()


@pytest.fixture(scope="session")
def documents_of(spark):
    """A documents table from (doc_id, text[, source[, lang]]) rows, with clashing extra columns if asked for."""

    def make(rows, clashes: bool = False):
        full = []
        for row in rows:
            doc_id, text, source, lang = (*row, *("s0", "en")[len(row) - 2 :])
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        frame = spark.createDataFrame(full, DOCUMENT_SCHEMA)
        if clashes:
            from pyspark.sql import functions as F

            frame = frame.withColumns({name: F.lit("other") for name in CLASHES})
        return frame

    return make


ODD_ROWS = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (None, "no id has this text of some words"),
    (4, "One line\nand another line\n\nend"),
    (4, "One line\nand another line\n\nend"),
    (5, "Ünïcode wörds ß 漢字   and emoji 😀 mixed"),
    (6, "long " * 30_000),
]


@pytest.fixture(scope="session")
def odd_documents(documents_of):
    return documents_of(ODD_ROWS, clashes=True)
