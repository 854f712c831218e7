"""Tool-call linking on small conversations, and the pipeline against brute force."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm.common import stored
from logloom.llm.queries import TOXIC_FROM
from logloom.llm.tool_calls import MESSAGE_COLUMNS, SCHEMA_COLUMNS, link_tool_calls, topological_levels
from logloom.llm.toxicity import score_toxicity, train_toxicity
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_near_copies import kept_by_brute_force
from tests.llm.test_packing import check_packed

TOOLS = [
    ("weather", "city", "string", True),
    ("weather", "days", "integer", False),
    ("weather", "scale", "number", False),
    ("book", "from", "object", True),
    ("book", "tags", "array", False),
    ("book", "paid", "boolean", None),
]


@pytest.fixture(scope="module")
def linked(spark):
    def run(messages):
        frame = spark.createDataFrame(messages, MESSAGE_COLUMNS).withColumn("level", F.lit("other"))
        rows = link_tool_calls(frame, spark.createDataFrame(TOOLS, SCHEMA_COLUMNS)).collect()
        return sorted(rows, key=lambda row: (row.conv_id is None, row.conv_id, row.position))

    return run


def call(conv, turn, *calls):
    return (conv, turn, "assistant", None, list(calls), None)


def answer(conv, turn, call_id, text="ok"):
    return (conv, turn, "tool", text, None, call_id)


def one(call_id, arguments='{"city": "x"}', after=None, name="weather"):
    return (call_id, name, arguments, after)


def test_topological_order_and_links(linked):
    rows = linked(
        [
            call(1, 0, one("c", after=["a", "b"]), one("b", after=["a", None, "a"]), one("a")),
            answer(1, 1, "a"), answer(1, 2, "c"), answer(1, 3, "b"),
            call(2, 5, one("a", after=["zzz"])), answer(2, 5, "a"), answer(2, 9, "q"),
            call(2, 6, one("x", after=["y"]), one("y", after=["x"]), one("w", after=["x"]), one("v", after=["v"])),
            call(3, 0, one("a")), call(3, 2, one("a")), answer(3, 4, "a", "late"), answer(3, 3, "a", "early"),
            call(None, 0, one("a"), one(None), one(None)), answer(None, 1, "a"), answer(None, 2, None),
            (4, 0, "user", "hello", None, None), (None, None, None, None, None, None), (4, 1, "assistant", "x", [], None),
        ]
    )
    seen = [(row.conv_id, row.position, row.call_id, row.level, row.status, row.n_calls, row.n_results) for row in rows]
    assert seen == [
        (1, 0, "a", 0, "linked", 1, 1), (1, 1, "b", 1, "linked", 1, 1), (1, 2, "c", 2, "linked", 1, 1),
        (2, 0, "a", 0, "early", 1, 1),
        (2, 1, "v", None, "cycle", 1, 0), (2, 2, "w", None, "cycle", 1, 0), (2, 3, "x", None, "cycle", 1, 0),
        (2, 4, "y", None, "cycle", 1, 0), (2, 5, "q", None, "orphan", 0, 1),
        (3, 0, "a", 0, "linked", 2, 2),
        (None, 0, None, 0, "unanswered", 2, 0), (None, 1, "a", 0, "linked", 1, 1),
    ]
    assert rows[3].errors == ["need:zzz"] and rows[9].result_turn == 3
    assert json.loads(rows[9].json)["result"] == "early"


def test_arguments_against_schemas(linked):
    given = {
        "a": '{"days": 2, "city": "Köln \\"x\\"", "scale": 3}',
        "b": '{"city": 5, "days": 1.5, "more": [1]}',
        "c": "[1]", "d": "{", "e": None, "f": '{"city": "x", "city": "y"}',
        "g": '{"city": null, "days": 3.0, "scale": 1e3}',
    }
    rows = {row.call_id: row for row in linked([call(1, 0, *[one(key, value) for key, value in given.items()])])}
    assert rows["a"].errors == []
    assert rows["b"].errors == ["type:city", "type:days", "unknown:more"]
    assert all(rows[key].errors == ["malformed"] for key in "cdef")
    assert "type:city" in rows["g"].errors and "type:scale" not in rows["g"].errors
    assert rows["a"].json == (
        '{"arguments":{"city":"Köln \\"x\\"","days":2,"scale":3},"call_id":"a","errors":[],"name":"weather",'
        '"result":null,"status":"unanswered"}'
    )
    more = linked(
        [call(1, 0, one("a", '{"from": {"b": 1, "a": {"d": [], "c": 0}}, "paid": true, "tags": []}', name="book"),
              one("b", "{}", name="book"), one("c", "{}", name="fly"), one("d", "{}", name=None))]
    )
    assert [row.errors for row in more] == [[], ["missing:from"], ["unknown_tool"], ["unknown_tool"]]
    assert '"arguments":{"from":{"a":{"c":0,"d":[]},"b":1},"paid":true,"tags":[]}' in more[0].json


def test_long_conversation_and_none(linked):
    """Positions run on over ranges of a long conversation; no messages give no rows."""
    messages = [call(1, turn, one(f"id{turn}")) for turn in range(0, 5000, 7)]
    random.Random(1).shuffle(messages)
    rows = linked(messages)
    assert [row.call_turn for row in rows] == list(range(0, 5000, 7))
    assert [row.position for row in rows] == list(range(len(rows)))
    assert linked([]) == []


def test_chain_takes_logarithmic_rounds(spark, monkeypatch):
    """2,000 calls that each need the one before, some an early one or the start too."""
    import logloom.llm.tool_calls as tool_calls

    written = []
    monkeypatch.setattr(tool_calls, "stored", lambda df: written.append(1) or stored(df))
    length = 2000
    edges = [("a", f"i{at}", f"i{at - 1}") for at in range(1, length)]
    edges += [("a", f"i{at}", "i0") for at in range(2, length, 7)]
    edges += [("b", "x", "y"), ("b", "y", "x"), ("b", "z", "x"), ("b", "self", "self"), ("b", "v", "free")]
    names = {(conv, name) for conv, id_, need in edges for name in (id_, need)}
    nodes = spark.createDataFrame(sorted(names), "conv_id string, id string")
    needs = spark.createDataFrame(edges, "conv_id string, id string, need string")
    got = {(row.conv_id, row.id): row.level for row in topological_levels(nodes, needs).collect()}
    want = {("a", f"i{at}"): at for at in range(length)} | {("b", "free"): 0, ("b", "v"): 1}
    assert got == want
    assert len(written) <= 2 + 2 * 13


def test_levels_of_random_graphs(spark):
    state = random.Random(4)
    edges, want = [], {}
    for graph in range(30):
        levels = []
        for at in range(25):
            needed = state.sample(range(at), min(at, state.choice([0, 1, 1, 1, 2, 3])))
            edges += [(str(graph), str(at), str(other)) for other in needed]
            levels.append(1 + max((levels[other] for other in needed), default=-1))
        want |= {(str(graph), str(at)): level for at, level in enumerate(levels)}
    nodes = spark.createDataFrame(sorted(want), "conv_id string, id string")
    needs = spark.createDataFrame(edges + edges[:9], "conv_id string, id string, need string")
    assert {(row.conv_id, row.id): row.level for row in topological_levels(nodes, needs).collect()} == want


def test_order_without_turns(linked):
    """A conversation whose turns are all null is ordered by identifier, in as many ranges as there are."""
    rows = linked([call(1, None, one(f"c{at:04d}")) for at in range(3000)])
    assert [(row.position, row.call_id) for row in rows] == [(at, f"c{at:04d}") for at in range(3000)]


def corpus():
    state = random.Random(11)
    words = ["".join(state.choices("abcdefghijklm", k=state.randint(2, 8))) for _ in range(3000)]
    shared = " ".join(state.choices(words, k=12))
    rows = [(1, None, None), (2, "", "s1"), (3, shared, "s2")]
    for at in range(150):
        text = state.choices(words, k=state.randint(30, 200))
        toxic = at % 8 == 0
        if toxic:
            for _ in range(len(text) // 10 + 2):
                text[state.randrange(len(text))] = "zwockig"
        text = " ".join(text) + (f"\n{shared}" if at % 9 == 1 else "")
        rows.append((10 + at, text, state.choice(["s0", "s0", "s1", None])))
        if at % 10 == 3:
            near = text.split(" ")
            near[len(near) // 2] = "altered"
            rows += [(1000 + at, " ".join(near), "s2"), (2000 + at, text, "s0")]
    return rows, [(10 + at, 1, int(at % 8 == 0)) for at in range(150)]


def test_pipeline_equals_brute_force(spark, documents_of, tmp_path):
    from tokenizers import Tokenizer

    from logloom.llm.queries import tokenizer_path
    from logloom.llm.mixing import mix

    rows, labels = corpus()
    documents = documents_of(rows)
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    table.write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    model = train_toxicity(documents, table)
    scores = {row.doc_id: row.score for row in score_toxicity(documents, model).collect()}
    clean = [row for row in rows if scores[row[0]] < TOXIC_FROM]
    assert {at for at in range(150) if 10 + at not in {row[0] for row in clean}} == set(range(0, 150, 8))
    lines = {row[0]: row[3] for row in plain_lines([row[:2] for row in clean], 40, 5)}
    clean = [(doc_id, lines[doc_id], source) for doc_id, _, source in clean]
    kept_ids = kept_by_brute_force([(row[0], row[1] or "") for row in clean])
    assert len(kept_ids) < len(clean)
    kept = [row for row in clean if row[0] in kept_ids]
    sized = spark.createDataFrame(
        [(doc_id, source, len((text or "").split())) for doc_id, text, source in kept], "doc_id long, source string, size long"
    )
    copies = {row.doc_id: int(row.taken / row.size + 0.5) if row.size else 0 for row in mix(sized).collect()}
    used = {}
    for row in got:
        if row.piece == 0:
            used[row.doc_id] = used.get(row.doc_id, 0) + 1
    assert used == {doc_id: count for doc_id, count in copies.items() if count}
    packed_rows = [(doc_id, text) for doc_id, text, _ in kept for _ in range(copies[doc_id])]
    check_packed(Tokenizer.from_file(tokenizer_path()), packed_rows, got, 4096)


def test_stages_keep_columns_and_odd_rows(spark, odd_documents, tmp_path):
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for frame in (odd_documents, odd_documents.limit(0)):
        docs = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == frame.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= 0
