"""Multi-line merge, profiles, mapping and replays, skewed inputs included."""

from __future__ import annotations

import datetime as dt
import json
import random
from bisect import bisect_right
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.functions.timestamps import clean_time_text, format_utc, from_text, parse_timestamp
from logloom.operators import profiling as P
from logloom.operators.mapping import map_fields
from logloom.operators.multiline import merge_lines
from logloom.operators import replay
from logloom.operators.replay import recent_counts, replay_admission, replay_lockout, trailing_counts
from logloom.operators.time_layouts import column_layouts, layout_of, shape_of
from logloom.sources import lines as lines_module
from logloom.sources.delimited import tabular_check
from logloom.sources.lines import leading_lines, lines_from_column, read_lines
from logloom.sources.records import json_records, parse_lines
from tests.conftest import dicts

# ---------------------------------------------------------------- multi-line


def merged_one_by_one(lines, starts, max_lines):
    out, buffer = [], []
    for line in lines:
        if starts(line):
            if buffer:
                out.append("\n".join(buffer))
            buffer = [line]
        else:
            buffer.append(line)
            if len(buffer) > max_lines:
                out.append("\n".join(buffer))
                buffer = []
    return out + (["\n".join(buffer)] if buffer else [])


def merged(spark, lines, pattern, max_lines):
    table = spark.createDataFrame([("f", "\n".join(lines))], "k string, t string")
    frame = merge_lines(lines_from_column(table, "t", "k"), pattern, max_lines)
    return [row["value"] for row in frame.orderBy("line_id").collect()]


def test_dated_records(spark):
    lines = ["2024-01-01 a", "  b", "  c", "2024-01-02 d", "2024-01-03 e"]
    assert merged(spark, lines, r"^\d{4}-\d{2}-\d{2}", 100) == ["2024-01-01 a\n  b\n  c", "2024-01-02 d", "2024-01-03 e"]


def test_forced_flush_at_one_more_than_the_limit(spark):
    rows = merged(spark, ["START"] + [f"line {i}" for i in range(200)], "^START", 50)
    assert [len(row.split("\n")) for row in rows] == [51, 51, 51, 48]
    with pytest.raises(ValueError):
        merged(spark, ["a"], "a", 0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    flags=st.lists(st.booleans(), min_size=1, max_size=90),
    max_lines=st.integers(1, 5),
    block=st.sampled_from([1, 4, 16]),
)
def test_merge_equals_state_machine(spark, monkeypatch, flags, max_lines, block):
    monkeypatch.setattr(lines_module, "BLOCK_LINES", block)
    lines = [("S" if flag else ".") + str(i) for i, flag in enumerate(flags)]
    assert merged(spark, lines, "S", max_lines) == merged_one_by_one(lines, lambda x: x.startswith("S"), max_lines)


def test_one_file_with_most_lines_is_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(lines_module, "BLOCK_LINES", 64)
    random.seed(5)
    hot = [("S" if random.random() < 0.02 else ".") + str(i) for i in range(5000)]
    table = spark.createDataFrame(
        [("hot", "\n".join(hot)), *[(f"cold{i}", "S1\n.2") for i in range(20)]], "k string, t string"
    )
    lines = lines_from_column(table, "t", "k")
    plan = merge_lines(lines, "S", 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "source_path" in plan and "block_no" in plan
    rows = merge_lines(lines, "S", 10).filter("source_path = 'hot'").orderBy("line_id").collect()
    assert [row["value"] for row in rows] == merged_one_by_one(hot, lambda x: x.startswith("S"), 10)


# ---------------------------------------------------------------- profiles


@pytest.mark.parametrize(
    ("name", "text", "expected"),
    [
        ("test.json", '[\n {"a": 1}]', "json_array"),
        ("test.ndjson", '{"a": 1}\n{"a": 2}', "ndjson"),
        ("test.csv", "a,b\n1,2", "csv"),
        ("empty.json", "", None),
        ("white.json", '  \n[{"a": 1}]', "json_array"),
        ("white.ndjson", '  \n{"a": 1}', "ndjson"),
        ("wrong.csv", '[{"a": 1}]', "json_array"),
        ("wrong.txt", '{"a": 1}', "ndjson"),
        ("t.tsv", '{"a": 1}', "tsv"),
        ("t.LTSV", "a:1", "ltsv"),
        ("a.log", "<34>Oct 11 22:14:15 host su: x", "syslog"),
        ("b.log", '{"a": 1}', "ndjson"),
        ("c.log", "[1]", "json_array"),
        ("d.log", "a:1\tb:2\tc", "csv"),
        ("d2.log", "a:1   b:2", "ltsv"),
        ("e.log", "name,age\nx,1", "csv"),
        ("f.log", "\na=1 b=2\na=1 c='x y'", "logfmt"),
        ("g.txt", "a=1 b=2", "logfmt"),
        ("l14of20.txt", "a=1 b=2\n" * 14 + "x\n" * 6, "logfmt"),
        ("l14of21.txt", "a=1 b=2\n" * 14 + "x\n" * 7, "csv"),
        ("l15of30.txt", "a=1 b=2\n" * 15 + "x\n" * 15, "logfmt"),
        ("late.txt", "x\n" * 21 + "a=1 b=2\n" * 500, "csv"),
    ],
)
def test_formats(spark, put, name, text, expected):
    rows = P.detect_formats(read_lines(spark, put(name, text))).collect()
    assert [row["format"] for row in rows] == ([expected] if expected else [])


def test_formats_of_many_files_and_agreement(spark, put):
    paths = [put("a.json", "[1]"), put("b.json", '[{"x": 1}]'), put("c.txt", "x=1 y=2")]
    mixed = P.format_agreement(P.detect_formats(read_lines(spark, paths))).first()
    assert (mixed["files"], mixed["formats"], mixed["uniform"], mixed["format"]) == (3, 2, False, None)
    same = P.format_agreement(P.detect_formats(read_lines(spark, paths[:2]))).first()
    assert (same["uniform"], same["format"]) == (True, "json_array")


def profiled(spark, records):
    lines = spark.createDataFrame([(i, text) for i, text in enumerate(records)], "line_id bigint, value string")
    return [(row["name"], row["type"]) for row in P.field_profile(P.map_entries(json_records(lines))).collect()]


def test_inferred_types(spark):
    assert profiled(spark, ['{"s": "x", "i": 1, "b": true}']) == [("s", "string"), ("i", "integer"), ("b", "boolean")]
    assert profiled(spark, ['{"x": 1.5, "y": 1}', '{"x": 2.7, "y": 2.5}']) == [("x", "float"), ("y", "float")]
    assert profiled(spark, ['{"o": {"a": 1}, "l": [1]}']) == [("o", "object"), ("l", "array")]
    assert profiled(spark, ['{"n": "123", "t": "true", "m": 1}', '{"n": "456", "m": true}']) == [
        ("n", "integer"), ("t", "string"), ("m", "string"),
    ]
    assert profiled(spark, ['{"z": 1, "a": null, "m": ""}', '{"late": 1, "a": "2"}']) == [
        ("z", "integer"), ("a", "integer"), ("m", "string"), ("late", "integer"),
    ]
    assert profiled(spark, ['{"n": "1_0"}', '{"n": 123456789012345678901234567890}']) == [("n", "integer")]
    assert profiled(spark, ['{"": 1}']) == []


def test_typed_columns_profile(spark):
    frame = spark.createDataFrame([(1, 1.5, "7", [1], None)], "i int, d double, s string, a array<int>, n string")
    assert [(row["name"], row["type"]) for row in P.field_profile(P.column_entries(frame)).collect()] == [
        ("i", "integer"), ("d", "float"), ("s", "integer"), ("a", "array"), ("n", "string"),
    ]


def test_fields_beyond_the_columns_are_marked(spark):
    """The names filled most often become columns, in order of appearance."""
    frame = spark.createDataFrame([(None, 1, 2), (3, 4, None)], "a int, b int, c int")
    profile = P.field_profile(P.column_entries(frame))
    assert [name for name, _, _ in P.collect_fields(profile, 1, 3)] == ["a", "b", "c"]
    fields = P.collect_fields(profile, 1, 2)
    assert [name for name, _, _ in fields] == ["a", "b", P.OTHER_FIELDS]
    assert P.split_overflow(fields) == (fields[:2], True)


WIDE = [
    ("ndjson", ['{"a": 1, "x": {"y": [1]}, "_other_fields": 5}', '{"a": 2, "z": null, "q": "t"}', '{"a": 3, "w": 1, "w": 2}', "no"]),
    ("ltsv", ["a:1\tx:7\t_other_fields:5", "a:2\tz:\tq:t", "a:3\tw:1\tw:2"]),
    ("logfmt", ["a=1 x=7 _other_fields=5", "a=2 z= q=t", "a=3 w=1 w=2"]),
]


@pytest.mark.parametrize(("fmt", "texts"), WIDE)
def test_rare_fields_share_a_column(spark, fmt, texts):
    lines = spark.createDataFrame(
        [("f", "f", 0, at, text) for at, text in enumerate(texts)],
        "source_path string, source_file string, split_start bigint, line_id bigint, value string",
    )
    found = parse_lines(lines, fmt, max_fields=0, max_columns=1)
    rows = {row["line_id"]: row for row in found.withColumn("_other_fields", F.to_json("_other_fields")).collect()}
    assert [str(rows[at]["a"]) for at in range(3)] == ["1", "2", "3"]
    others = [json.loads(rows[at]["_other_fields"]) for at in range(3)]
    text = fmt != "ndjson"
    assert others[0] == ({"x": "7", "_other_fields": "5"} if text else {"x": {"y": [1]}, "_other_fields": 5})
    assert others[1]["q"] == "t" and set(others[1]) <= {"z", "q"}
    assert others[2] == {"w": "2" if text else 2}
    clash = parse_lines(lines, fmt, fields=[("_other_fields", "string", "string"), ("_other_fields", "object", "overflow")])
    assert {"_other_fields", "_other_fields_2"} <= set(clash.columns)


def test_a_hundred_thousand_names_lose_nothing(spark):
    lines = spark.range(100_000).select(
        F.lit("f").alias("source_path"), F.lit("f").alias("source_file"), F.lit(0).cast("bigint").alias("split_start"),
        F.col("id").alias("line_id"), F.concat(F.lit('{"id": '), "id", F.lit(', "n'), "id", F.lit('": '), "id", F.lit("}")).alias("value"),
    )
    found = parse_lines(lines, "ndjson", max_columns=50, max_fields=10)
    assert len(found.columns) == 4 + 50 + 1 + 2
    own = F.coalesce(
        F.expr("try_variant_get(_other_fields, concat('$.n', id), 'bigint')"),
        *[F.col(name) for name in found.columns if name.startswith("n")],
    )
    sums = found.agg(F.sum("id"), F.sum(own), F.count("_error")).first()
    assert tuple(sums) == (sum(range(100_000)), sum(range(100_000)), 0)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("{}", 0),
        ('{"a": 1}', 1),
        ('{"a": {"b": 1, "c": 2}}', 2),
        ('{"a": {}, "b": [{"x": 1}, {"y": {"z": 2}}]}', 1),
        ('{"a:{": "x:{[", "q": "\\"{:\\\\"}', 2),
        ('{"a": [[1, [2]], {"b": {}}], "c": {"d": {"e": [], "f": null}}}', 3),
        ("[1]", None),
    ],
)
def test_field_counts(spark, text, expected):
    frame = spark.createDataFrame([(text,)], "v string")
    assert frame.select(P.json_field_count(F.col("v")).alias("n")).first()["n"] == expected


def test_field_count_summary(spark):
    counts = spark.createDataFrame([(3,), (9,), (12,)], "n_fields int")
    assert tuple(P.field_count_summary(counts, 10).first()) == (12, 1, False)
    assert tuple(P.field_count_summary(counts, 0).first()) == (12, 0, True)


def test_typed_field_count(spark):
    frame = spark.createDataFrame([(1, (None, "x"), None), (None, None, [1])], "a int, s struct<b: int, c: string>, l array<int>")
    assert [row[0] for row in frame.select(P.struct_field_count(frame.schema)).collect()] == [2, 1]


def test_previews(spark):
    table = spark.createDataFrame([(f"f{i}", "\n".join(f"{i}.{j}" for j in range(10))) for i in range(30)], "k string, t string")
    lines = lines_from_column(table, "t", "k")
    assert P.preview(lines, 7).count() == 7
    rows = P.preview_per_file(lines, 5, 100).collect()
    assert len(rows) == 100 and {row["value"] for row in rows if row["source_file"] == "f0"} == {f"0.{j}" for j in range(5)}
    assert "WindowGroupLimit" in leading_lines(lines, 5)._jdf.queryExecution().toString()


def test_time_like_columns(spark):
    frame = spark.createDataFrame(
        [(1, "x", "2024-01-01 x", 1700000000, "status", "12/Jan/2024:1"), (2, "y", "z", 5, "s", "")],
        "a int, plain string, s string, big bigint, status string, web string",
    )
    rows = {row["name"]: (row["by_name"], row["by_value"]) for row in P.timestamp_candidates(frame).collect()}
    assert rows == {
        "a": (False, False), "plain": (False, False), "s": (False, True), "big": (False, True),
        "status": (True, False), "web": (False, True),
    }


def test_tabular_check(spark):
    frame = spark.createDataFrame(
        [("a", "name,age"), ("b", "this is just a log"), ("c", "x" * 51), ("d", "one two three")], "source_path string, value string"
    )
    assert {row["source_path"]: row["tabular"] for row in tabular_check(frame).collect()} == {
        "a": True, "b": False, "c": False, "d": True,
    }


# ---------------------------------------------------------------- mapping


@pytest.fixture
def person(spark):
    return spark.createDataFrame([("Al", "30", "2024-01-01", "bad")], "name string, age string, seen string, odd string")


@pytest.mark.parametrize(
    ("options", "expected"),
    [
        ({}, {"name": "Al", "age": "30", "seen": "2024-01-01", "odd": "bad"}),
        ({"mappings": {"name": "source.ip"}, "excluded": ["odd", "seen"]}, {"source.ip": "Al", "age": "30"}),
        (
            {"timestamp_field": "seen", "excluded": ["odd", "seen"]},
            {"name": "Al", "age": "30", "@timestamp": "2024-01-01T00:00:00Z"},
        ),
        (
            {"timestamp_field": "seen", "mappings": {"seen": "at"}, "excluded": ["odd", "age"]},
            {"name": "Al", "at": "2024-01-01T00:00:00Z", "@timestamp": "2024-01-01T00:00:00Z"},
        ),
        ({"timestamp_field": "odd", "excluded": ["seen", "age"]}, {"name": "Al", "odd": "bad"}),
        ({"field_types": {"age": "integer", "odd": "float", "none": "integer"}, "excluded": ["seen"]}, {"name": "Al", "age": 30}),
        ({"mappings": {"name": "x", "age": "x"}, "excluded": ["seen", "odd"]}, {"x": "30"}),
        ({"timestamp_field": "seen", "field_types": {"seen": "integer"}, "excluded": ["odd", "age"]},
         {"name": "Al", "@timestamp": "2024-01-01T00:00:00Z"}),
    ],
)
def test_mapping(person, options, expected):
    assert dicts(map_fields(person, **options)) == [expected]


def test_mapping_with_file_name(person):
    options = {"excluded": ["odd", "seen", "age"], "filename": F.lit("f.log")}
    assert dicts(map_fields(person, filename_field="source_file", **options)) == [{"name": "Al", "source_file": "f.log"}]
    assert dicts(map_fields(person, filename_field="name", **options)) == [{"name": "f.log"}]
    renamed = map_fields(person, filename_field="source_file", mappings={"source_file": "origin"}, **options)
    assert dicts(renamed) == [{"name": "Al", "origin": "f.log"}]


def test_mapping_is_one_projection(person):
    plan = map_fields(person, {"name": "n"}, ["odd"], "seen", {"age": "integer"})._jdf.queryExecution().optimizedPlan()
    assert "Join" not in plan.toString() and "Aggregate" not in plan.toString()


# ---------------------------------------------------------------- replays

BEGIN = dt.datetime(2024, 1, 1)
MINUTE = 60 * 10**6


@pytest.fixture(scope="module")
def history():
    """One key with two thirds of all events and no pause, a medium one and a sparse one."""
    random.seed(3)
    rows = []
    for key, gap, count in (("hot", 2.0, 3000), ("mid", 12.0, 800), ("cold", 300.0, 300)):
        at = 0.0
        for _ in range(count):
            at += random.choice([0, random.expovariate(1 / gap)]) if random.random() < 0.99 else 200
            rows.append((key, BEGIN + dt.timedelta(microseconds=int(at * 1e6)), random.random() < 0.8))
    return rows


def micros(moment):
    return round((moment - BEGIN) / dt.timedelta(microseconds=1))


def one_by_one(history, limit, window, lockout):
    state, out = defaultdict(list), {}
    for id_, (key, moment, failed) in sorted(enumerate(history), key=lambda item: (item[1][1], item[0])):
        at = micros(moment)
        kept = [t for t in state[key] if t > at - window]
        if len(kept) >= limit:
            out[id_] = (len(kept), 0, True) if lockout else (max(1, int((kept[0] + window - at) / 1e6) + 1), 0, False)
        elif lockout:
            kept = kept + [at] if failed else []
            out[id_] = (len(kept), limit - len(kept), False)
        else:
            kept.append(at)
            out[id_] = (0, limit - len(kept), True)
        state[key] = kept
    return out


def events_of(spark, history):
    rows = [(id_, *row) for id_, row in enumerate(history)]
    return spark.createDataFrame(rows, "id bigint, k string, ts timestamp, failed boolean").repartition(5)


@pytest.mark.parametrize("limit", [1, 3, 10])
def test_admission_replay(spark, history, limit):
    frame = replay_admission(events_of(spark, history), "k", "ts", "id", limit, 60)
    got = {row["id"]: (row["retry_after"], row["remaining"], row["allowed"]) for row in frame.collect()}
    assert got == one_by_one(history, limit, MINUTE, lockout=False)


def test_admission_without_limit(spark, history):
    frame = replay_admission(events_of(spark, history), "k", "ts", "id", 0)
    assert frame.filter("allowed and remaining = -1 and retry_after = 0").count() == len(history)


def test_admission_by_hand(spark):
    rows = [(i, "a", BEGIN + dt.timedelta(seconds=s), False) for i, s in enumerate((0, 10, 20, 61, 62))]
    frame = replay_admission(spark.createDataFrame(rows, "id bigint, k string, ts timestamp, failed boolean"), "k", "ts", "id", 2)
    assert [row["allowed"] for row in frame.orderBy("id").collect()] == [True, True, False, True, False]


def test_burst_far_beyond_the_limit(spark):
    """A window that holds many times the limit, then a few events in the next one."""
    moments = [at / 50 for at in range(3000)] + [60 + at for at in range(5)] + [200.0, 200.0, 201.0]
    history = [("burst", BEGIN + dt.timedelta(seconds=at), True) for at in moments]
    frame = replay_admission(events_of(spark, history), "k", "ts", "id", 3, 60)
    got = {row["id"]: (row["retry_after"], row["remaining"], row["allowed"]) for row in frame.collect()}
    assert got == one_by_one(history, 3, MINUTE, lockout=False)
    frame = replay_lockout(events_of(spark, history), "k", "ts", "id", F.col("failed"), 3, 1)
    got = {row["id"]: (row["failures"], row["attempts_left"], row["locked"]) for row in frame.collect()}
    assert got == one_by_one(history, 3, MINUTE, lockout=True)


def test_lockout_replay(spark, history):
    frame = replay_lockout(events_of(spark, history), "k", "ts", "id", F.col("failed"))
    got = {row["id"]: (row["failures"], row["attempts_left"], row["locked"]) for row in frame.collect()}
    assert got == one_by_one(history, 5, 15 * MINUTE, lockout=True)
    assert frame.filter("locks and (locked or attempts_left > 0)").count() == 0


@pytest.mark.parametrize(("spread", "rounds"), [("random", 8), ("regular", 1)])
def test_saturated_key_runs_in_blocks(spark, monkeypatch, spread, rounds):
    """A key without any pause and a third of all rows: many tasks, same decisions as the plain machine."""
    monkeypatch.setattr(replay, "ROUNDS", rounds)
    random.seed(8)
    history, at = [], 0.0
    for _ in range(2000):
        at += random.expovariate(1 / 2) if spread == "random" else 7
        history.append(("hot", BEGIN + dt.timedelta(microseconds=int(at * 1e6)), random.random() < 0.9))
    for number in range(4000):
        moment = BEGIN + dt.timedelta(seconds=random.randrange(40_000))
        history.append((f"calm{number % 400}", moment, random.random() < 0.9))
    used = []
    run_blocks = replay._run_blocks

    def watched(rows, *options, **named):
        if rows.filter("key = 'hot'").head(1):
            used.append(rows.filter("key = 'hot'").select("block").distinct().count())
        return run_blocks(rows, *options, **named)

    monkeypatch.setattr(replay, "_run_blocks", watched)
    events = events_of(spark, history)
    frame = replay_admission(events, "k", "ts", "id", 3, 60, block_events=150)
    got = {row["id"]: (row["retry_after"], row["remaining"], row["allowed"]) for row in frame.collect()}
    assert got == one_by_one(history, 3, MINUTE, lockout=False)
    assert used[0] >= 10
    frame = replay_lockout(events, "k", "ts", "id", F.col("failed"), 4, 1, block_events=150)
    got = {row["id"]: (row["failures"], row["attempts_left"], row["locked"]) for row in frame.collect()}
    assert got == one_by_one(history, 4, MINUTE, lockout=True)


def test_trailing_and_recent_counts(spark, history):
    times = defaultdict(list)
    for key, moment, _ in history:
        times[key].append(micros(moment))
    for key in times:
        times[key].sort()
    for row in trailing_counts(events_of(spark, history), "k", "ts", 60).collect():
        at = micros(row["ts"])
        assert row["recent"] == bisect_right(times[row["k"]], at) - bisect_right(times[row["k"]], at - MINUTE)
    now = BEGIN + dt.timedelta(minutes=30)
    recent = recent_counts(events_of(spark, history), "k", "ts", F.lit(now.replace(tzinfo=dt.timezone.utc)), 900)
    cutoff = micros(now) - 15 * MINUTE
    assert {row["k"]: row["recent"] for row in recent.collect()} == {
        key: len(values) - bisect_right(values, cutoff) for key, values in times.items()
    }


# ---------------------------------------------------------------- layouts of time columns


def _read_by_column(spark, values, **options):
    frame = spark.createDataFrame([(value,) for value in values], "at string")
    times = column_layouts(frame, ["at"], **options)["at"]
    parsed = format_utc(parse_timestamp(F.col("at"), frame.schema["at"].dataType, times.layouts))
    return times, [row.utc for row in frame.select(parsed.alias("utc")).collect()]


@pytest.mark.parametrize(
    ("values", "order", "decided", "read"),
    [
        (["01/02/2024", "13/02/2024", None, ""], "day", True, ["2024-02-01T00:00:00Z", "2024-02-13T00:00:00Z", None, None]),
        (["01/02/2024", "02/13/2024"], "month", True, ["2024-01-02T00:00:00Z", "2024-02-13T00:00:00Z"]),
        (["1.2.24", "31.12.24 7:05"], "day", True, ["2024-02-01T00:00:00Z", "2024-12-31T07:05:00Z"]),
        (["01-02-2024", "never"], "month", False, ["2024-01-02T00:00:00Z", None]),
        (["13/02/2024", "02/13/2024"], "month", False, [None, "2024-02-13T00:00:00Z"]),
        (["13/02/2024", "02/13/2024", "14.02.2024"], "day", True, ["2024-02-13T00:00:00Z", None, "2024-02-14T00:00:00Z"]),
        (
            ["10:15:30, 5 March 2024", "March 5, 2024 3:04 PM", "2024/3/5 1:02", "5-Mar-24", "2024-Mar-5"],
            "month",
            True,
            ["2024-03-05T10:15:30Z", "2024-03-05T15:04:00Z", "2024-03-05T01:02:00Z"] + ["2024-03-05T00:00:00Z"] * 2,
        ),
        (
            ["2024-01-15T00:00:00Z", "1705276800", "5 Mar 2024 10:00:00 +0200"],
            "month",
            True,
            ["2024-01-15T00:00:00Z", "2024-01-15T00:00:00Z", "2024-03-05T08:00:00Z"],
        ),
        ([None], "month", True, [None]),
    ],
)
def test_layouts_of_a_column(spark, values, order, decided, read):
    times, got = _read_by_column(spark, values)
    assert (times.order, times.decided, got) == (order, decided, read)


def test_default_order_of_an_undecided_column(spark):
    times, got = _read_by_column(spark, ["01/02/2024"], default_order="day")
    assert (times.order, times.decided, got) == ("day", False, ["2024-02-01T00:00:00Z"])


def test_mapping_with_the_layouts_of_a_column(spark):
    frame = spark.createDataFrame([("01/02/2024", 1), ("13/02/2024", 2), ("x", 3)], "seen string, n int")
    times = column_layouts(frame, ["seen"])["seen"]
    rows = map_fields(frame, timestamp_field="seen", layouts=times.layouts).orderBy("n").collect()
    assert [(row["@timestamp"], row.seen) for row in rows] == [
        ("2024-02-01T00:00:00Z", "2024-02-01T00:00:00Z"), ("2024-02-13T00:00:00Z", "2024-02-13T00:00:00Z"), (None, "x")
    ]
    empty = column_layouts(frame.limit(0), ["seen"])["seen"]
    assert (empty.layouts, empty.decided) == ((), True)


def test_every_shape_has_a_working_layout(spark):
    """Each shape of the grammar: its layout reads a value of that shape."""
    dates = ["N/N/Y", "N.N.N", "N N Y", "N B Y", "N-B-N", "NBY", "B N, Y", "B N Y", "Y-N-N", "Y/B/N"]
    clocks = ["", ", N:N:N", "tN:N", " N:NP", " N:N:N Z"]
    shapes = [date + clock for date in dates for clock in clocks] + ["N:N " + date for date in dates]
    sample = {"N": "07", "Y": "2024", "B": "Jul", "P": "am", "Z": "+0000", "t": "T"}
    rows = [(shape, "".join(sample.get(char, char) for char in shape)) for shape in shapes]
    read = [from_text(F.lit(value), (layout_of(shape, "day"),)).cast("date").cast("string") for shape, value in rows]
    days = spark.range(1).select(F.array(*read).alias("days")).first().days
    want = ["2024-07-07" if "Y" in shape else "2007-07-07" for shape in shapes]
    assert dict(zip(shapes, days, strict=True)) == dict(zip(shapes, want, strict=True))
    found = spark.createDataFrame(rows, "shape string, at string").select("shape", shape_of(clean_time_text(F.col("at"))).alias("got"))
    assert {row.shape: row.got for row in found.collect()} == dict(zip(shapes, shapes, strict=True))
