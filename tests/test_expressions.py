"""Timestamps, coercion, numeric grammar, regex translation, addresses."""

from __future__ import annotations

import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.coercion import TARGET_TYPES, coerce
from logloom.functions.grok_library import BUILTIN_PATTERNS, builtin_components, component_dictionary
from logloom.functions.literals import text_type
from logloom.functions.regexes import PatternError, compile_pattern, expand_grok
from logloom.functions.timestamps import format_utc, parse_timestamp
from logloom.operators.allowlist import check_allowlists
from logloom.operators.patterns import extract_fields, match_spans, pattern_coverage, sample_misses
from tests.conftest import dicts

TIMES = {
    "2024-01-15T10:00:00Z": "2024-01-15T10:00:00Z",
    " 2024-01-15 10:00 ": "2024-01-15T10:00:00Z",
    "2024-01-15": "2024-01-15T00:00:00Z",
    "2024-01-15T10:00:00.999+05:30": "2024-01-15T04:30:00Z",
    "2024-01-15T10:00:00-0800": "2024-01-15T18:00:00Z",
    "2024-01-15T10:00:00,5Z": "2024-01-15T10:00:00Z",
    "17/May/2015:08:05:02 +0000": "2015-05-17T08:05:02Z",
    "17/May/2015:08:05:02 -0530 rest": "2015-05-17T13:35:02Z",
    "20240115": "1970-08-23T06:15:15Z",
    "2024": "1970-01-01T00:33:44Z",
    "1705312800": "2024-01-15T10:00:00Z",
    "4102444800": "2100-01-01T00:00:00Z",
    "4102444801": "1970-02-17T11:34:04Z",
    "1705312800123": "2024-01-15T10:00:00Z",
    "Mon, 15 Jan 2024 10:00:00 +0200": "2024-01-15T08:00:00Z",
    "Mon, 15 Jan 2024 10:00:00 GMT": "2024-01-15T10:00:00Z",
    "Jan  5 10:00:00": "2023-01-05T10:00:00Z",
    "01/02/2024": "2024-01-02T00:00:00Z",
    "13/02/2024 10:11": "2024-02-13T10:11:00Z",
    "01/02/2024 3:04 PM": "2024-01-02T15:04:00Z",
    "January 5, 2024": "2024-01-05T00:00:00Z",
    "Mon Jan 15 10:00:00 2024": "2024-01-15T10:00:00Z",
    "2024/01/15 01:02:03": "2024-01-15T01:02:03Z",
    "": None,
    "junk": None,
    "2024-13-01": None,
    "99999999999999999": None,
    "9" * 40: None,
}


def test_text_times(spark):
    frame = spark.createDataFrame([(text,) for text in TIMES], "v string")
    utc = format_utc(parse_timestamp(F.col("v"), T.StringType(), default_year=2023))
    assert {row["v"]: row["t"] for row in frame.select("v", utc.alias("t")).collect()} == TIMES


@pytest.mark.parametrize(
    ("value", "kind", "expected"),
    [
        (0, "bigint", "1970-01-01T00:00:00Z"),
        (-1, "bigint", "1969-12-31T23:59:59Z"),
        (1705312800, "bigint", "2024-01-15T10:00:00Z"),
        (1705312800999, "bigint", "2024-01-15T10:00:00Z"),
        (1705312800.75, "double", "2024-01-15T10:00:00Z"),
        (float("nan"), "double", None),
        (float("inf"), "double", None),
        (10**18, "bigint", None),
        (True, "boolean", "1970-01-01T00:00:01Z"),
        (None, "bigint", None),
    ],
)
def test_numeric_times(spark, value, kind, expected):
    frame = spark.createDataFrame([(value,)], f"v {kind}")
    utc = format_utc(parse_timestamp(F.col("v"), frame.schema["v"].dataType))
    assert frame.select(utc.alias("t")).first()["t"] == expected


def python_coerce(text, target):
    if text is None or text == "":
        return None
    if target == "string":
        return text
    if target == "boolean":
        word = text.lower().strip()
        return True if word in ("true", "1", "yes", "on") else False if word in ("false", "0", "no", "off") else None
    try:
        number = float(text)
    except ValueError:
        return None
    if target == "float":
        return number
    return int(number) if abs(number) < 2**63 else None


TEXTS = [
    "1", " 12 ", "1_000", "1__0", "_1", "1.9", "-1.9", "1e3", "1E-2", "inf", "-Infinity", "1d", "0x1", "", None, "True",
    " yes ", "off", ".5", "5.", ".", "+7", "1e400", "9223372036854775808", "\t3\n", "0_1", "1_0.5_0", "12abc", "NO", "2",
]


@pytest.mark.parametrize("target", TARGET_TYPES)
def test_text_coercion_follows_number_syntax(spark, target):
    frame = spark.createDataFrame([(text,) for text in TEXTS], "v string")
    got = [row["c"] for row in frame.select(coerce(F.col("v"), T.StringType(), target)[0].alias("c")).collect()]
    assert got == [python_coerce(text, target) for text in TEXTS]


@pytest.mark.parametrize(
    ("value", "kind", "target", "expected"),
    [
        (True, "boolean", "integer", 1),
        (True, "boolean", "float", 1.0),
        (2.9, "double", "integer", 2),
        (-2.9, "double", "integer", -2),
        (float("nan"), "double", "integer", None),
        (0, "bigint", "boolean", False),
        (5, "bigint", "boolean", True),
        (5, "bigint", "string", "5"),
        ([1], "array<int>", "integer", None),
        ([1], "array<int>", "string", "[1]"),
        ([1], "array<int>", "array", [1]),
        ("", "string", "object", None),
    ],
)
def test_typed_coercion(spark, value, kind, target, expected):
    frame = spark.createDataFrame([(value,)], f"v {kind}")
    assert frame.select(coerce(F.col("v"), frame.schema["v"].dataType, target)[0].alias("c")).first()["c"] == expected


def test_text_types(spark):
    def python_type(text):
        for kind, parse in (("integer", int), ("float", float)):
            try:
                parse(text)
                return kind
            except ValueError:
                pass
        return "string"

    texts = [text for text in TEXTS if text] + ["nan", "infinity", "1e5"]
    frame = spark.createDataFrame([(text,) for text in texts], "v string")
    assert [row[0] for row in frame.select(text_type(F.col("v"))).collect()] == [python_type(text) for text in texts]


# ---------------------------------------------------------------- patterns


def test_every_builtin_component_compiles_and_runs(spark):
    frame = spark.createDataFrame([("x",)], "value string")
    for name in BUILTIN_PATTERNS:
        assert extract_fields(frame, compile_pattern(f"%{{{name}:f}}"), engine="jvm").count() == 1
    assert len(BUILTIN_PATTERNS) == 64


def test_component_table_and_registry(spark):
    listed = builtin_components(spark)
    names = [row["name"] for row in listed.collect()]
    assert names == sorted(BUILTIN_PATTERNS)
    registry = spark.createDataFrame([("WORD", "[a-z]+"), ("ORDER_ID", r"ORD-%{INT}")], "name string, regex string")
    components = component_dictionary(registry)
    assert components["WORD"] == "[a-z]+"
    assert re.match(expand_grok("%{ORDER_ID:id}", components), "ORD-12")["id"] == "ORD-12"


def test_grok_errors():
    with pytest.raises(PatternError, match="unknown pattern component"):
        compile_pattern("%{NONEXISTENT:field}")
    with pytest.raises(PatternError, match="nested too deeply"):
        compile_pattern("%{A}", components={"A": "%{A}"})
    with pytest.raises(PatternError, match="invalid regular expression"):
        compile_pattern("(?P<x>[", "regex")


def test_named_group_spellings_and_types(spark):
    frame = spark.createDataFrame([("12 ab",)], "value string")
    for text in (r"(?<n>\d+) (?<w_1>\w+)", r"(?'n'\d+) (?'w_1'\w+)", r"(?P<n>\d+) (?P<w_1>\w+)"):
        assert dicts(extract_fields(frame, compile_pattern(text, "regex")).drop("value")) == [{"n": "12", "w_1": "ab"}]
    assert compile_pattern("%{INT:n:int}").field_names == ["n"]


PATTERNS = [
    r"(?P<a>\w+)",
    r"(?P<a>[^[]+)\[(?P<b>\d*)\]",
    r"(?P<a>x{,2})(?P<b>{y})?",
    r"(?P<a>\w+)\s(?P=a)",
    r"(?P<a>a|b)?(?P<b>.*)$",
    r"(?:(?P<a>\d+)|(?P<b>[a-z&&]+))-",
    r"(?i)(?P<a>ABC)\Z",
    r"(?P<a>\D*)(?P<b>\d{2,})?",
    r"(?P<a>(x)(y))(?P<b>z?)",
]
LINES = [
    "abc def", "é_1", "abc[12]", "abc[]", "xx{y}", "xxx", "go go", "go no", "a tail", "tail", "12-", "a&-", "aBc",
    "abcd", "no 123", "x1", "xyz", "xy", "", "tab\there",
]


@pytest.mark.parametrize("text", PATTERNS)
def test_translation_agrees_with_python(spark, text):
    frame = spark.createDataFrame([(line,) for line in LINES], "value string")
    found = extract_fields(frame, compile_pattern(text, "regex"))
    for row in found.collect():
        match = re.match(text, row["value"])
        if match:
            assert {name: row[name] for name in match.groupdict()} == match.groupdict(), row["value"]
        else:
            assert row["raw_message"] == row["value"]


def test_separator_inside_the_text(spark):
    frame = spark.createDataFrame([("a\x01b c",), ("\x01",)], "value string")
    rows = extract_fields(frame, compile_pattern(r"(?P<x>[a-z\x01]+b) (?P<y>c)", "regex")).collect()
    assert [(row["x"], row["y"], row["raw_message"]) for row in rows] == [("a\x01b", "c", None), (None, None, "\x01")]


def test_match_spans_search_is_not_anchored(spark):
    frame = spark.createDataFrame([("id=7 user=bob",), ("none",)], "value string")
    spans = match_spans(frame, compile_pattern(r"user=(?P<name>\w+)(?P<tail>!)?", "regex")).collect()
    assert [spans[0][c] for c in ("match_start", "match_end", "name_start", "name_end", "tail_start")] == [5, 13, 10, 13, None]
    assert spans[1]["match_start"] is None


@pytest.mark.parametrize(
    "regex",
    [r"b(?P<x>\w)(?P<y>!)?", r"(?P<x>a+)(?P<y>b*)$", r"^(?P<x>.)", r"(?P<x>\w)(?P=x)(?P<y>.)", r"(?P<x>q|\n)", r"(?i)(?P<x>É)\b"],
)
def test_spans_of_all_fields_equal_a_plain_search(spark, regex):
    texts = ["", "abc! b!", "aab", "xx\nyy", "é 😀 bb!", "a\x01bc!", "line\nbé", "aaa\x01bbb", "zé", None]
    pattern = compile_pattern(regex, "regex")
    frame = spark.createDataFrame([(at, text) for at, text in enumerate(texts)], "at int, value string")
    for row in match_spans(frame, pattern).collect():
        found = re.search(pattern.python_regex, row["value"]) if row["value"] is not None else None
        assert (row["match_start"], row["match_end"]) == (found.span() if found else (None, None)), row
        for name in pattern.field_names:
            text = found[name] if found else None
            if not text:
                continue
            start = row["value"].index(text, found.start())
            assert (row[f"{name}_start"], row[f"{name}_end"]) == (start, start + len(text)), row


def test_many_patterns_count_as_each_alone(spark):
    chance = random.Random(3)
    words = ["alpha", "alphabet", "beta", "bet", "gamma", "al", "ham", "x"]
    texts = [" ".join(chance.choices(words, k=chance.randrange(5))) for _ in range(400)] + [None, "", "é alpha\nbeta"]
    patterns = {f"{a}{n}": compile_pattern(f"%{{DATA}}{a}{n}", "grok") for a in words for n in ("", "\\b", "?", " b", "(?:x|y)?")}
    patterns["any"] = compile_pattern("%{WORD}")
    frame = spark.createDataFrame([(text,) for text in texts], "value string")
    wide, narrow = (pattern_coverage(frame, patterns, engine=engine).collect() for engine in ("automaton", "jvm"))
    assert sorted(map(tuple, wide)) == sorted(map(tuple, narrow))
    assert len(patterns) > 16 and any(row["matches"] for row in wide)
    empty = pattern_coverage(frame.limit(0), patterns).collect()
    assert {tuple(row)[1:] for row in empty} == {(0, 0, None)} and len(empty) == len(patterns)


def test_coverage_and_misses(spark):
    frame = spark.createDataFrame([("1 a",), ("2 b",), ("x",), (None,)], "value string")
    patterns = {"number": compile_pattern("%{INT:n}"), "any": compile_pattern("%{GREEDYDATA:g}")}
    rows = {row["pattern"]: (row["lines"], row["matches"]) for row in pattern_coverage(frame, patterns).collect()}
    assert rows == {"number": (4, 2), "any": (4, 3)}
    assert sample_misses(frame.filter("value is not null"), patterns["number"]).collect()[0]["line"] == "x"


# ---------------------------------------------------------------- addresses

ALLOWLISTS = [
    "10.0.0.0/24, 192.168.1.5, 172.16.0.0/16", "", None, "  ", "bad, 1.2.3.4/33, 10.0.0.1", "2001:db8::/33",
    "::1,fe80::1%eth0", "fe80::/10", "0.0.0.0/0", "::/0", "10.1.2.3/255.255.0.0", "10.1.2.3/0.0.0.255",
    "::ffff:1.2.3.4", "1::2::3", "10.0.0.0/8/8", "192.168.1.77/29", "2001:db8:0:0:0:0:0:ff/125", "01.2.3.4", ",,",
]
ADDRESSES = [
    "10.0.0.50", "192.168.1.5", "172.16.100.200", "8.8.8.8", "unknown", "", "10.1.9.9", "10.1.2.250",
    "2001:db8:7fff::1", "2001:db8:8000::1", "::1", "fe80::1%eth0", "fe80::1", "FE80::abcd", "::ffff:1.2.3.4",
    "::ffff:102:304", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8", "1::", "::", ":1::2", "192.168.1.72", "192.168.1.80",
    "2001:db8::f8", "2001:db8::f7", "12345::", "g::1", "1.2.3", "01.2.3.4",
]


def python_allowed(address, allowlist):
    if not allowlist or not allowlist.strip():
        return True
    try:
        client = ipaddress.ip_address(address)
    except ValueError:
        return False
    for entry in filter(None, (part.strip() for part in allowlist.split(","))):
        try:
            if client in ipaddress.ip_network(entry, strict=False) if "/" in entry else client == ipaddress.ip_address(entry):
                return True
        except ValueError:
            continue
    return False


def test_allowlists_agree_with_the_address_library(spark):
    keys = spark.createDataFrame(list(enumerate(ALLOWLISTS)), "key int, allowed_ips string")
    access = spark.createDataFrame(
        [(key, address) for key in range(len(ALLOWLISTS) + 1) for address in ADDRESSES], "key int, ip string"
    )
    for listed_ranges in (64, 1, 0):  # lists longer than this are joined entry by entry
        rows = check_allowlists(access, keys, "key", listed_ranges=listed_ranges).collect()
        assert len(rows) == (len(ALLOWLISTS) + 1) * len(ADDRESSES)
        for row in rows:
            known = row["key"] < len(ALLOWLISTS)
            assert row["allowed"] == (known and python_allowed(row["ip"], ALLOWLISTS[row["key"]])), row


def test_an_allowlist_of_a_hundred_thousand_entries(spark):
    """One key holds nearly all accesses and a list of networks of every length."""
    chance = random.Random(7)
    entries = [f"{chance.randrange(11, 200)}.{chance.randrange(256)}.{chance.randrange(256)}.{chance.randrange(256)}/{chance.randrange(18, 33)}" for _ in range(60_000)]
    entries += [f"{chance.randrange(11, 200)}.{chance.randrange(256)}.0.9" for _ in range(20_000)]
    entries += [f"2001:db8:{chance.randrange(65536):x}:{chance.randrange(65536):x}::/{chance.randrange(40, 129)}" for _ in range(20_000)]
    addresses = [entry.split("/")[0] for entry in entries[::40]]
    addresses += [f"{chance.randrange(11, 200)}.{chance.randrange(256)}.{chance.randrange(256)}.1" for _ in range(1500)] + ["2001:db8::5%x", "bad"]
    keys = spark.createDataFrame([(1, ",".join(entries)), (2, "10.0.0.1"), (3, "")], "key int, allowed_ips string")
    access = spark.createDataFrame(
        [(1, a) for a in addresses] + [(1, addresses[0])] * 3 + [(2, "10.0.0.1"), (2, "10.0.0.2"), (3, "bad"), (4, "10.0.0.1")],
        "key int, ip string",
    )
    networks = {}
    singles = set()
    for entry in entries:
        if "/" in entry:
            net = ipaddress.ip_network(entry, strict=False)
            networks.setdefault((net.version, net.prefixlen), set()).add(int(net.network_address))
        else:
            singles.add(ipaddress.ip_address(entry))

    def expected(key, text):
        if key != 1:
            return (key, text) in ((2, "10.0.0.1"), (3, "bad"))
        try:
            address = ipaddress.ip_address(text)
        except ValueError:
            return False
        bits = 32 if address.version == 4 else 128
        inside = any(
            (int(address) >> (bits - length) << (bits - length)) in starts
            for (version, length), starts in networks.items() if version == address.version
        )
        return inside or address in singles

    rows = check_allowlists(access, keys, "key").collect()
    assert len(rows) == access.count()
    for row in rows:
        assert row["allowed"] == expected(row["key"], row["ip"]), row
    assert 1000 < sum(row["allowed"] for row in rows) < len(rows)


def test_marks_inside_pairs_are_kept(spark):
    """Values may hold the characters that mark pairs internally."""
    from logloom.functions.line_formats import logfmt_pairs, ltsv_pairs, pair_value

    frame = spark.createDataFrame([("a:x\x01y\x02z\tb: q \t:e", 'a=x\x01y b="\x02 z" c= d=""')], "ltsv string, logfmt string")
    row = frame.select(
        *[pair_value(ltsv_pairs(F.col("ltsv")), key).alias(f"l{key}") for key in ("a", "b")],
        *[pair_value(logfmt_pairs(F.col("logfmt")), key).alias(f"f{key}") for key in ("a", "b", "d")],
    ).first()
    assert tuple(row) == ("x\x01y\x02z", "q", "x\x01y", "\x02 z", None)
