"""Record sources on small files."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from logloom.functions.regexes import compile_pattern
from logloom.plans.preview import preview_files
from logloom.sources import delimited, lines as lines_module
from logloom.sources import lines as lines_module
from logloom.sources.lines import check_total_size, raw_sample, read_lines
from logloom.sources import json_arrays
from logloom.sources.records import data_columns, parse_lines, read_logs
from logloom.workloads.files import _order_log
from tests.conftest import dicts

PEOPLE = [
    {"name": "Alice", "age": 30, "active": True},
    {"name": "Bob", "age": 25, "active": False},
    {"name": "Charlie", "age": 35, "active": True},
]


def records(spark, path, fmt, **options):
    frame = read_logs(spark, path, fmt, **options)
    return sorted(dicts(frame.drop("_source_file")), key=repr), frame


def test_json_array(spark, put):
    rows, frame = records(spark, put("test.json", json.dumps(PEOPLE, indent=2)), "json_array")
    assert rows == sorted(PEOPLE, key=repr)
    assert dict(frame.dtypes)["age"] == "bigint" and dict(frame.dtypes)["active"] == "boolean"
    assert data_columns(frame) == ["name", "age", "active"]


@pytest.mark.parametrize("text", ["[]", " [ ] \n", "[\n]"])
def test_empty_json_array(spark, put, text):
    frame = read_logs(spark, put("e.json", text), "json_array")
    assert frame.count() == 0


@pytest.mark.parametrize(("split_bytes", "buffer"), [("400", 1 << 20), ("2k", 16)])
def test_json_array_over_splits(spark, put, monkeypatch, split_bytes, buffer):
    """Splits end anywhere: in strings, after backslashes, in long elements, in white space."""
    monkeypatch.setattr(json_arrays, "BUFFER_BYTES", buffer)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        items = [{"i": i, "s": 'a,b]}"{[\\' * (i % 3), "n": {"k": [1, {"z": [i]}], "e": {}}} for i in range(60)]
        items[30]["s"] = '",]\\",' * 300
        text = "\ufeff  " + json.dumps(items, separators=(",", ":")) + "\n" + " " * 400
        elements = json_arrays.read_array_elements(spark, put("nested.json", text)).orderBy("split_start", "line_id")
        assert [json.loads(row["value"]) for row in elements.collect()] == items
        rows = read_logs(spark, put("n2/nested.json", text), "json_array").orderBy("i").collect()
        assert [(row["i"], row["s"], json.loads(row["n"].toJson())) for row in rows] == [
            (item["i"], item["s"], item["n"]) for item in items
        ]
        plain = json.dumps([1, "x,y", None, [2, [3, "]"]], {}], indent=1) + "[7, 8]"
        elements = json_arrays.read_array_elements(spark, put("plain.json", plain)).orderBy("split_start", "line_id")
        assert [json.loads(row["value"]) for row in elements.collect()] == [1, "x,y", None, [2, [3, "]"]], {}, 7, 8]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_broken_json_arrays(spark, put, monkeypatch):
    """Text outside of an array, an array that never closes, and an element beyond the limit are bad records."""
    monkeypatch.setattr(json_arrays, "BUFFER_BYTES", 50)
    monkeypatch.setattr(json_arrays, "MAX_ELEMENT_BYTES", 300)

    def outcome(name, text):
        rows = read_logs(spark, put(name, text), "json_array").collect()
        return sorted(row["a"] for row in rows if row["a"] is not None), sum(row["a"] is None for row in rows)

    good = [{"a": at} for at in range(20)]
    assert outcome("tail.json", json.dumps(good) + " rest") == (list(range(20)), 1)
    unclosed = json.dumps(good)[:-1] + ', {"a": 99, "b": ["x", '
    assert outcome("open.json", unclosed) == (list(range(20)), 1)
    long_one = [*good, {"a": 50, "b": "y," * 400}, {"a": 51}]
    assert outcome("long.json", json.dumps(long_one)) == ([*range(20), 51], 1)


def test_ndjson_with_blank_and_bad_lines(spark, put):
    text = "\n".join(json.dumps(p) for p in PEOPLE) + "\n\n  \n{\"name\": \n[1]\n"
    rows, frame = records(spark, put("test.ndjson", text), "ndjson")
    good = [row for row in rows if "_error" not in row]
    assert good == sorted(PEOPLE, key=repr)
    assert sorted((row["_record"], row["_error"]) for row in rows if "_error" in row) == [
        ("[1]", "record is not an object"),
        ('{"name":', "malformed JSON"),
    ]


def test_ndjson_too_many_fields(spark, put):
    wide = {"n": {f"k{i}": i for i in range(8)}, "text": "a:b:c:d:e:f:g"}
    path = put("w.ndjson", json.dumps(wide) + "\n" + json.dumps({"text": "a:b:c:d:e:f:g:h:i"}) + "\n")
    rows, _ = records(spark, path, "ndjson", max_fields=5)
    assert [row.get("_error") for row in rows if "_error" in row] == ["more than 5 fields"]


def test_csv(spark, put):
    rows, _ = records(spark, put("test.csv", "name,age,active\nAlice,30,true\nBob,25,false\n"), "csv")
    assert rows == [{"name": "Alice", "age": "30", "active": "true"}, {"name": "Bob", "age": "25", "active": "false"}]


def test_csv_semicolon_and_given_delimiter(spark, put):
    path = put("s.csv", "name;age;active\nAlice;30;true\nBob;25;false\n")
    assert records(spark, path, "csv")[0][1] == {"name": "Bob", "age": "25", "active": "false"}
    assert records(spark, path, "csv", delimiter=";")[0] == records(spark, path, "csv")[0]


@pytest.mark.parametrize("split_bytes", [1 << 27, 16])
def test_csv_quotes_ragged_rows_and_repeated_header(spark, put, split_bytes):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    text = 'id,a,a,note\n1,x,y,"two\nlines, ""q"""\n2,x\n\n3,x,y,z,surplus\n'
    rows, frame = records(spark, put("r.csv", text), "csv")
    assert data_columns(frame) == ["id", "a", "note"]
    assert rows == sorted(
        [{"id": "1", "a": "y", "note": 'two\nlines, "q"'}, {"id": "2"}, {"id": "3", "a": "y", "note": "z"}], key=repr
    )
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("block_lines", [1 << 18, 2, 1])
@pytest.mark.parametrize("files", [1, 3])
@pytest.mark.parametrize("split_bytes", [1 << 27, 24])
def test_csv_has_one_grammar_at_every_size(spark, put, monkeypatch, block_lines, files, split_bytes):
    """Stray quotes, quoted line breaks and doubled quotes, over any splits, blocks and files."""
    monkeypatch.setattr(lines_module, "BLOCK_LINES", block_lines)
    random.seed(block_lines)
    expected, paths = [], []
    for number in range(files):
        sep = ",;|"[number]
        body = [f'{sep.join("ab")}\n']
        for at in range(40):
            cells = [random.choice(["", "x", 'y" z', 'q"', "line\nbreak", f"{sep}", '"', '""\n"', '\n"']) for _ in range(2)]
            text = []
            for cell in cells:
                plain = not cell.startswith('"') and not any(c in cell for c in f"\n{sep}")
                text.append(cell if plain else '"' + cell.replace('"', '""') + '"')
            if any(cells):
                body.append(sep.join(text) + "\n")
                expected.append({name: cell for name, cell in zip("ab", cells) if cell})
        paths.append(put(f"g{block_lines}-{split_bytes}-{files}-{number}.csv", "".join(body)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    rows, _ = records(spark, paths, "csv")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == sorted(expected, key=repr)


def test_csv_with_a_stray_quote_keeps_its_records(spark, put):
    path = put("stray.csv", 'a,b\n1,5" disk\n2,x\n3,6" disk\n4,y\n')
    assert len(records(spark, path, "csv")[0]) == 4


def test_csv_delimiter_is_each_files_own(spark, put):
    paths = [put("a.csv", "a,b\n1,2\n"), put("b.csv", "a;b\n3;4\n"), put("c.csv", 'b|a\n"x|\ny"|5\n')]
    assert records(spark, paths, "csv")[0] == [{"a": "1", "b": "2"}, {"a": "3", "b": "4"}, {"a": "5", "b": "x|\ny"}]


def test_csv_files_with_different_headers_are_united_by_name(spark, put):
    paths = [put("one.csv", "a,b\n1,2\n"), put("two.csv", "b,a,c\n3,4,5\n")]
    rows, _ = records(spark, paths, "csv")
    assert rows == [{"a": "1", "b": "2"}, {"a": "4", "b": "3", "c": "5"}]


@pytest.mark.parametrize("open_quotes", [False, True])
@pytest.mark.parametrize("mixed", [False, True])
def test_csv_many_files(spark, put, mixed, open_quotes):
    note = '"two\nlines"' if open_quotes else "plain"
    expected, paths = [], []
    for number in range(6):
        if mixed and number % 2:
            paths.append(put(f"f{number}.csv", f"b,a,c\n{number},x,{note}\n\n"))
            expected.append({"a": "x", "b": str(number), "c": note.strip('"')})
        else:
            paths.append(put(f"f{number}.csv", f"a,b\ny,{number}\nz,{note},surplus\n"))
            expected += [{"a": "y", "b": str(number)}, {"a": "z", "b": note.strip('"')}]
    rows, _ = records(spark, paths, "csv")
    assert rows == sorted(expected, key=repr)


def test_wordy_header_is_rejected_only_on_request(spark, put):
    path = put("log.csv", "this is just a plain log message\nanother one\n")
    assert read_logs(spark, path, "csv").count() == 1
    with pytest.raises(ValueError, match="not a table"):
        read_logs(spark, path, "csv", check_tabular=True)


def test_delimiter_vote():
    assert delimited.vote_delimiter("a;b;c\n1,5;2;3\n") == ";"
    assert delimited.vote_delimiter("a|b\n1|2\n") == "|"
    assert delimited.vote_delimiter("single\ncolumn\n") == ","


def test_tsv_tabs(spark, put):
    rows, _ = records(spark, put("t.tsv", "name\tage\tcity\nAlice\t30\tNYC\nBob\t25\tLA\n"), "tsv")
    assert rows == [{"name": "Alice", "age": "30", "city": "NYC"}, {"name": "Bob", "age": "25", "city": "LA"}]


def test_tsv_spaces(spark, put):
    text = "name  age   city\n  Alice  30  New York\nBob   25\n\nC  1  LA  extra\n"
    rows, _ = records(spark, put("t.tsv", text), "tsv")
    assert rows == [
        {"name": "Alice", "age": "30", "city": "New York"},
        {"name": "Bob", "age": "25", "city": ""},
        {"name": "C", "age": "1", "city": "LA"},
    ]


@pytest.mark.parametrize("order", [1, -1])
def test_tsv_tabs_and_spaces_in_one_set(spark, put, order):
    """Each file is split by its own rule, whichever comes first."""
    paths = [
        put("tabs.tsv", "name\tage\nAnn Lee  Poe\t30\n\"a\nb\"\t31\n"),
        put("more.tsv", "age\tcity\n32\tNew York\n"),
        put("spaces.tsv", "name      age   zip\nBob Ray   25    x\nCy        26\n"),
    ]
    rows = read_logs(spark, paths[::order], "tsv").select("name", "age", "city", "zip", "_source_file").collect()
    got = {tuple(value or None for value in row) for row in rows}
    assert len(rows) == 5 and got == {
        ("Ann Lee  Poe", "30", None, None, "tabs.tsv"),
        ("a\nb", "31", None, None, "tabs.tsv"),
        (None, "32", "New York", None, "more.tsv"),
        ("Bob Ray", "25", None, "x", "spaces.tsv"),
        ("Cy", "26", None, None, "spaces.tsv"),
    }


def test_ltsv(spark, put):
    text = "host:1.1.1.1\tmethod:GET\tpath:/a:b\nno label\na : 1   b:2  a:3\n"
    rows, _ = records(spark, put("l.ltsv", text), "ltsv")
    assert rows == sorted([{"host": "1.1.1.1", "method": "GET", "path": "/a:b"}, {"a": "3", "b": "2"}], key=repr)


def test_syslog(spark, put):
    text = (
        "<34>Oct 11 22:14:15 mymachine su: 'su root' failed for user on /dev/pts/8\n"
        '<165>1 2003-10-11T22:14:15.003Z host app 123 ID47 [ex a="1"] hello\n'
        "<165>1 2003-10-11T22:14:15.003Z host app - - - hello\n"
        "\nThis is just a plain log message\n"
    )
    rows, _ = records(spark, put("s.log", text), "syslog")
    by_message = {row["message"]: row for row in rows}
    older = by_message["'su root' failed for user on /dev/pts/8"]
    assert older == {
        "priority": "34", "timestamp": "Oct 11 22:14:15", "hostname": "mymachine", "app_name": "su",
        "message": "'su root' failed for user on /dev/pts/8",
    }
    assert by_message["hello"]["msg_id"] == "ID47" and by_message["hello"]["version"] == "1"
    assert by_message["- hello"]["proc_id"] == "-"
    assert by_message["This is just a plain log message"] == {"message": "This is just a plain log message"}


def test_logfmt(spark, put):
    text = 'level=info msg="two words" k="" user=\'x y\' level=warn\nnothing\né_1=ü open="a b=c\n'
    rows, _ = records(spark, put("f.log", text), "logfmt")
    assert rows == sorted(
        [{"level": "warn", "msg": "two words", "user": "x y"}, {"é_1": "ü", "open": '"a', "b": "c"}], key=repr
    )


def test_logfmt_multiline_keeps_lines_without_pairs(spark, put):
    text = "a=1 b=2\n  c=3\nplain\na=4\n"
    rows, _ = records(spark, put("m.log", "x\n" + text), "logfmt", multiline_start="a=")
    assert rows == sorted([{"raw_message": "x"}, {"a": "1", "b": "2", "c": "3"}, {"a": "4"}], key=repr)


def test_raw_keeps_blank_lines(spark, put):
    rows, _ = records(spark, put("r.txt", "one\n\ntwo\n"), "raw")
    assert [row["raw_message"] for row in rows] == ["", "one", "two"]


def test_regex_and_grok_patterns(spark, put):
    path = put("p.log", "192.168.1.1 john login\n10.0.0.1 jane logout\ninvalid line\n\n")
    regex = compile_pattern(r"(?P<ip>\d+\.\d+\.\d+\.\d+)\s+(?P<user>\w+)\s+(?P<action>\w+)", "regex")
    rows, frame = records(spark, path, "custom", pattern=regex)
    assert data_columns(frame) == ["ip", "user", "action", "raw_message"]
    assert {"raw_message": "invalid line"} in rows and {"ip": "10.0.0.1", "user": "jane", "action": "logout"} in rows
    assert len(rows) == 3
    grok = compile_pattern("%{IP:client_ip} - %{USER:username}")
    rows, _ = records(spark, put("g.log", "192.168.1.1 - admin\n10.0.0.1 - guest\n"), "custom", pattern=grok)
    assert rows == [{"client_ip": "10.0.0.1", "username": "guest"}, {"client_ip": "192.168.1.1", "username": "admin"}]


def test_many_files_and_provenance(spark, put):
    paths = [put("a.ndjson", '{"x": 1}\n'), put("b.ndjson", '{"x": 2}\n')]
    frame = read_logs(spark, paths, "ndjson")
    assert sorted((row["_source_file"], row["x"]) for row in frame.collect()) == [("a.ndjson", 1), ("b.ndjson", 2)]


def test_repeated_names_and_unknown_formats_are_errors(spark, put):
    with pytest.raises(ValueError, match="repeated file names"):
        read_logs(spark, [put("d1/a.log", "x"), put("d2/a.log", "y")], "raw")
    with pytest.raises(ValueError, match="unknown format"):
        read_logs(spark, put("a.bin", "x"), "xml")
    with pytest.raises(ValueError, match="needs a pattern"):
        parse_lines(read_lines(spark, put("b.log", "x")), "custom")


def test_known_fields_need_no_discovery(spark, put):
    frame = read_logs(spark, put("k.ltsv", "a:1\tb:2\n"), "ltsv", fields=[("b", "string", "string")])
    assert data_columns(frame) == ["b"] and frame.first()["b"] == "2"


def test_sample_and_size_guard(spark, put):
    path = put("s.txt", "\n".join(str(i) for i in range(30)))
    assert [row["value"] for row in raw_sample(spark, path).collect()] == [str(i) for i in range(10)]
    assert check_total_size(spark, path, 1000) > 0
    with pytest.raises(ValueError, match="more than the limit"):
        check_total_size(spark, path, 10)


def test_split_files_keep_their_line_order(spark, put):
    path = put("big.log", "\n".join(("start " if i % 7 == 0 else " more ") + str(i) for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert read_lines(spark, path).select("split_start").distinct().count() > 5
        rows = read_logs(spark, path, "raw", multiline_start="start").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    texts = sorted((row["raw_message"] for row in rows), key=lambda text: int(text.split()[1]))
    assert texts[0] == "\n".join(["start 0", *[f" more {i}" for i in range(1, 7)]])
    assert len(texts) == 572


def test_names_that_differ_in_case(spark, put):
    path = put("case.ndjson", '{"User": 1, "user": "a"}\n{"user": "b", "USER": true}\n')
    rows, frame = records(spark, path, "ndjson")
    assert data_columns(frame) == ["User", "user_2", "USER_3"]
    assert rows == sorted([{"User": 1, "user_2": "a"}, {"user_2": "b", "USER_3": True}], key=repr)
    rows, _ = records(spark, put("case.log", "User=1 user=2\n"), "logfmt")
    assert rows == [{"User": "1", "user_2": "2"}]


def test_many_names_over_the_corpus(spark, put):
    """Each record is small; together they have more names than one record may."""
    path = put("wide.ndjson", "".join(json.dumps({f"k{at}": at, "id": at}) + "\n" for at in range(1100)))
    rows, frame = records(spark, path, "ndjson")
    assert len(data_columns(frame)) == 1101 and not [row for row in rows if "_error" in row]


def test_accepted_suffixes():
    lines_module.check_suffixes(["/in/a.LOG", "/in/b.ndjson", "/in/folder", "/in/*.gz"])
    with pytest.raises(ValueError, match="b.exe"):
        lines_module.check_suffixes("/in/b.exe")


@pytest.mark.parametrize("fmt", ["raw", "logfmt"])
def test_first_lines_of_a_log_in_several_files(spark, put, tmp_path, fmt):
    """Files count by name, not by size, and the second one goes on where the first one ends."""
    put("log/a [1].log", "".join(f"k={at}\n" for at in range(7)))
    put("log/b.log", "")
    put("log/c {x}.log", "".join(f"k={at}\n" for at in range(7, 40)))
    for number in range(20):
        put(f"log/d{number:02d}.log", "".join(f"k={at} more=yes\n" for at in range(100 + 30 * number, 130 + 30 * number)))
    folder = str(tmp_path / "log")
    place = [*range(40), *range(100, 700)]
    sample = raw_sample(spark, folder).collect()
    assert [row["value"] for row in sample] == [f"k={at}" for at in range(10)]
    shown = preview_files(spark, folder, fmt).records.collect()
    values = [row["raw_message"].split()[0] if fmt == "raw" else f"k={row['k']}" for row in shown]
    assert values == [f"k={at}" for at in place[:100]]
    few = preview_files(spark, str(tmp_path / "log" / "b.log"), "raw").records
    assert few.count() == 0 and raw_sample(spark, folder, 1000).count() == len(place)


def test_order_log_is_sorted_in_many_tasks(spark, tmp_path):
    """The log of the previews is no single task's work, and its files follow each other."""
    rows = spark.range(4000).select((F.lit(4000) - F.col("id")).alias("o_orderkey"), F.lit("O").alias("o_orderstatus"))
    rows.repartition(5).write.parquet(str(tmp_path / "orders.parquet"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        place = _order_log(spark, str(tmp_path))
        files = sorted(spark.read.text(place).inputFiles())
        assert len(files) > 1
        assert [row["value"].split()[0] for row in raw_sample(spark, place).collect()] == [f"key={at}" for at in range(1, 11)]
        shown = preview_files(spark, place, "raw").records.collect()
        assert [row["raw_message"].split()[0] for row in shown] == [f"key={at}" for at in range(1, 101)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
