"""CSV and TSV files: delimiter and header per file, splittable quoted line breaks.

One grammar holds for any number and size of files: a quote opens a quoted part only at the start
of a cell, and closes it unless it is doubled.  Each line either keeps, flips or sets whether the
text is inside quotes; what holds before a line follows from the last line that sets it and the
flips since, found per bounded block of lines and then shifted by the blocks before.
"""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.binding import with_parsed
from logloom.functions.line_formats import spaced_cells
from logloom.functions.literals import strip
from logloom.operators.multiline import BLOCK_KEY, earlier_blocks, merge_by_flag, with_blocks
from logloom.session import broadcast_if_small, quoted
from logloom.sources.lines import as_paths, leading_lines, read_lines

DELIMITERS = (",", ";", "\t", "|")
# Fixed value: characters of a file the delimiter vote looks at.
SAMPLE_CHARS = 8192
SAMPLE_LINES = 100
# Fixed value: longest cell a CSV reader accepts, hence also the most line breaks in one.
MAX_CELL_CHARS = 131072
BYTE_ORDER_MARK = "\ufeff"


def vote_delimiter(sample: str) -> str:
    """Delimiter whose count is the same, and not zero, on most lines of the sample."""
    lines = [line for line in sample[:SAMPLE_CHARS].splitlines() if line.strip()]
    if len(sample) > SAMPLE_CHARS and len(lines) > 1:
        lines = lines[:-1]
    best, best_score = ",", (0.0, 0)
    for delimiter in DELIMITERS:
        widths = Counter(len(row) for row in csv.reader(lines, delimiter=delimiter))
        if not widths:
            continue
        width, agreeing = widths.most_common(1)[0]
        score = (agreeing / sum(widths.values()), width)
        if width > 1 and score > best_score:
            best, best_score = delimiter, score
    return best


def looks_tabular(header: Sequence[str]) -> bool:
    """False for a single over-long or wordy header, which is log text rather than a table."""
    return len(header) != 1 or (len(header[0]) <= 50 and header[0].count(" ") <= 3)


def tabular_check(first_lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """The same test for many files at once, on a table of their first lines."""
    single = F.instr("value", delimiter) == 0
    spaces = F.length("value") - F.length(F.replace("value", F.lit(" "), F.lit("")))
    wordy = single & ((F.length("value") > 50) | (spaces > 3))
    return first_lines.select("source_path", (~wordy).alias("tabular"))


def _header_names(header_line: str, delimiter: str) -> list[str]:
    return next(csv.reader([header_line], delimiter=delimiter), [])


def _select_named(names: Sequence[str], cell: dict[int, Column]) -> list[Column]:
    """Last column of each name, in first-appearance order; unnamed columns are dropped."""
    last_at = {name: at for at, name in enumerate(names)}
    return [F.nullif(cell[at], F.lit("")).alias(name) for name, at in last_at.items() if name != ""]


def _positional(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(f"c{at}", T.StringType()) for at in range(len(names))])


def _plain_read(spark: SparkSession, paths: Sequence[str], names: Sequence[str], delimiter: str) -> DataFrame:
    """Files in which every line is a record."""
    table = (
        spark.read.schema(_positional(names))
        .options(header=True, sep=delimiter, quote='"', escape='"', mode="PERMISSIVE")
        .csv(list(paths))
    )
    cells = {at: F.col(f"c{at}") for at in range(len(names))}
    return table.select(
        *_select_named(names, cells),
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_name").alias("source_file"),
    )


def file_layouts(lines: DataFrame, delimiter: str | None = None) -> DataFrame:
    """(source_path, delimiter, header) of every file, the delimiter voted on its own first lines."""
    head = leading_lines(lines.filter("split_start = 0"), SAMPLE_LINES if delimiter is None else 1)
    sampled = head.select(
        "source_path",
        "line_no",
        F.substring("value", 1, SAMPLE_CHARS).alias("text"),
        F.when(F.col("line_no") == 1, F.col("value")).alias("header"),
    )
    heads = sampled.groupBy("source_path").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("texts"), F.max("header").alias("header")
    )
    joined = F.array_join(F.transform("texts", lambda line: line["text"]), "\n")

    @F.pandas_udf("string")
    def voted(samples: pd.Series) -> pd.Series:
        return samples.map(vote_delimiter)

    chosen = F.lit(delimiter) if delimiter is not None else voted(F.ltrim(joined, F.lit(BYTE_ORDER_MARK)))
    return heads.select(
        "source_path", chosen.alias("delimiter"), F.ltrim("header", F.lit(BYTE_ORDER_MARK)).alias("header")
    )


def _line_ends(delimiter: str) -> tuple[str, str]:
    """Patterns of a line that ends outside quotes, when entered outside and inside them."""
    sep = f"\\x{ord(delimiter):02x}"
    closed = rf'[^"]*+(?:""[^"]*+)*+"[^{sep}]*+'
    cell = rf'(?:"{closed}|(?!")[^{sep}]*+)'
    more = rf"(?:{sep}{cell})*+\z"
    return rf"\A{cell}{more}", rf"\A{closed}{more}"


def _by_delimiter(delimiters: Sequence[str], build: Callable[[str], Column]) -> Column:
    """The value that each line's own file asks for."""
    value = build(delimiters[0])
    for one in delimiters[1:]:
        value = F.when(F.col("delimiter") == one, build(one)).otherwise(value)
    return value


def _ends_inside(delimiters: Sequence[str], entered_inside: bool) -> Column:
    ends = _by_delimiter(delimiters, lambda one: F.col("value").rlike(_line_ends(one)[entered_inside]))
    return F.when(F.col("value").contains('"'), ~ends).otherwise(F.lit(entered_inside))


def _inside(entered: Column, flips: Column, last_set: Column) -> Column:
    """Whether text is inside quotes: ``last_set`` is (flips until then, inside after it) or null."""
    odd = F.pmod(flips - F.coalesce(last_set["flips"], F.lit(0)), F.lit(2)) == 1
    return F.coalesce(last_set["inside"], entered) != odd


def quoted_records(lines: DataFrame, delimiters: Sequence[str]) -> DataFrame:
    """Join lines that a quoted cell runs across; ``lines`` has each file's ``delimiter``.

    No cell may be longer than ``MAX_CELL_CHARS``, so a record of more lines is an error, as for
    other CSV readers: its quote is never closed.
    """
    measured = with_blocks(lines).withColumns(
        {"to_out": _ends_inside(delimiters, False), "to_in": _ends_inside(delimiters, True)}
    )
    measured = measured.withColumn("flip", (F.col("to_out") & ~F.col("to_in")).cast("int"))
    in_block = Window.partitionBy(*BLOCK_KEY).orderBy("line_id")
    until = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    local = measured.withColumn("flips", F.sum("flip").over(until))
    setting = F.struct(F.col("flips").alias("flips"), F.col("to_out").alias("inside"))
    local = local.withColumn("setting", F.when(F.col("to_out") == F.col("to_in"), setting))
    blocks = local.groupBy(*BLOCK_KEY).agg(
        F.sum("flip").alias("flips"),
        F.max_by("setting", F.when(F.col("setting").isNotNull(), F.col("line_id"))).alias("set"),
    )
    # a block with a setting line ends in a known state; any other flips it as often as its lines do
    earlier = earlier_blocks()
    flips_until = F.coalesce(F.sum("flips").over(earlier), F.lit(0)) + F.col("flips")
    known = F.struct(flips_until.alias("flips"), _inside(F.lit(False), F.col("flips"), F.col("set")).alias("inside"))
    ended = blocks.withColumn("ends", F.when(F.col("set").isNotNull(), known))
    flips_before = F.coalesce(F.sum("flips").over(earlier), F.lit(0))
    entered = ended.withColumn(
        "entered", _inside(F.lit(False), flips_before, F.last("ends", ignorenulls=True).over(earlier))
    ).select(*BLOCK_KEY, "entered")
    placed = local.withColumns(
        {
            "flips_before": F.coalesce(F.sum("flip").over(before), F.lit(0)),
            "last_set": F.last("setting", ignorenulls=True).over(before),
        }
    ).join(entered, BLOCK_KEY)
    starts = placed.withColumn("starts", ~_inside(F.col("entered"), F.col("flips_before"), F.col("last_set")))
    records = merge_by_flag(
        starts.select("source_path", "source_file", "split_start", "line_id", "value", "starts"),
        F.col("starts"),
        MAX_CELL_CHARS,
    )
    too_long = F.raise_error(F.concat(F.lit("a quote is never closed in "), "source_path"))
    return records.withColumn("value", F.when(F.col("n_lines") <= MAX_CELL_CHARS, F.col("value")).otherwise(too_long))


def parse_records(records: DataFrame, names: Sequence[str], delimiter: str) -> DataFrame:
    """Parse one-record-per-row text whose ``line_id`` 0 is the file's header."""
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    body = records.filter((F.col("line_id") > 0) & (strip(F.col("value")) != ""))
    parsed = body.withColumn("_row", F.from_csv("value", _positional(names).simpleString(), options))
    cells = {at: F.col("_row")[f"c{at}"] for at in range(len(names))}
    return parsed.select(*_select_named(names, cells), "source_path", "source_file")


def _parse_mixed(records: DataFrame, layouts: Sequence[tuple[str, str]], delimiters: Sequence[str]) -> DataFrame:
    """The same where files differ in ``delimiter`` or ``header``: cells are picked by their file's header."""
    body = records.filter((F.col("line_id") > 0) & (strip(F.col("value")) != ""))
    names = {layout: _header_names(layout[1], layout[0]) for layout in layouts}
    widest = max(names.values(), key=len)

    def cells_of(delimiter: str) -> Column:
        options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
        return F.from_csv("value", _positional(widest).simpleString(), options)

    parsed = with_parsed(body, "_row", _by_delimiter(delimiters, cells_of))
    columns: dict[str, Column] = {}
    for (delimiter, header), own in names.items():
        mine = (F.col("delimiter") == delimiter) & (F.col("header") == header)
        for name, at in {name: at for at, name in enumerate(own) if name}.items():
            cell = F.when(mine, F.nullif(F.col("_row")[f"c{at}"], F.lit("")))
            columns[name] = F.coalesce(columns[name], cell) if name in columns else cell
    return parsed.select(*[value.alias(name) for name, value in columns.items()], "source_path", "source_file")


def read_delimited(
    spark: SparkSession,
    paths: str | Sequence[str],
    delimiter: str | None = None,
    check_tabular: bool = False,
) -> DataFrame:
    """All cells as text; short rows end in nulls, surplus cells are dropped, '' is null.

    Every file has its own header and, unless given, its own delimiter.  Differently laid out
    files are united by name, not by position.  Files stay splittable whatever their size.
    """
    paths = as_paths(paths)
    lines = read_lines(spark, paths)
    table = _tabular(spark, paths, lines, broadcast_if_small(file_layouts(lines, delimiter)), check_tabular)
    if table is None:
        raise ValueError("no data to read")
    return table


def _tabular(
    spark: SparkSession, paths: Sequence[str] | None, lines: DataFrame, by_file: DataFrame, check_tabular: bool
) -> DataFrame | None:
    """The table of all files in ``by_file``; ``paths`` are the files of ``lines``, None if these are a part."""
    layouts = [tuple(row) for row in by_file.select("delimiter", "header").distinct().collect()]
    layouts.sort(key=lambda layout: (layout[1], layout[0]))
    if not layouts:
        return None
    headers = [_header_names(header, one) for one, header in layouts]
    if check_tabular and not all(looks_tabular(names) for names in headers):
        raise ValueError("single wordy column: not a table, try the raw or logfmt format")
    delimiters = sorted({one for one, _ in layouts})
    single = len(layouts) == 1
    placed = lines.withColumn("delimiter", F.lit(delimiters[0])) if single else lines.join(by_file, "source_path")
    if placed.filter(_ends_inside(delimiters, False)).isEmpty():
        if single and paths is not None:
            return _plain_read(spark, paths, headers[0], delimiters[0])
        return _parse_mixed(_without_first(lines).join(by_file, "source_path"), layouts, delimiters)
    records = quoted_records(placed, delimiters)
    if single:
        return parse_records(records, headers[0], delimiters[0])
    return _parse_mixed(records.join(by_file, "source_path"), layouts, delimiters)


def _without_first(lines: DataFrame) -> DataFrame:
    """Lines with every file's first one marked by ``line_id`` 0 and all others above it."""
    firsts = lines.filter("split_start = 0").groupBy("source_path").agg(F.min("line_id").alias("first_id"))
    marked = lines.join(broadcast_if_small(firsts), "source_path")
    is_first = (F.col("split_start") == 0) & (F.col("line_id") == F.col("first_id"))
    return marked.withColumn("line_id", F.when(is_first, 0).otherwise(F.col("line_id") + 1)).drop("first_id")


def spaced_records(lines: DataFrame) -> DataFrame:
    """Rows of blank-separated tables as maps: each file's first line is its header.

    Short rows are filled with '', surplus cells are cut, blank lines dropped.
    """
    headers = broadcast_if_small(
        leading_lines(lines.filter("split_start = 0"), 1).select(
            "source_path", F.col("line_id").alias("header_id"), spaced_cells(F.col("value")).alias("header")
        )
    )
    joined = lines.join(headers, "source_path").filter(
        ((F.col("split_start") > 0) | (F.col("line_id") > F.col("header_id"))) & (strip(F.col("value")) != "")
    )
    cells = joined.withColumn("cells", spaced_cells(F.col("value")))
    values = F.transform(F.col("header"), lambda _, at: F.coalesce(F.get("cells", at), F.lit("")))
    return cells.select(
        *[quoted(name) for name in lines.columns if name != "value"],
        F.map_from_arrays("header", values).alias("record"),
    )


def read_tsv(
    spark: SparkSession, paths: str | Sequence[str], check_tabular: bool = False
) -> tuple[DataFrame | None, DataFrame | None]:
    """The table of the files with a tab in their first line, and the lines of the blank-separated others.

    Each is None if there are no such files; no files at all are blank-separated ones.
    """
    paths = as_paths(paths)
    lines = read_lines(spark, paths)
    by_file = file_layouts(lines, "\t").withColumn("tabs", F.instr("header", "\t") > 0)
    kinds = {row["tabs"] for row in by_file.select("tabs").distinct().collect()}
    if kinds == {True}:
        return read_delimited(spark, paths, "\t", check_tabular), None
    if check_tabular:
        headers = [row["header"] for row in by_file.filter("not tabs").select("header").distinct().collect()]
        if not all(looks_tabular([c for c in header.strip().split("  ") if c]) for header in headers if header):
            raise ValueError("single wordy column: not a table, try the raw or logfmt format")
    if True not in kinds:
        return None, lines
    marked = broadcast_if_small(by_file.select("source_path", "tabs"))
    tabbed, spaced = (lines.join(marked.filter(kind), "source_path", "left_semi") for kind in ("tabs", "not tabs"))
    layouts = broadcast_if_small(by_file.filter("tabs").drop("tabs"))
    return _tabular(spark, None, tabbed, layouts, check_tabular), spaced
