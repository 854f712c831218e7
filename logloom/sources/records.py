"""Record sources: one entry point over all formats, for files and for lines tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.binding import bind, with_parsed
from logloom.functions.line_formats import SYSLOG_5424_FIELDS, logfmt_pairs, ltsv_pairs, pair_value, pairs_to_map, syslog_record
from logloom.functions.literals import strip
from logloom.functions.regexes import CompiledPattern
from logloom.operators.multiline import merge_lines
from logloom.operators.patterns import RAW_FIELD, extract_fields
from logloom.operators.profiling import (
    MAX_COLUMNS,
    MAX_FIELDS,
    OTHER_FIELDS,
    collect_fields,
    field_profile,
    map_entries,
    split_overflow,
    too_many_fields,
)
from logloom.session import quoted
from logloom.sources.delimited import read_delimited, read_tsv, spaced_records
from logloom.sources.json_arrays import read_array_elements
from logloom.sources.lines import PROVENANCE, as_paths, read_lines

# Format names.
FORMATS = ("json_array", "ndjson", "csv", "tsv", "ltsv", "syslog", "logfmt", "raw", "custom")
MULTILINE_FORMATS = ("raw", "logfmt", "custom")
LINE_FORMATS = ("ndjson", "ltsv", "syslog", "logfmt", "raw", "custom")

ERROR = "_error"
SOURCE = "_source_file"

Field = tuple[str, str, str]


def _provenance(lines: DataFrame) -> list[Column]:
    return [F.col(name) for name in PROVENANCE if name in lines.columns]


def column_names(fields: Sequence[str]) -> list[str]:
    """Names of the fields' columns. Column names don't tell case apart, so of fields that differ
    only in case the second one's column ends in ``_2``, and so on."""
    taken: dict[str, int] = {}
    names = []
    for name in fields:
        chosen = name
        while chosen.lower() in taken:
            taken[name.lower()] += 1
            chosen = f"{name}_{taken[name.lower()]}"
        taken[chosen.lower()] = 1
        names.append(chosen)
    return names


def other_fields(record: Column, fields: Sequence[str]) -> Column:
    """Variant object of a map's entries that have no column of their own, null when there are none.

    Of a name that a record repeats the last value counts.
    """
    others = F.map_filter(record, lambda name, _: ~name.isin(*fields) & (name != ""))

    def last_of_each(found: Column) -> Column:
        names = F.map_keys(found)
        from_end = F.reverse(names)
        last = F.filter(
            F.map_entries(found), lambda entry, at: F.array_position(from_end, entry["key"]) == F.size(names) - at
        )
        unique = F.when(F.size(F.array_distinct(names)) == F.size(names), found).otherwise(F.map_from_entries(last))
        return F.when(F.size(found) > 0, F.to_variant_object(unique))

    return bind(others, last_of_each)


def filled_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(strip(F.col("value")) != "")


# ---------------------------------------------------------------- key/value formats


_PAIR_PARSERS = {"ltsv": ltsv_pairs, "logfmt": logfmt_pairs}


def key_value_records(lines: DataFrame, fmt: str, keep_unparsed: bool = False) -> DataFrame:
    """Lines to a ``record`` map. Lines without any pair are dropped, or kept whole as raw text."""
    record = pairs_to_map(F.col("_pairs"))
    if keep_unparsed:
        record = F.coalesce(record, F.create_map(F.lit(RAW_FIELD), F.col("value")))
    parsed = with_parsed(lines, "_pairs", _PAIR_PARSERS[fmt](F.col("value")))
    if not keep_unparsed:
        parsed = parsed.filter(F.col("_pairs").isNotNull())
    return parsed.select(*_provenance(lines), record.alias("record"))


def key_value_columns(
    lines: DataFrame, fmt: str, fields: Sequence[str], keep_unparsed: bool = False, overflow: bool = False
) -> DataFrame:
    """The same records with known fields, straight to columns; ``overflow`` adds all others as one."""
    parsed = with_parsed(lines, "_pairs", _PAIR_PARSERS[fmt](F.col("value")))
    names = column_names([*fields, OTHER_FIELDS])
    columns = {named: pair_value(F.col("_pairs"), name) for name, named in zip(fields, names)}
    if overflow:
        columns[names[-1]] = other_fields(pairs_to_map(F.col("_pairs")), fields)
    if not keep_unparsed:
        parsed = parsed.filter(F.col("_pairs").isNotNull())
    elif RAW_FIELD in columns:
        columns[RAW_FIELD] = F.when(F.col("_pairs").isNull(), F.col("value")).otherwise(columns[RAW_FIELD])
    return parsed.select(*_provenance(lines), *[value.alias(name) for name, value in columns.items()])


def json_records(lines: DataFrame) -> DataFrame:
    """JSON object texts to a ``record`` map of variants, for profiling; bad texts are left out."""
    record = F.from_json(strip(F.col("value")), "map<string,variant>")
    objects = filled_lines(lines).filter(strip(F.col("value")).startswith("{"))
    parsed = with_parsed(objects, "record", record)
    return parsed.filter(F.col("record").isNotNull()).select(*_provenance(lines), "record")


def flatten_map(
    records: DataFrame, fields: Sequence[str], record: str = "record", overflow: bool = False
) -> DataFrame:
    kept = [quoted(name) for name in records.columns if name != record and name not in fields]
    names = column_names([*fields, OTHER_FIELDS])
    values = [F.try_element_at(record, F.lit(name)).alias(named) for name, named in zip(fields, names)]
    if overflow:
        values.append(other_fields(F.col(record), fields).alias(names[-1]))
    return records.select(*kept, *values)


# ---------------------------------------------------------------- JSON objects to columns

_VARIANT_TYPES = {"boolean": "boolean", "bigint": "bigint", "double": "double", "string": "string"}


def json_columns(lines: DataFrame, fields: Sequence[Field], max_fields: int = MAX_FIELDS) -> DataFrame:
    """JSON object texts to typed columns plus an error column.

    Values are read as variants first, so a value that does not fit its column is reported
    as an error of that record instead of spoiling its neighbours.  Fields beyond the columns
    (see ``collect_fields``) are read once more into one variant.
    """
    fields, overflow = split_overflow(fields)
    names = [name for name, _, _ in fields]
    text = strip(F.col("value"))
    schema = ", ".join(f"`{name.replace('`', '``')}` VARIANT" for name in [*names, "_bad"]).replace(
        "`_bad` VARIANT", "`_bad` STRING"
    )
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    objects = filled_lines(lines).withColumn("_is_object", text.startswith("{"))
    row = F.from_json(F.when(F.col("_is_object"), text), schema, options)
    # by position, as names that differ only in case can't be told apart in a struct
    placed = ", ".join([*[f"c{at}: variant" for at in range(len(names))], "bad: string"])
    parsed = with_parsed(objects, "_row", row.cast(f"struct<{placed}>"))
    columns, misfits = [], []
    for at, ((name, _, storage), named) in enumerate(zip(fields, column_names(names))):
        value = F.col("_row")[f"c{at}"]
        if storage in _VARIANT_TYPES:
            cast = F.try_variant_get(value, "$", _VARIANT_TYPES[storage])
            if storage != "string":
                given = value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(True))
                misfits.append(
                    F.when(given & cast.isNull(), F.lit(f"field {name}: value does not fit type {storage}"))
                )
            columns.append(cast.alias(named))
        else:
            columns.append(value.alias(named))
    if overflow:
        whole = F.from_json(F.when(F.col("_is_object"), text), "map<string,variant>")
        columns.append(other_fields(whole, names).alias(column_names([*names, OTHER_FIELDS])[-1]))
    error = F.coalesce(
        F.when(~F.col("_is_object"), "record is not an object"),
        F.when(F.col("_row")["bad"].isNotNull(), "malformed JSON"),
        *([F.when(too_many_fields(text, max_fields), f"more than {max_fields} fields")] if max_fields > 0 else []),
        *misfits,
        F.lit(None).cast("string"),
    )
    kept = [c for c in _provenance(lines)]
    return parsed.select(*kept, *columns, error.alias(ERROR), F.when(error.isNotNull(), text).alias("_record"))


# ---------------------------------------------------------------- dispatch


def parse_lines(
    lines: DataFrame,
    fmt: str,
    pattern: CompiledPattern | None = None,
    fields: Sequence[Field] | None = None,
    multiline_start: str | CompiledPattern | None = None,
    multiline_max_lines: int = 100,
    max_fields: int = MAX_FIELDS,
    keep_unparsed: bool = False,
    sample: int | None = None,
    max_columns: int = MAX_COLUMNS,
) -> DataFrame:
    """Records of a lines table: provenance columns, then one column per field.

    ``fields`` saves the pass that finds the keys of key/value and JSON records; ``sample``
    limits that pass to the first records found.  Merged lines without any pair are kept
    whole, as are others with ``keep_unparsed``.  With more than ``max_columns`` different names
    the rarer ones share the column ``_other_fields``.
    """
    if fmt not in LINE_FORMATS and fmt != "tsv":
        raise ValueError(f"not a line format: {fmt}")
    if fmt == "custom" and pattern is None:
        raise ValueError("the custom format needs a pattern")
    merged = bool(multiline_start) and fmt in MULTILINE_FORMATS
    if merged:
        lines = merge_lines(lines, multiline_start, multiline_max_lines).drop("n_lines")
    if fmt == "raw":
        return lines.select(*_provenance(lines), F.col("value").alias(RAW_FIELD))
    if fmt == "syslog":
        parsed = with_parsed(filled_lines(lines), "_r", syslog_record(F.col("value")))
        return parsed.select(*_provenance(lines), *[F.col("_r")[name].alias(name) for name in SYSLOG_5424_FIELDS])
    if fmt == "custom":
        kept = lines if merged else lines.filter("value != ''")
        return extract_fields(kept, pattern).drop("value")
    if fmt == "ndjson":
        if fields is None:
            fields = collect_fields(field_profile(map_entries(json_records(lines))), max_fields, max_columns)
        return json_columns(lines, fields, max_fields)
    if fmt == "tsv":
        records = spaced_records(lines)
        if fields is None:
            fields = collect_fields(field_profile(map_entries(records)), max_fields, max_columns)
        named, overflow = split_overflow(fields)
        return flatten_map(records, [name for name, _, _ in named], overflow=overflow)
    whole = merged or keep_unparsed
    if fields is None:
        records = key_value_records(lines, fmt, keep_unparsed=whole)
        records = records.limit(sample) if sample else records
        fields = collect_fields(field_profile(map_entries(records)), max_fields, max_columns)
    named, overflow = split_overflow(fields)
    return key_value_columns(lines, fmt, [name for name, _, _ in named], keep_unparsed=whole, overflow=overflow)


def read_logs(
    spark: SparkSession,
    paths: str | Sequence[str],
    fmt: str,
    pattern: CompiledPattern | None = None,
    fields: Sequence[Field] | None = None,
    multiline_start: str | None = None,
    multiline_max_lines: int = 100,
    delimiter: str | None = None,
    max_fields: int = MAX_FIELDS,
    check_tabular: bool = False,
    unique_names: bool = True,
    max_columns: int = MAX_COLUMNS,
) -> DataFrame:
    """Records of one or many files of a common format; ``_source_file`` holds the base name."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    paths = as_paths(paths)
    if unique_names:
        _reject_repeated_names(paths)
    if fmt == "csv":
        return tidy(read_delimited(spark, paths, delimiter, check_tabular))
    if fmt == "tsv":
        table, lines = read_tsv(spark, paths, check_tabular)
        if lines is None:
            return tidy(table)
        parsed = parse_lines(
            lines, fmt, pattern, fields, multiline_start, multiline_max_lines, max_fields, max_columns=max_columns
        )
        records = tidy(parsed)
        return records if table is None else _united(tidy(table), records)
    if fmt == "json_array":
        lines, line_format = read_array_elements(spark, paths), "ndjson"
    else:
        lines, line_format = read_lines(spark, paths), fmt
    records = parse_lines(
        lines,
        line_format,
        pattern,
        fields,
        multiline_start,
        multiline_max_lines,
        max_fields,
        max_columns=max_columns,
    )
    return tidy(records)


def _reject_repeated_names(paths: Sequence[str]) -> None:
    names = [path.rstrip("/").rsplit("/", 1)[-1] for path in paths]
    repeated = sorted({name for name in names if names.count(name) > 1 and not any(c in name for c in "*?[{")})
    if repeated:
        raise ValueError(f"repeated file names: {', '.join(repeated)}")


def _united(tables: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of both by name, data columns first; text where a column's types differ."""
    types = dict(tables.dtypes)
    alike = [
        quoted(name).cast("string").alias(name) if types.get(name, kind) != kind else quoted(name)
        for name, kind in records.dtypes
    ]
    both = tables.unionByName(records.select(*alike), allowMissingColumns=True)
    last = [name for name in (SOURCE, ERROR, "_record") if name in both.columns]
    return both.select(*[quoted(name) for name in both.columns if name not in last], *[F.col(name) for name in last])


def tidy(records: DataFrame) -> DataFrame:
    hidden = set(PROVENANCE)
    internal = (ERROR, "_record")
    data = [name for name in records.columns if name not in hidden and name not in internal]
    extra = [name for name in internal if name in records.columns]
    return records.select(
        *[quoted(name) for name in data], F.col("source_file").alias(SOURCE), *[F.col(name) for name in extra]
    )


def data_columns(records: DataFrame) -> list[str]:
    return [name for name in records.columns if name not in (SOURCE, ERROR, "_record")]
