"""Profiles of a corpus: formats of files, fields and types of records, field counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.binding import bind
from logloom.functions.line_formats import LOGFMT_PAIR, WIDE_GAP
from logloom.functions.literals import strip, text_type
from logloom.session import quoted
from logloom.sources.lines import head_pool, leading_lines

# Fixed values of the format test.
LOGFMT_TEST_LINES = 20
LIKENESS = 0.7
MAX_FIELDS = 1000
# Columns that all records of a corpus have together; fields beyond share one column, and each
# record keeps to MAX_FIELDS.
MAX_COLUMNS = 2_000
# Name, and mark in a list of fields, of the variant column that holds the fields beyond.
OTHER_FIELDS, OVERFLOW = "_other_fields", "overflow"

# Hints that a column holds times.
TIME_WORDS = ("time", "date", "created", "updated", "timestamp", "at", "when", "ts")
TIME_TEXTS = (r"^\d{4}-\d{2}-\d{2}", r"^\d{2}/\w{3}/\d{4}", r"^\d{10,13}$", r"T\d{2}:\d{2}")


# ---------------------------------------------------------------- formats of files


def _ltsv_like(line: Column) -> Column:
    cells = F.when(line.contains("\t"), F.split(line, "\t", -1)).otherwise(F.split(line, WIDE_GAP, -1))
    labelled = F.size(F.filter(cells, lambda cell: cell.rlike(r"(?U)^[\p{L}\p{N}_]+:")))
    return (F.size(cells) >= 2) & (labelled >= F.size(cells) * LIKENESS)


def _first_line_format(line: Column) -> Column:
    """Format told by the very first line of a log file, null when it tells nothing."""
    text = strip(line)
    return (
        F.when(text.startswith("{"), "ndjson")
        .when(text.startswith("["), "json_array")
        .when(text.startswith("<") & F.substring(text, 1, 5).contains(">"), "syslog")
        .when(_ltsv_like(text), "ltsv")
    )


def detect_formats(lines: DataFrame) -> DataFrame:
    """(source_path, source_file, format) of every file, from its name and leading lines.

    The likeness test looks at 20 filled lines; a 21st only counts in the denominator.
    Blank leading lines do not use up that budget, so they are dropped before ranking and
    the very first line is kept apart.
    """
    very_first = leading_lines(lines.filter("split_start = 0"), 1).select("source_path", F.col("value").alias("top"))
    filled = lines.select(
        "source_path", "source_file", "split_start", "line_id", strip(F.col("value")).alias("value")
    ).filter("value != ''")
    ranked = leading_lines(head_pool(filled, LOGFMT_TEST_LINES + 1), LOGFMT_TEST_LINES + 1)
    pairs = F.regexp_count("value", F.lit(r"(?U)\b" + LOGFMT_PAIR))
    tested = ranked.groupBy("source_path", "source_file").agg(
        F.count(F.lit(1)).alias("tested"),
        F.count_if((F.col("line_no") <= LOGFMT_TEST_LINES) & (pairs >= 2)).alias("alike"),
        F.max(F.when(F.col("line_no") == 1, F.substring("value", 1, 1))).alias("first_char"),
    )
    files = lines.select("source_path", "source_file").distinct()
    facts = files.join(very_first, "source_path", "left").join(tested, ["source_path", "source_file"], "left")
    logfmt = F.coalesce(F.col("alike") / F.col("tested") >= LIKENESS, F.lit(False))
    by_content = (
        F.when(F.col("first_char") == "[", "json_array")
        .when(F.col("first_char") == "{", "ndjson")
        .when(logfmt, "logfmt")
        .otherwise("csv")
    )
    by_first_line = F.coalesce(
        _first_line_format(F.coalesce("top", F.lit(""))), F.when(logfmt, "logfmt"), F.lit("csv")
    )
    suffix = F.lower(F.regexp_extract("source_file", r"(\.[^.]+)$", 1))
    detected = (
        F.when(suffix == ".tsv", "tsv")
        .when(suffix == ".ltsv", "ltsv")
        .when(suffix == ".log", by_first_line)
        .otherwise(by_content)
    )
    return facts.select("source_path", "source_file", detected.alias("format"))


def format_agreement(formats: DataFrame) -> DataFrame:
    """One row: files, distinct formats, whether all agree and the common format."""
    return formats.agg(
        F.count(F.lit(1)).alias("files"),
        F.count_distinct("format").alias("formats"),
        F.min("format").alias("_low"),
        F.max("format").alias("_high"),
    ).select(
        "files",
        "formats",
        (F.col("formats") == 1).alias("uniform"),
        F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias("format"),
    )


# ---------------------------------------------------------------- preview


def preview(records: DataFrame, limit: int = 100) -> DataFrame:
    """First records of a single source; stops reading once it has them."""
    return records.limit(limit)


def preview_per_file(records: DataFrame, per_file: int = 5, total: int = 100) -> DataFrame:
    """First records of each file (needs the provenance columns), cut at ``total``."""
    ranked = leading_lines(head_pool(records, per_file), per_file)
    return ranked.orderBy("source_path", "line_no").limit(total).drop("line_no")


# ---------------------------------------------------------------- fields and types


def _variant_kind(value: Column) -> Column:
    shape = F.schema_of_variant(value)
    return (
        F.when(shape == "BOOLEAN", "boolean")
        .when(shape == "BIGINT", "integer")
        .when(shape.rlike(r"^DECIMAL\([0-9]+,0\)$"), "integer")
        .when(shape.startswith("DECIMAL") | (shape == "DOUBLE") | (shape == "FLOAT"), "float")
        .when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape == "STRING", _text_kind(F.try_variant_get(value, "$", "string")))
    )


def _text_kind(text: Column) -> Column:
    return F.when(text != "", F.concat(F.lit("text:"), text_type(text)))


def _typed_kind(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.BooleanType):
        return F.when(value.isNotNull(), "boolean")
    if isinstance(data_type, T.IntegralType):
        return F.when(value.isNotNull(), "integer")
    if isinstance(data_type, T.NumericType):
        return F.when(value.isNotNull(), "float")
    if isinstance(data_type, (T.StructType, T.MapType)):
        return F.when(value.isNotNull(), "object")
    if isinstance(data_type, T.ArrayType):
        return F.when(value.isNotNull(), "array")
    if isinstance(data_type, T.VariantType):
        return _variant_kind(value)
    return _text_kind(value.cast("string"))


def map_entries(records: DataFrame, record: str = "record", row_at: str = "line_id") -> DataFrame:
    """(row_at, pos, name, kind) of every key of a map column."""
    data_type = records.schema[record].dataType
    kind = _variant_kind if isinstance(data_type.valueType, T.VariantType) else _text_kind
    entries = records.select(F.col(row_at).alias("row_at"), F.posexplode(record).alias("pos", "name", "_value"))
    return entries.filter(F.col("name") != "").select("row_at", "pos", "name", kind(F.col("_value")).alias("kind"))


def column_entries(records: DataFrame, row_at: Column | None = None) -> DataFrame:
    """(row_at, pos, name, kind) of every column of a flat table."""
    at = F.lit(0).cast("bigint") if row_at is None else row_at
    items = [
        F.struct(
            F.lit(pos).alias("pos"),
            F.lit(field.name).alias("name"),
            _typed_kind(quoted(field.name), field.dataType).alias("kind"),
        )
        for pos, field in enumerate(records.schema.fields)
    ]
    return records.select(at.alias("row_at"), F.inline(F.array(*items)))


def field_profile(entries: DataFrame) -> DataFrame:
    """(name, type, storage, filled) per field, in order of first appearance.

    One hash aggregation with fixed-width buffers over (name): it is pre-aggregated before
    the shuffle, which then carries only a row per field and task.
    """

    def seen(*kinds: str) -> Column:
        return F.count_if(F.col("kind").isin(*kinds))

    counts = entries.groupBy("name").agg(
        F.min("row_at").alias("first_row"),
        F.min_by("pos", "row_at").alias("first_pos"),
        F.count("kind").alias("filled"),
        seen("boolean").alias("n_boolean"),
        seen("integer").alias("n_integer"),
        seen("float").alias("n_float"),
        seen("object").alias("n_object"),
        seen("array").alias("n_array"),
        seen("text:integer").alias("t_integer"),
        seen("text:float").alias("t_float"),
        seen("text:string").alias("t_string"),
    )
    whole, broken = F.col("n_integer") + F.col("t_integer"), F.col("n_float") + F.col("t_float")
    inferred = (
        F.when(F.col("filled") == 0, "string")
        .when(F.col("n_boolean") == F.col("filled"), "boolean")
        .when(whole == F.col("filled"), "integer")
        .when(whole + broken == F.col("filled"), "float")
        .when(F.col("n_object") == F.col("filled"), "object")
        .when(F.col("n_array") == F.col("filled"), "array")
        .otherwise("string")
    )
    # how the values are held, before any coercion: text that looks like a number stays text
    storage = (
        F.when(F.col("filled") == 0, "string")
        .when(F.col("n_boolean") == F.col("filled"), "boolean")
        .when(F.col("n_integer") == F.col("filled"), "bigint")
        .when(F.col("n_integer") + F.col("n_float") == F.col("filled"), "double")
        .when(F.col("n_object") + F.col("n_array") == F.col("filled"), "variant")
        .otherwise("string")
    )
    return counts.select(
        "name", inferred.alias("type"), storage.alias("storage"), "filled", "first_row", "first_pos"
    ).orderBy("first_row", "first_pos", "name")


def collect_fields(
    profile: DataFrame, max_fields: int = MAX_FIELDS, max_columns: int = MAX_COLUMNS
) -> list[tuple[str, str, str]]:
    """(name, type, storage) on the driver, where they become columns, in order of appearance.

    With more than ``max_columns`` names (or ``max_fields``, if that is more) the ones filled most
    often become columns, earlier ones first among equals, and a last entry with the storage
    ``overflow`` asks the readers for one variant column with all other fields.  The profile counts
    every name exactly before it is ranked, so the choice does not depend on how the data are split.
    """
    bound = max(max_fields, max_columns)
    order = ("first_row", "first_pos", "name")
    rows = profile.orderBy(F.desc("filled"), *order).limit(bound + 1).collect()
    chosen = sorted(rows[:bound], key=lambda row: tuple(row[name] for name in order))
    fields = [(row["name"], row["type"], row["storage"]) for row in chosen]
    return fields + [(OTHER_FIELDS, "object", OVERFLOW)] if len(rows) > bound else fields


def split_overflow(fields: Sequence[tuple[str, str, str]]) -> tuple[list[tuple[str, str, str]], bool]:
    """The fields that are columns, and whether the others share one column."""
    named = [entry for entry in fields if entry[2] != OVERFLOW]
    return named, len(named) < len(fields)


# ---------------------------------------------------------------- field counts


def json_field_count(text: Column) -> Column:
    """Leaf fields of JSON object text: nested objects count their leaves, an array counts 1.

    With strings taken out and arrays skipped, every colon is a field and every brace but the
    outermost belongs to a field that is not a leaf.
    """
    marks = F.regexp_replace(F.regexp_replace(text, r'(?s)"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{:]", "")

    def outside_arrays(structure: Column) -> Column:
        def step(state: Column, mark: Column) -> Column:
            depth = state["depth"] + F.when(mark == "[", 1).when(mark == "]", -1).otherwise(0)
            counted = F.when(state["depth"] > 0, 0).when(mark == ":", 1).when(mark == "{", -1).otherwise(0)
            return F.struct(depth.alias("depth"), (state["n"] + counted).alias("n"))

        start = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("n"))
        walked = F.aggregate(F.split(structure, "(?!^)"), start, step, lambda state: state["n"])
        fields = F.length(F.replace(structure, F.lit("{"), F.lit("")))
        plain = 1 + fields - (F.length(structure) - fields)
        return F.when(structure.contains("["), walked).otherwise(plain)

    return F.when(text.startswith("{"), bind(marks, outside_arrays))


def too_many_fields(text: Column, limit: int) -> Column:
    """True beyond the limit. Every field needs a colon, so most texts are cleared by counting those."""
    colons = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))
    return F.when(colons > limit, json_field_count(text) > limit).otherwise(False)


def struct_field_count(schema: T.StructType, parent: Column | None = None) -> Column:
    """Leaf fields present in a typed row."""
    total = F.lit(0)
    for field in schema.fields:
        value = quoted(field.name) if parent is None else parent[field.name]
        if isinstance(field.dataType, T.StructType):
            total = total + F.when(value.isNotNull(), struct_field_count(field.dataType, value)).otherwise(0)
        else:
            total = total + F.when(value.isNotNull(), 1).otherwise(0)
    return total


def field_count_summary(counts: DataFrame, max_fields: int = MAX_FIELDS, count: str = "n_fields") -> DataFrame:
    """Largest count, offending rows and whether the limit holds; a limit of 0 switches it off."""
    over = F.count_if(F.col(count) > max_fields) if max_fields > 0 else F.lit(0).cast("bigint")
    summary = counts.agg(F.max(count).alias("max_found"), over.alias("offenders"))
    return summary.withColumn("valid", F.col("offenders") == 0)


# ---------------------------------------------------------------- time-like columns


def _time_like_value(value: Column, data_type: T.DataType) -> Column:
    text = value.cast("string") if not isinstance(data_type, T.VariantType) else F.to_json(value)
    hit = F.lit(False)
    for pattern in TIME_TEXTS:
        hit = hit | text.rlike(pattern)
    if isinstance(data_type, T.NumericType):
        hit = hit | (value > 1_000_000_000)
    return F.coalesce(hit, F.lit(False))


def timestamp_candidates(records: DataFrame) -> DataFrame:
    """(name, by_name, by_value, candidate): columns that look like times by name or any value."""
    fields = records.schema.fields
    flags = records.agg(
        *[F.coalesce(F.bool_or(_time_like_value(quoted(f.name), f.dataType)), F.lit(False)).alias(f"f{at}")
          for at, f in enumerate(fields)]
    )
    rows = [
        F.struct(
            F.lit(f.name).alias("name"),
            F.lit(any(word in f.name.lower() for word in TIME_WORDS)).alias("by_name"),
            F.col(f"f{at}").alias("by_value"),
        )
        for at, f in enumerate(fields)
    ]
    return flags.select(F.inline(F.array(*rows))).withColumn("candidate", F.col("by_name") | F.col("by_value"))


def record_count(records: DataFrame) -> int:
    return records.count()
