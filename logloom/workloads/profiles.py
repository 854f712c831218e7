"""Profiles of corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import profiling as P
from logloom.sources.delimited import tabular_check
from logloom.sources.lines import leading_lines, lines_from_column
from logloom.sources.records import json_columns, json_records, parse_lines
from logloom.workloads import spread_table, table, workload
from logloom.workloads.formats import EVENT_FIELDS, as_lines, event_json_lines


@workload(
    "json_field_types",
    """
    SELECT 'p_partkey' AS name, 'integer' AS type, 'bigint' AS storage, count(p_partkey) AS filled FROM part
    UNION ALL SELECT 'p_name', 'string', 'string', count(p_name) FROM part
    UNION ALL SELECT 'p_size', 'integer', 'string', count(p_size) FROM part
    UNION ALL SELECT 'p_retailprice', 'float', 'double', count(p_retailprice) FROM part
    UNION ALL SELECT 'large', 'boolean', 'boolean', count(*) FROM part
    UNION ALL SELECT 'mixed', 'string', 'string', count(*) FROM part
    UNION ALL SELECT 'brand', 'object', 'variant', count(*) FROM part
    UNION ALL SELECT 'tags', 'array', 'variant', count(*) FROM part
    UNION ALL SELECT 'nothing', 'string', 'string', 0 FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part)
    UNION ALL SELECT 'odd', 'integer', 'bigint', count(*) FROM part WHERE p_partkey % 2 = 1
    """,
)
def json_field_types(spark: SparkSession, folder: str) -> DataFrame:
    """Fields, types and storage of JSON records over the whole table, late keys included."""
    part = table(spark, folder, "part")
    body = F.struct(
        "p_partkey",
        "p_name",
        F.concat(F.lit(" "), F.col("p_size").cast("string")).alias("p_size"),
        (F.col("p_retailprice") + 0.5).alias("p_retailprice"),
        (F.col("p_size") > 25).alias("large"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise("x").alias("mixed"),
        F.struct(F.col("p_brand").alias("name")).alias("brand"),
        F.array("p_type").alias("tags"),
        F.lit("").alias("nothing"),
        F.when(F.col("p_partkey") % 2 == 1, F.col("p_partkey")).alias("odd"),
    )
    records = json_records(as_lines(part, F.to_json(body), "p_partkey"))
    return P.field_profile(P.map_entries(records)).select("name", "type", "storage", "filled")


@workload(
    "column_types",
    """
    SELECT 'c_custkey' AS name, 'integer' AS type, count(c_custkey) AS filled FROM customer
    UNION ALL SELECT 'c_name', 'string', count(c_name) FROM customer
    UNION ALL SELECT 'c_nationkey', 'integer', count(c_nationkey) FROM customer
    UNION ALL SELECT 'c_acctbal', 'float', count(c_acctbal) FROM customer
    UNION ALL SELECT 'c_mktsegment', 'string', count(c_mktsegment) FROM customer
    """,
)
def column_types(spark: SparkSession, folder: str) -> DataFrame:
    """Types inferred from text columns, as they come out of a CSV file."""
    customer = table(spark, folder, "customer")
    text = customer.select(*[F.col(c).cast("string").alias(c) for c in customer.columns])
    return P.field_profile(P.column_entries(text)).select("name", "type", "filled")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of eight kinds."""
    documents = spread_table(spark, folder, "documents", "doc_id")
    kind = F.col("doc_id") % 8
    one_line = F.regexp_replace("text", "\\s+", " ")
    pairs = F.array_join(
        F.transform(F.split("text", "\n"), lambda line: F.concat(F.lit('n=1 words="'), F.size(F.split(line, " ")), F.lit('"'))),
        "\n",
    )
    body = (
        F.when(kind == 0, F.concat(F.lit('  \n [{"a": 1}]\n'), "text"))
        .when(kind == 1, F.concat(F.lit('\n{"a": 1}\n'), "text"))
        .when(kind == 2, F.concat(F.lit("<34>Oct 11 22:14:15 host su: "), one_line))
        .when(kind == 3, F.col("text"))
        .when(kind == 4, pairs)
        .when(kind == 5, F.concat(F.lit("host:a\tpath:b\tsize:1\n"), "text"))
        .when(kind == 6, F.concat(F.lit("\n"), pairs))
        .otherwise(F.concat(F.lit("plain start "), F.regexp_replace("text", "=", "-")))
    )
    suffix = F.element_at(
        F.array(*[F.lit(s) for s in (".json", ".txt", ".log", ".TSV", ".log", ".log", ".csv", ".log")]),
        (kind + 1).cast("int"),
    )
    name = F.concat(F.lit("f"), "doc_id", suffix)
    return lines_from_column(documents.select(name.alias("name"), body.alias("body")), "body", "name")


_FORMATS_SQL = """
    SELECT 'f' || doc_id || ['.json', '.txt', '.log', '.TSV', '.log', '.log', '.csv', '.log'][doc_id % 8 + 1] AS file,
           ['json_array', 'ndjson', 'syslog', 'tsv', 'logfmt', 'ltsv', 'logfmt', 'csv'][doc_id % 8 + 1] AS format
    FROM documents
"""


@workload("file_formats", _FORMATS_SQL)
def file_formats(spark: SparkSession, folder: str) -> DataFrame:
    return P.detect_formats(_files(spark, folder)).select(F.col("source_file").alias("file"), "format")


@workload(
    "format_agreement",
    f"""
    SELECT count(*) AS files, count(DISTINCT format) AS formats, count(DISTINCT format) = 1 AS uniform,
           CASE WHEN count(DISTINCT format) = 1 THEN min(format) END AS format FROM ({_FORMATS_SQL})
    """,
)
def format_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return P.format_agreement(P.detect_formats(_files(spark, folder)))


@workload(
    "preview_per_file",
    """
    SELECT event_type AS file, event_id AS line FROM (
      SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events)
    WHERE rn <= 5
    """,
)
def preview_per_file(spark: SparkSession, folder: str) -> DataFrame:
    """First five records of every file (one file per event type)."""
    lines = event_json_lines(spark, folder)
    return P.preview_per_file(lines, per_file=5).select(
        F.col("source_file").alias("file"), F.col("line_id").alias("line")
    )


_COUNTS_SQL = """
    SELECT event_id, CAST(4 + CASE WHEN event_id % 3 = 0 THEN 3 WHEN event_id % 3 = 1 THEN 1 ELSE 0 END AS INTEGER) AS n_fields
    FROM events
"""


def _nested_counts(spark: SparkSession, folder: str) -> DataFrame:
    events = spread_table(spark, folder, "events", "event_id")
    inner = F.struct(F.lit(1).alias("a"), F.struct(F.lit("x:y").alias("b"), F.array(F.lit(1), F.lit(2)).alias("c")).alias("d"))
    body = F.struct(
        "event_id", "user_id", "event_type", "value",
        F.when(F.col("event_id") % 3 == 0, inner).alias("nested"),
        F.when(F.col("event_id") % 3 == 1, F.array(inner)).alias("list"),
    )
    return events.select("event_id", P.json_field_count(F.to_json(body)).alias("n_fields"))


@workload("field_counts", _COUNTS_SQL)
def field_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _nested_counts(spark, folder)


@workload(
    "field_count_gate",
    f"""
    SELECT max(n_fields) AS max_found, count(*) FILTER (WHERE n_fields > 6) AS offenders,
           count(*) FILTER (WHERE n_fields > 6) = 0 AS valid FROM ({_COUNTS_SQL})
    """,
)
def field_count_gate(spark: SparkSession, folder: str) -> DataFrame:
    return P.field_count_summary(_nested_counts(spark, folder), max_fields=6)


@workload(
    "tabular_check",
    """
    SELECT doc_id, NOT (strpos(top, ',') = 0 AND (length(top) > 50 OR length(top) - length(replace(top, ' ', '')) > 3)) AS tabular
    FROM (SELECT doc_id, string_split(text, chr(10))[1] AS top FROM documents)
    """,
)
def tabular(spark: SparkSession, folder: str) -> DataFrame:
    lines = leading_lines(lines_from_column(spread_table(spark, folder, "documents", "doc_id"), "text", "doc_id"), 1)
    return tabular_check(lines).select(F.col("source_path").cast("bigint").alias("doc_id"), "tabular")


@workload(
    "timestamp_candidates",
    """
    SELECT name, by_name, by_value, by_name OR by_value AS candidate FROM (
      SELECT 'o_orderkey' AS name, FALSE AS by_name, bool_or(o_orderkey > 1000000000) AS by_value FROM orders
      UNION ALL SELECT 'o_orderstatus', TRUE, bool_or(regexp_matches(o_orderstatus, '^[0-9]{10,13}$')) FROM orders
      UNION ALL SELECT 'o_totalprice', FALSE, bool_or(o_totalprice > 1000000000) FROM orders
      UNION ALL SELECT 'o_orderdate', TRUE, bool_or(regexp_matches(CAST(o_orderdate AS VARCHAR), '^[0-9]{4}-[0-9]{2}-[0-9]{2}')) FROM orders
      UNION ALL SELECT 'seen', FALSE, bool_or(epoch(o_orderdate) > 1000000000) FROM orders)
    """,
)
def timestamp_candidates(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    shaped = orders.select(
        "o_orderkey",
        "o_orderstatus",
        "o_totalprice",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("seen"),
    )
    return P.timestamp_candidates(shaped)


@workload(
    "record_counts",
    "SELECT event_type AS file, count(*) AS records FROM events GROUP BY event_type",
)
def record_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Records per file, broken ones included."""
    lines = event_json_lines(spark, folder)
    broken = F.when(F.col("line_id") % 50 == 0, F.concat(F.col("value"), F.lit("}{"))).otherwise(F.col("value"))
    records = json_columns(lines.withColumn("value", broken), EVENT_FIELDS)
    return records.groupBy(F.col("source_file").alias("file")).agg(F.count(F.lit(1)).alias("records"))


@workload(
    "wide_records",
    """
    WITH n AS (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_line FROM orders GROUP BY 1),
    r AS (SELECT o_custkey, row_number() OVER (ORDER BY n DESC, first_line) AS place FROM n)
    SELECT o_orderkey AS line, o_orderstatus AS status, CASE WHEN place <= 86 THEN CAST(o_orderkey * 3 AS VARCHAR) END AS listed,
           CASE WHEN place > 86 THEN '{"c' || o_custkey || '":"' || o_orderkey * 3 || '"}' END AS others
    FROM orders JOIN r USING (o_custkey)
    """,
)
def wide_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records with a field name per customer: 100 columns, all other fields in one."""
    orders = table(spark, folder, "orders")
    text = F.concat(
        F.lit("order:"), "o_orderkey", F.lit("\tstatus:"), "o_orderstatus", F.lit("\tc"), "o_custkey", F.lit(":"),
        F.col("o_orderkey") * 3, F.lit("\tm"), F.month("o_orderdate"), F.lit(":1"),
    )
    found = parse_lines(as_lines(orders, text, "o_orderkey"), "ltsv", max_fields=100, max_columns=100)
    listed = [F.col(name) for name in found.columns if name[0] == "c"]
    return found.select(
        F.col("line_id").alias("line"),
        "status",
        F.coalesce(*listed).alias("listed"),
        F.to_json(P.OTHER_FIELDS).alias("others"),
    )
