"""Record formats: table rows are rendered as text lines and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.binding import with_parsed
from logloom.functions.coercion import coerce
from logloom.functions.control import filename_display, filename_list, list_column, mapping_column
from logloom.functions.timestamps import format_utc, parse_timestamp
from logloom.operators.mapping import map_fields
from logloom.operators.time_layouts import column_layouts, time_orders, time_shapes
from logloom.sources.delimited import parse_records, spaced_records
from logloom.sources.json_arrays import split_elements
from logloom.sources.lines import lines_from_column
from logloom.sources.records import flatten_map, json_columns, key_value_columns, parse_lines
from logloom.workloads import spread_table, table, workload

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def as_lines(rows: DataFrame, text: Column, line_id: Column | str, file: Column | None = None) -> DataFrame:
    name = F.lit("table") if file is None else file.cast("string")
    return with_parsed(rows, "_text", text).select(
        name.alias("source_path"),
        name.alias("source_file"),
        F.lit(0).cast("bigint").alias("split_start"),
        (F.col(line_id) if isinstance(line_id, str) else line_id).cast("bigint").alias("line_id"),
        F.col("_text").alias("value"),
    )


def event_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    events = spread_table(spark, folder, "events", "event_id")
    body = F.struct(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"),
        "user_id",
        "event_type",
        F.col("value").cast("string").alias("value"),
        F.from_json("props", "k bigint").alias("props"),
    )
    return as_lines(events, F.to_json(body), "event_id", F.col("event_type"))


EVENT_FIELDS = [
    ("event_id", "integer", "bigint"),
    ("ts", "string", "string"),
    ("user_id", "integer", "bigint"),
    ("event_type", "string", "string"),
    ("value", "float", "string"),
    ("props", "object", "variant"),
]


@workload(
    "errors_per_hour",
    """
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H') AS hour,
           count(*) AS errors, count(DISTINCT user_id) AS users,
           max(value) AS max_value, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_sum
    FROM events WHERE event_type = 'error' GROUP BY 1
    """,
)
def errors_per_hour(spark: SparkSession, folder: str) -> DataFrame:
    """From raw JSON lines to an hourly report: parse, rename, normalise the time, coerce, count."""
    records = json_columns(event_json_lines(spark, folder), EVENT_FIELDS)
    mapped = map_fields(
        records.drop("source_path", "source_file", "split_start", "line_id", "_error", "_record"),
        mappings={"user_id": "user.id", "event_type": "event.kind"},
        excluded=["event_id"],
        timestamp_field="ts",
        field_types={"value": "float"},
    )
    errors = mapped.filter(F.col("`event.kind`") == "error")
    return errors.groupBy(F.substring("@timestamp", 1, 13).alias("hour")).agg(
        F.count(F.lit(1)).alias("errors"),
        F.count_distinct("`user.id`").alias("users"),
        F.max("value").alias("max_value"),
        F.sum(F.try_variant_get("props", "$.k", "bigint")).alias("k_sum"),
    )


@workload(
    "ndjson_records",
    """
    SELECT event_id AS line, CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS user_id,
           CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN NULL ELSE event_type END AS event_type,
           CASE WHEN event_id % 11 = 0 THEN 'malformed JSON' WHEN event_id % 13 = 0 THEN 'record is not an object' END AS error
    FROM (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END AS user_id, event_type FROM events)
    """,
)
def ndjson_records(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines with malformed and non-object lines among them."""
    events = spread_table(spark, folder, "events", "event_id")
    text = F.to_json(F.struct("user_id", "event_type"))
    spoiled = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit('{"user_id": '), "event_id")).when(
        F.col("event_id") % 13 == 0, F.concat(F.lit("["), "event_id", F.lit("]"))
    )
    lines = as_lines(events, F.coalesce(spoiled, text), "event_id")
    fields = [("user_id", "integer", "bigint"), ("event_type", "string", "string")]
    records = json_columns(lines, fields)
    return records.select(F.col("line_id").alias("line"), "user_id", "event_type", F.col("_error").alias("error"))


@workload(
    "json_array_elements",
    """
    SELECT doc_id, CAST(position AS BIGINT) AS position,
           CASE position WHEN 1 THEN CAST(length(text) AS BIGINT) END AS text_chars,
           CASE position WHEN 1 THEN md5(text) END AS text_md5,
           CASE position WHEN 2 THEN lang END AS lang,
           CASE position WHEN 3 THEN n_chars END AS n_chars
    FROM documents CROSS JOIN (VALUES (1), (2), (3)) AS p(position)
    """,
)
def json_array_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as one JSON array, split into its elements by structure."""
    documents = spread_table(spark, folder, "documents", "doc_id")
    first = F.to_json(F.struct("text", F.array(F.lit(1), F.lit(2)).alias("pair")))
    second = F.to_json(F.struct("lang", F.struct("source", "doc_id").alias("origin")))
    third = F.to_json(F.struct("n_chars"))
    arrays = documents.select(
        "doc_id", F.concat(F.lit(" ["), first, F.lit(", "), second, F.lit(",\n"), third, F.lit("]\n")).alias("body")
    )
    name = F.col("doc_id").cast("string")
    start = F.lit(0).cast("bigint")
    texts = arrays.select(
        name.alias("source_path"), name.alias("source_file"), start.alias("split_start"), start.alias("line_id"), F.col("body").alias("value")
    )
    elements = split_elements(texts, whole=True)
    parsed = elements.withColumn("r", F.from_json("value", "text string, lang string, n_chars bigint, pair array<int>"))
    position = F.when(F.col("r.text").isNotNull(), 1).when(F.col("r.lang").isNotNull(), 2).otherwise(3)
    return parsed.select(
        F.col("source_path").cast("bigint").alias("doc_id"),
        position.cast("bigint").alias("position"),
        F.length("r.text").cast("bigint").alias("text_chars"),
        F.md5("r.text").alias("text_md5"),
        F.col("r.lang").alias("lang"),
        F.col("r.n_chars").alias("n_chars"),
    )


@workload(
    "logfmt_records",
    """
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, user_id, event_type || ' seen' AS kind, value,
           CAST(NULL AS VARCHAR) AS note
    FROM events
    """,
)
def logfmt_records(spark: SparkSession, folder: str) -> DataFrame:
    events = spread_table(spark, folder, "events", "event_id")
    text = F.concat(
        F.lit("kind=overwritten id="), "event_id", F.lit(' at="'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        F.lit("\" user='"), "user_id", F.lit("' kind=\""), "event_type", F.lit(' seen" value='),
        F.col("value").cast("string"), F.lit(' note=""'),
    )
    fields = ["id", "at", "user", "kind", "value", "note"]
    flat = key_value_columns(as_lines(events, text, "event_id"), "logfmt", fields).select(*fields)
    mapped = map_fields(
        flat,
        mappings={"id": "event_id", "user": "user_id"},
        timestamp_field="at",
        field_types={"id": "integer", "user": "integer", "value": "float"},
    )
    return mapped.select("event_id", "at", "user_id", "kind", "value", "note")


@workload(
    "ltsv_records",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
           CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS o_orderpriority
    FROM orders WHERE o_orderkey % 10 <> 7
    """,
)
def ltsv_records(spark: SparkSession, folder: str) -> DataFrame:
    """Tab- and blank-separated labelled lines; lines without a label are dropped."""
    orders = spread_table(spark, folder, "orders", "o_orderkey")
    even = F.col("o_orderkey") % 2 == 0
    gap = F.when(even, "\t").otherwise("   ")
    labelled = F.concat(
        F.lit("key:"), "o_orderkey", gap, F.lit("cust: "), "o_custkey", gap, F.lit("status:"), "o_orderstatus", gap,
        F.lit("price:"), F.col("o_totalprice").cast("string"), gap, F.lit("junk"), gap,
        F.lit("day:"), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.when(even, F.concat(gap, F.lit("prio:"), "o_orderpriority")).otherwise(F.lit("")),
    )
    text = F.when(F.col("o_orderkey") % 10 == 7, F.lit("no labels here")).otherwise(labelled)
    fields = ["key", "cust", "status", "price", "day", "prio"]
    flat = key_value_columns(as_lines(orders, text, "o_orderkey"), "ltsv", fields)
    return flat.select(
        F.col("key").cast("bigint").alias("o_orderkey"),
        F.col("cust").cast("bigint").alias("o_custkey"),
        F.col("status").alias("o_orderstatus"),
        F.col("price").cast("double").alias("o_totalprice"),
        F.col("day").alias("o_orderdate"),
        F.col("prio").alias("o_orderpriority"),
    )


@workload(
    "syslog_records",
    """
    SELECT event_id AS line,
           CASE WHEN event_id % 4 < 3 THEN CAST(event_id % 192 AS VARCHAR) END AS priority,
           CASE WHEN event_id % 4 IN (1, 2) THEN '1' END AS version,
           CASE event_id % 4 WHEN 0 THEN strftime(ts, '%b %d %H:%M:%S')
                WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS "timestamp",
           CASE WHEN event_id % 4 < 3 THEN 'host' || user_id END AS hostname,
           CASE WHEN event_id % 4 < 3 THEN event_type END AS app_name,
           CASE WHEN event_id % 4 IN (1, 2) THEN CAST(user_id AS VARCHAR) END AS proc_id,
           CASE WHEN event_id % 4 IN (1, 2) THEN 'ID' || event_id END AS msg_id,
           CASE event_id % 4 WHEN 2 THEN '- k is ' || props WHEN 3 THEN 'plain text ' || props ELSE 'k is ' || props END AS message
    FROM events
    """,
)
def syslog_records(spark: SparkSession, folder: str) -> DataFrame:
    """Both syslog generations and plain lines in one log."""
    events = spread_table(spark, folder, "events", "event_id")
    pri = F.concat(F.lit("<"), F.col("event_id") % 192, F.lit(">"))
    host = F.concat(F.lit("host"), "user_id")
    kind = F.col("event_id") % 4
    older = F.concat(pri, F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" "), host, F.lit(" "), "event_type", F.lit(": k is "), "props")
    head = F.concat(
        pri, F.lit("1 "), F.date_format("ts", ISO), F.lit(" "), host, F.lit(" "), "event_type", F.lit(" "), "user_id",
        F.lit(" ID"), "event_id",
    )
    text = (
        F.when(kind == 0, older)
        .when(kind == 1, F.concat(head, F.lit(' [ex@1 a="1"] k is '), "props"))
        .when(kind == 2, F.concat(head, F.lit(" - k is "), "props"))
        .otherwise(F.concat(F.lit("plain text "), "props"))
    )
    records = parse_lines(as_lines(events, text, "event_id"), "syslog")
    return records.drop("source_path", "source_file", "split_start").withColumnRenamed("line_id", "line")


@workload(
    "csv_records",
    """
    SELECT c_custkey AS custkey, CASE c_custkey % 5 WHEN 4 THEN NULL ELSE c_name || ', "Ltd"' END AS name,
           CASE c_custkey % 5 WHEN 4 THEN NULL WHEN 3 THEN NULL ELSE c_mktsegment END AS segment
    FROM customer
    """,
)
def csv_records(spark: SparkSession, folder: str) -> DataFrame:
    """Quoted, short, over-long and empty cells; a repeated header name keeps its last column."""
    customers = table(spark, folder, "customer")
    name = F.concat(F.lit('"'), "c_name", F.lit(', ""Ltd"""'))
    kind = F.col("c_custkey") % 5
    text = (
        F.when(kind == 4, F.col("c_custkey").cast("string"))
        .when(kind == 3, F.concat_ws(",", "c_custkey", F.lit("first"), name, F.lit("")))
        .when(kind == 2, F.concat_ws(",", "c_custkey", F.lit("first"), name, "c_mktsegment", F.lit("surplus")))
        .otherwise(F.concat_ws(",", "c_custkey", F.lit("first"), name, "c_mktsegment"))
    )
    lines = as_lines(customers, text, F.col("c_custkey") + 1)
    records = parse_records(lines, ["custkey", "name", "name", "segment"], ",")
    return records.select(F.col("custkey").cast("bigint").alias("custkey"), "name", "segment")


@workload(
    "spaced_records",
    """
    SELECT c_nationkey AS nation, c_custkey AS custkey, c_name AS name,
           CASE WHEN c_custkey % 3 = 0 THEN '' ELSE lower(c_mktsegment) || ' one' END AS segment
    FROM customer
    """,
)
def spaced(spark: SparkSession, folder: str) -> DataFrame:
    """One blank-separated file per nation, each with its own header line."""
    customers, nations = table(spark, folder, "customer"), table(spark, folder, "nation")
    row = F.concat(
        F.lit("  "), "c_custkey", F.lit("   "), "c_name",
        F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" one  cut"))),
    )
    body = as_lines(customers, row, F.col("c_custkey") + 1, F.col("c_nationkey"))
    headers = as_lines(nations, F.lit("custkey   name  segment"), F.lit(0), F.col("n_nationkey"))
    records = spaced_records(headers.unionByName(body))
    return flatten_map(records, ["custkey", "name", "segment"]).select(
        F.col("source_path").cast("bigint").alias("nation"),
        F.col("custkey").cast("bigint").alias("custkey"),
        "name",
        "segment",
    )


@workload(
    "raw_lines",
    """
    SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE line = '') AS blank, CAST(sum(length(line)) AS BIGINT) AS chars
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id
    """,
)
def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    records = parse_lines(lines_from_column(spread_table(spark, folder, "documents", "doc_id"), "text", "doc_id"), "raw")
    return records.groupBy(F.col("source_path").cast("bigint").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("raw_message") == "").alias("blank"),
        F.sum(F.length("raw_message")).alias("chars"),
    )


@workload(
    "normalised_times",
    """
    SELECT event_id, event_id % 9 AS layout,
           CASE event_id % 9 WHEN 8 THEN NULL
                WHEN 7 THEN strftime(to_timestamp(20240100 + day(ts)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ')
                ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') END AS utc
    FROM events
    """,
)
def normalised_times(spark: SparkSession, folder: str) -> DataFrame:
    """One instant in nine renderings: ISO, epochs, web-server, mail, US and junk."""
    events = spread_table(spark, folder, "events", "event_id").withColumn("at", F.col("ts").cast("timestamp"))
    micros = F.unix_micros("at")
    east = F.date_format(F.col("at") + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.element_at(
        F.array(
            F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
            F.floor(micros / 1_000_000).cast("string"),
            F.floor(micros / 1000).cast("string"),
            F.date_format("at", "dd/MMM/yyyy:HH:mm:ss '+0000'"),
            F.concat(east, F.lit("+02:00")),
            F.date_format("at", "EEE, dd MMM yyyy HH:mm:ss '+0000'"),
            F.date_format("at", "MM/dd/yyyy HH:mm:ss"),
            F.date_format("at", "yyyyMMdd"),
            F.concat(F.lit("at "), "event_type"),
        ),
        (F.col("event_id") % 9 + 1).cast("int"),
    )
    rendered = events.select("event_id", text.alias("text"))
    parsed = parse_timestamp(F.col("text"), rendered.schema["text"].dataType)
    return rendered.select("event_id", (F.col("event_id") % 9).alias("layout"), format_utc(parsed).alias("utc"))


def _dated_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Order dates as text: one column per habit, one that never tells, one of two habits."""
    orders = spread_table(spark, folder, "orders", "o_orderkey").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    early = F.make_date(F.year("at"), F.month("at"), (F.day("at") - 1) % 12 + 1)
    us, eu = F.date_format("at", "MM/dd/yyyy"), F.date_format("at", "dd/MM/yyyy")
    return orders.select(
        "o_orderkey",
        us.alias("us"),
        F.when(F.col("o_orderkey") % 5 == 0, F.date_format("at", "d.M.yyyy H:mm")).otherwise(eu).alias("eu"),
        F.date_format(early, "dd-MM-yyyy").alias("unsure"),
        F.when(F.col("o_orderkey") % 3 == 0, eu).otherwise(us).alias("mixed"),
        F.when(F.col("o_orderkey") % 2 == 0, F.date_format("at", "H:mm, d MMM yyyy")).otherwise("soon").alias("named"),
    )


DATED = ("us", "eu", "unsure", "mixed", "named")


@workload(
    "time_orders",
    """
    WITH d AS (SELECT o_orderkey AS k, day(o_orderdate) AS day FROM orders),
    v AS (
        SELECT 'us' AS "column", 1 AS times, 1 AS numeric_dates, day > 12 AS m, FALSE AS d FROM d
        UNION ALL SELECT 'eu', 1, 1, FALSE, day > 12 FROM d
        UNION ALL SELECT 'unsure', 1, 1, FALSE, FALSE FROM d
        UNION ALL SELECT 'mixed', 1, 1, day > 12 AND k % 3 <> 0, day > 12 AND k % 3 = 0 FROM d
        UNION ALL SELECT 'named', CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END, 0, FALSE, FALSE FROM d
    )
    SELECT *, CASE WHEN day_votes > month_votes THEN 'day' ELSE 'month' END AS date_order,
           numeric_dates = 0 OR month_votes <> day_votes AS decided
    FROM (SELECT "column", count(*) AS filled, CAST(sum(times) AS BIGINT) AS times,
                 CAST(sum(numeric_dates) AS BIGINT) AS numeric_dates,
                 count(*) FILTER (WHERE m) AS month_votes, count(*) FILTER (WHERE d) AS day_votes
          FROM v GROUP BY "column")
    """,
)
def date_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Which of day and month comes first in each column, and where nothing tells."""
    return time_orders(time_shapes(_dated_columns(spark, folder), DATED))


@workload(
    "column_dates",
    """
    WITH d AS (SELECT o_orderkey, o_orderdate AS placed, strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS utc FROM orders)
    SELECT o_orderkey, utc AS us, utc AS eu,
           strftime(make_date(year(placed), (day(placed) - 1) % 12 + 1, month(placed)), '%Y-%m-%dT00:00:00Z') AS unsure,
           CASE WHEN o_orderkey % 3 <> 0 THEN utc
                WHEN day(placed) <= 12 THEN strftime(make_date(year(placed), day(placed), month(placed)), '%Y-%m-%dT00:00:00Z') END AS mixed,
           CASE WHEN o_orderkey % 2 = 0 THEN utc END AS named
    FROM d
    """,
)
def column_dates(spark: SparkSession, folder: str) -> DataFrame:
    """The same columns normalised, each by its own layouts and one order."""
    rendered = _dated_columns(spark, folder)
    times = column_layouts(rendered, DATED)
    kind = rendered.schema["us"].dataType
    read = [format_utc(parse_timestamp(F.col(name), kind, times[name].layouts)).alias(name) for name in DATED]
    return rendered.select("o_orderkey", *read)


@workload(
    "coerced_values",
    """
    SELECT l_orderkey, l_linenumber, form,
           CASE form WHEN 0 THEN CAST(trunc(l_extendedprice) AS BIGINT) WHEN 1 THEN CAST(l_quantity AS BIGINT)
                     WHEN 2 THEN 1 WHEN 3 THEN CAST(l_quantity * 1000 AS BIGINT) WHEN 4 THEN NULL WHEN 5 THEN NULL
                     WHEN 6 THEN CAST(l_partkey AS BIGINT) END AS as_integer,
           CASE form WHEN 0 THEN l_extendedprice WHEN 1 THEN l_quantity WHEN 2 THEN 1.0 WHEN 3 THEN l_quantity * 1000
                     WHEN 4 THEN NULL WHEN 5 THEN CAST('inf' AS DOUBLE) WHEN 6 THEN CAST(l_partkey AS DOUBLE) END AS as_float,
           CASE form WHEN 1 THEN CASE WHEN l_quantity = 1 THEN TRUE WHEN l_quantity = 0 THEN FALSE END
                     WHEN 2 THEN TRUE WHEN 4 THEN l_returnflag <> 'R' END AS as_boolean,
           CASE form WHEN 0 THEN ' ' || CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS VARCHAR)
                     WHEN 1 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) WHEN 2 THEN '1'
                     WHEN 3 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || 'e3'
                     WHEN 4 THEN CASE WHEN l_returnflag = 'R' THEN 'No' ELSE ' Yes ' END
                     WHEN 5 THEN 'Infinity' WHEN 6 THEN '+0_' || CAST(l_partkey AS VARCHAR) END AS as_text
    FROM (SELECT *, (l_orderkey + l_linenumber) % 8 AS form FROM lineitem)
    """,
)
def coerced_values(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers, exponents, underscores, words, infinities and empty text against all target types."""
    items = spread_table(spark, folder, "lineitem", "l_orderkey").withColumn("form", (F.col("l_orderkey") + F.col("l_linenumber")) % 8)
    text = F.element_at(
        F.array(
            F.concat(F.lit(" "), F.col("l_extendedprice").cast("decimal(18,2)").cast("string")),
            F.col("l_quantity").cast("bigint").cast("string"),
            F.lit("1"),
            F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit("e3")),
            F.when(F.col("l_returnflag") == "R", "No").otherwise(" Yes "),
            F.lit("Infinity"),
            F.concat(F.lit("+0_"), F.col("l_partkey").cast("string")),
            F.lit(""),
        ),
        (F.col("form") + 1).cast("int"),
    )
    rendered = items.select("l_orderkey", "l_linenumber", "form", text.alias("text"))
    kind = rendered.schema["text"].dataType
    return rendered.select(
        "l_orderkey",
        "l_linenumber",
        "form",
        coerce(F.col("text"), kind, "integer")[0].alias("as_integer"),
        coerce(F.col("text"), kind, "float")[0].alias("as_float"),
        coerce(F.col("text"), kind, "boolean")[0].alias("as_boolean"),
        coerce(F.col("text"), kind, "string")[0].alias("as_text"),
    )


@workload(
    "mapped_orders",
    """
    SELECT o_orderkey AS "order.id", CAST(trunc(o_totalprice) AS BIGINT) AS "order.total", o_orderpriority AS "order.state",
           'orders-' || (o_orderkey % 4) || '.log' AS origin, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS "@timestamp",
           o_orderstatus = 'F' AS done
    FROM orders
    """,
)
def mapped_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Rename to dotted names, exclude, file name, timestamp of an excluded field, coercion.

    Two fields are renamed to ``order.state``; the later one wins.
    """
    orders = spread_table(spark, folder, "orders", "o_orderkey")
    shaped = orders.withColumn("done", F.when(F.col("o_orderstatus") == "F", "yes").otherwise("off")).select(
        "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_custkey", "o_orderdate", "done"
    )
    return map_fields(
        shaped,
        mappings={
            "o_orderkey": "order.id",
            "o_totalprice": "order.total",
            "o_orderstatus": "order.state",
            "o_orderpriority": "order.state",
            "source_file": "origin",
        },
        excluded=["o_custkey", "o_orderdate"],
        timestamp_field="o_orderdate",
        field_types={"o_totalprice": "integer", "done": "boolean", "absent": "float"},
        filename_field="source_file",
        filename=F.concat(F.lit("orders-"), F.col("o_orderkey") % 4, F.lit(".log")),
    )


@workload(
    "decoded_manifest_columns",
    """
    SELECT o_orderkey,
           CASE o_orderkey % 3 WHEN 0 THEN 'a.json, b' || o_custkey || '.json' WHEN 1 THEN 'plain ' || o_custkey ELSE 'one.csv' END AS display,
           CAST(CASE o_orderkey % 3 WHEN 0 THEN 2 ELSE 1 END AS BIGINT) AS files,
           CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS mapped_to,
           CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 2 END AS BIGINT) AS excluded
    FROM orders
    """,
)
def decoded_manifest_columns(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lists, plain names and broken JSON in control-table columns."""
    orders = spread_table(spark, folder, "orders", "o_orderkey")
    kind = F.col("o_orderkey") % 3
    name = (
        F.when(kind == 0, F.concat(F.lit('["a.json", "b'), "o_custkey", F.lit('.json"]')))
        .when(kind == 1, F.concat(F.lit("plain "), "o_custkey"))
        .otherwise('["one.csv"]')
    )
    mapping = F.when(F.col("o_orderkey") % 4 == 0, '{"status": ').otherwise(
        F.concat(F.lit('{"status": "'), "o_orderstatus", F.lit('"}'))
    )
    excluded = F.when(F.col("o_orderkey") % 5 == 0, "nothing").otherwise('["a", "b"]')
    rows = orders.select("o_orderkey", name.alias("name"), mapping.alias("mapping"), excluded.alias("excluded"))
    return rows.select(
        "o_orderkey",
        filename_display(F.col("name")).alias("display"),
        F.size(filename_list(F.col("name"))).cast("bigint").alias("files"),
        F.try_element_at(mapping_column(F.col("mapping")), F.lit("status")).alias("mapped_to"),
        F.size(list_column(F.col("excluded"))).cast("bigint").alias("excluded"),
    )
