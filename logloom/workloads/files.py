"""Queries over real files: tables are rendered to files in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.coercion import coerce
from logloom.functions.timestamps import format_utc, parse_timestamp
from logloom.plans.control import Warehouse
from logloom.plans.ingest import ingest, read_dead_letters, read_target
from logloom.plans.preview import preview_files
from logloom.session import scratch_folder
from logloom.sources.lines import raw_sample
from logloom.sources.records import read_logs
from logloom.streaming.ingest import start_ingest
from logloom.streaming.progress import progress_table
from logloom.workloads import spread_table, table, workload


@workload(
    "csv_files",
    """
    SELECT CAST(doc_id AS VARCHAR) AS id, lang, md5(nullif(text, '')) AS text_md5, CAST(NULL AS VARCHAR) AS size FROM documents
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), NULL, md5('about 5" by ' || p_partkey || '"'), CAST(p_size AS VARCHAR) FROM part
    """,
)
def csv_files(spark: SparkSession, folder: str) -> DataFrame:
    """Two sets of CSV files in one read: quoted cells with line breaks and doubled quotes under
    commas, stray quotes in bare cells under semicolons, and other headers."""
    place = scratch_folder(spark)
    documents = spread_table(spark, folder, "documents", "doc_id").select(F.col("doc_id").alias("id"), "lang", "text")
    documents.write.options(header=True, escape='"', lineSep="\n").csv(f"{place}/documents")
    text = F.concat(F.lit('about 5" by '), "p_partkey", F.lit('"'))
    parts = table(spark, folder, "part").select(
        F.col("p_size").alias("size"), text.alias("text"), F.col("p_partkey").alias("id")
    )
    parts.write.options(header=True, sep=";", escapeQuotes=False, lineSep="\n").csv(f"{place}/parts")
    records = read_logs(spark, [f"{place}/documents", f"{place}/parts"], "csv")
    return records.select("id", "lang", F.md5("text").alias("text_md5"), "size")


@workload(
    "mixed_tsv_files",
    """
    SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(NULL AS VARCHAR) AS size FROM customer
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), NULL, CAST(p_size AS VARCHAR) FROM part
    """,
)
def mixed_tsv_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files with tabs and files with runs of blanks between their cells, in one read."""
    place = scratch_folder(spark)
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    customers.write.options(header=True, sep="\t").csv(f"{place}/tabs")
    parts = table(spark, folder, "part").select(F.concat_ws("   ", "p_size", "p_partkey").alias("size    id"))
    parts.write.options(header=True).csv(f"{place}/blanks")
    return read_logs(spark, [f"{place}/tabs", f"{place}/blanks"], "tsv").select("id", "name", "size")


def _order_log(spark: SparkSession, folder: str) -> str:
    """Orders as a log in the order of their keys, in files that follow each other by name."""
    line = F.concat(F.lit("key="), "o_orderkey", F.lit(' status="'), "o_orderstatus", F.lit('" ok'))
    place = scratch_folder(spark)
    orders = table(spark, folder, "orders").select("o_orderkey", line.alias("value"))
    orders.orderBy("o_orderkey").select("value").write.text(place)
    return place


@workload(
    "raw_line_sample",
    """
    SELECT 'key=' || o_orderkey || ' status="' || o_orderstatus || '" ok' AS value FROM orders ORDER BY o_orderkey LIMIT 10
    """,
)
def raw_line_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten lines of a log file, as a preview shows them."""
    return raw_sample(spark, _order_log(spark, folder))


@workload(
    "reparsed_preview",
    """
    WITH shown AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)
    SELECT 'raw' AS fmt, 'key=' || o_orderkey || ' status="' || o_orderstatus || '" ok' AS raw_message,
           CAST(NULL AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS status FROM shown
    UNION ALL SELECT 'logfmt', NULL, CAST(o_orderkey AS VARCHAR), o_orderstatus FROM shown
    """,
)
def reparsed_preview(spark: SparkSession, folder: str) -> DataFrame:
    """The same file previewed as raw lines and then, with other fields, as logfmt."""
    place = _order_log(spark, folder)
    shown = None
    for fmt in ("raw", "logfmt"):
        own = preview_files(spark, place, fmt)
        part = own.records.select(F.lit(fmt).alias("fmt"), *[name for name, _ in own.fields])
        shown = part if shown is None else shown.unionByName(part, allowMissingColumns=True)
    return shown


def _event_files(spark: SparkSession, folder: str) -> str:
    """Events as JSON lines, some of them cut short."""
    events = spread_table(spark, folder, "events", "event_id")
    whole = F.to_json(F.struct("event_id", "user_id", F.col("event_type").alias("Kind"), F.length("props").alias("size")))
    text = F.when(F.col("event_id") % 97 == 0, F.concat(F.lit('{"event_id": '), "event_id", F.lit(', "user'))).otherwise(whole)
    place = scratch_folder(spark)
    events.select(text).write.text(f"{place}/landing")
    return place


@workload(
    "ingested_events",
    """
    SELECT event_id, CAST(user_id AS VARCHAR) AS "user.id", event_type AS "Kind", CAST(length(props) AS DOUBLE) AS size
    FROM events WHERE event_id % 97 <> 0
    """,
)
def ingested_events(spark: SparkSession, folder: str) -> DataFrame:
    """JSON files with broken lines through the ingest job, read back from the target."""
    place = _event_files(spark, folder)
    warehouse = Warehouse(spark, f"{place}/warehouse")
    ingest(
        warehouse,
        f"{place}/landing",
        "events",
        field_mappings={"user_id": "user.id"},
        field_types={"user_id": "string", "size": "float"},
        run_id="one",
    )
    return read_target(warehouse, "events")


@workload(
    "ingest_run",
    """
    SELECT 'one' AS run_id, 'completed_with_errors' AS status, count(*) AS total,
           count(*) FILTER (event_id % 97 <> 0) AS accepted, count(*) FILTER (event_id % 97 = 0) AS rejected,
           count(*) FILTER (event_id % 97 = 0) AS dead_letters,
           CAST(sum(CAST('0x' || substr(md5('{"event_id": ' || event_id || ', "user'), 1, 15) AS BIGINT)::HUGEINT)
               FILTER (event_id % 97 = 0) AS VARCHAR) AS dead_sum, TRUE AS tracked
    FROM events
    """,
)
def ingest_run(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest row, dead letters and tracking that a run leaves."""
    place = _event_files(spark, folder)
    warehouse = Warehouse(spark, f"{place}/warehouse")
    ingest(warehouse, f"{place}/landing", "events", fmt="ndjson", run_id="one")
    dead = read_dead_letters(warehouse, "events", "one")
    # any number of rejected texts in any order: a sum of 60 bits of each one's hash
    print_ = F.conv(F.substring(F.md5("record"), 1, 15), 16, 10).cast("decimal(20,0)")
    letters = dead.agg(F.count(F.lit(1)).alias("dead_letters"), F.sum(print_).cast("string").alias("dead_sum"))
    runs = warehouse.manifest().select(
        F.col("id").alias("run_id"),
        "status",
        F.col("total_records").alias("total"),
        F.col("success_count").alias("accepted"),
        F.col("failure_count").alias("rejected"),
        "target",
    )
    tracked = warehouse.tracked_targets().select("target", F.lit(True).alias("tracked"))
    return runs.join(tracked, "target", "left").drop("target").join(letters, F.col("dead_letters") >= 0)


@workload(
    "streamed_events",
    "SELECT event_id, user_id, event_type AS \"Kind\", CAST(length(props) AS BIGINT) AS size FROM events WHERE event_id % 97 <> 0",
)
def streamed_events(spark: SparkSession, folder: str) -> DataFrame:
    """The same files through the continuous ingest of a landing folder."""
    place = _event_files(spark, folder)
    warehouse = Warehouse(spark, f"{place}/warehouse")
    query = start_ingest(warehouse, f"{place}/landing", "events", f"{place}/state", "landing", fmt="ndjson")
    query.awaitTermination()
    return read_target(warehouse, "events").select(
        *[F.col(name).cast("bigint").alias(name) for name in ("event_id", "user_id")],
        "Kind",
        F.col("size").cast("bigint").alias("size"),
    )


@workload("stream_progress", "SELECT 'orders' AS query, count(*) AS input_rows FROM orders")
def stream_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Progress rows of a finished stream over the orders, summed per query."""
    orders = table(spark, folder, "orders").schema
    place = scratch_folder(spark)
    stream = spark.readStream.schema(orders).option("pathGlobFilter", "orders.parquet").parquet(folder)
    query = (
        stream.select("o_orderkey")
        .writeStream.queryName("orders")
        .option("checkpointLocation", f"{place}/state")
        .trigger(availableNow=True)
        .format("parquet")
        .start(f"{place}/rows")
    )
    query.awaitTermination()
    return progress_table(spark, query).groupBy("query").agg(F.sum("input_rows").alias("input_rows"))


@workload(
    "numeric_times",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS from_seconds,
           strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS from_milliseconds,
           strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS from_float
    FROM orders
    """,
)
def numeric_times(spark: SparkSession, folder: str) -> DataFrame:
    """Epochs in number columns: seconds (some missing), milliseconds and floats."""
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    orders = spread_table(spark, folder, "orders", "o_orderkey").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 5 != 4, seconds).alias("from_seconds"),
        # beyond the threshold that tells milliseconds from seconds
        (seconds * 1000).alias("from_milliseconds"),
        (seconds.cast("double") + 0.25).alias("from_float"),
    )
    return orders.select(
        "o_orderkey",
        *[
            format_utc(parse_timestamp(F.col(name), orders.schema[name].dataType)).alias(name)
            for name in ("from_seconds", "from_milliseconds", "from_float")
        ],
    )


@workload(
    "unknown_target_type",
    """
    SELECT c_custkey, c_name AS kept_text, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS kept_or_null,
           c_nationkey AS kept_number
    FROM customer
    """,
)
def unknown_target_type(spark: SparkSession, folder: str) -> DataFrame:
    """Coercion to a type that doesn't exist keeps values, but for empty text."""
    customers = table(spark, folder, "customer").select(
        "c_custkey", "c_name", "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("some")
    )

    def kept(name: str):
        return coerce(F.col(name), customers.schema[name].dataType, "decimal")[0]

    return customers.select(
        "c_custkey",
        kept("c_name").alias("kept_text"),
        kept("some").alias("kept_or_null"),
        kept("c_nationkey").alias("kept_number"),
    )


@workload(
    "previewed_lines",
    """
    SELECT row_number() OVER (ORDER BY o_orderkey) AS position, 'order ' || o_orderkey AS line
    FROM orders ORDER BY o_orderkey LIMIT 100
    """,
)
def previewed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A preview shows the first hundred records in the order of the file."""
    place = scratch_folder(spark)
    orders = table(spark, folder, "orders").orderBy("o_orderkey")
    orders.select(F.concat(F.lit("order "), "o_orderkey")).write.text(f"{place}/orders")
    shown = preview_files(spark, f"{place}/orders", "raw").records
    ranked = shown.withColumn("position", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))
    return ranked.select("position", F.col("raw_message").alias("line"))
