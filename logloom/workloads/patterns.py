"""Grok extraction, coverage, spans and multi-line records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.grok_library import component_dictionary
from logloom.functions.regexes import compile_pattern
from logloom.operators.multiline import merge_lines
from logloom.operators.patterns import extract_fields, match_spans, pattern_coverage, sample_misses
from logloom.sources.lines import lines_from_column
from logloom.workloads import spread_table, table, workload
from logloom.workloads.formats import as_lines

ACCESS_LINE = (
    r"%{IP:client} - %{USER:user} \[%{HTTPDATE:at}\] \"%{WORD:verb} %{URIPATH:path}(?:%{URIPARAM:query})? "
    r"%{HTTPVERSION:protocol}\" %{INT:status:int} (?:%{INT:bytes}|-)"
).replace('\\"', '"')


@workload(
    "grok_access_log",
    """
    SELECT event_id AS line, CASE WHEN ok THEN '10.0.' || (user_id % 256) || '.' || (event_id % 256) END AS client,
           CASE WHEN ok THEN 'user_' || user_id END AS "user",
           CASE WHEN ok THEN strftime(ts, '%d/%b/%Y:%H:%M:%S +0000') END AS "at",
           CASE WHEN ok THEN 'GET' END AS verb, CASE WHEN ok THEN '/' || event_type || '/' || event_id END AS path,
           CASE WHEN ok AND event_id % 2 = 0 THEN '?k=1' END AS query, CASE WHEN ok THEN 'HTTP/1.1' END AS protocol,
           CASE WHEN ok THEN CASE event_type WHEN 'error' THEN '500' ELSE '200' END END AS status,
           CASE WHEN ok AND event_id % 3 > 0 THEN CAST(event_id AS VARCHAR) END AS bytes,
           CASE WHEN NOT ok THEN 'bad line ' || event_id END AS raw_message
    FROM (SELECT *, event_id % 7 <> 0 AS ok FROM events)
    """,
)
def grok_access_log(spark: SparkSession, folder: str) -> DataFrame:
    """Web-server lines with optional groups; lines that do not match are kept whole."""
    events = spread_table(spark, folder, "events", "event_id")
    good = F.concat(
        F.lit("10.0."), F.col("user_id") % 256, F.lit("."), F.col("event_id") % 256, F.lit(" - user_"), "user_id",
        F.lit(" ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss '+0000'"), F.lit('] "GET /'), "event_type", F.lit("/"),
        "event_id", F.when(F.col("event_id") % 2 == 0, "?k=1").otherwise(""), F.lit(' HTTP/1.1" '),
        F.when(F.col("event_type") == "error", "500").otherwise("200"), F.lit(" "),
        F.when(F.col("event_id") % 3 > 0, F.col("event_id").cast("string")).otherwise("-"),
    )
    text = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("bad line "), "event_id")).otherwise(good)
    found = extract_fields(as_lines(events, text, "event_id"), compile_pattern(ACCESS_LINE))
    return found.drop("source_path", "source_file", "split_start", "value").withColumnRenamed("line_id", "line")


URL = r"%{URIPROTO:scheme}://%{IPORHOST:host}%{URIPATH:path}(?:%{URIPARAM:query})?(?:#%{GREEDYDATA:fragment})?"


@workload(
    "grok_urls",
    r"""
    SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
           regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
           regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path,
           nullif(regexp_extract(url, '(\?[^#]*)', 1), '') AS query,
           CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)$', 1) END AS fragment
    FROM pages
    """,
)
def grok_urls(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    found = extract_fields(pages.select("page_id", F.col("url").alias("value")), compile_pattern(URL))
    return found.select("page_id", "scheme", "host", "path", "query", "fragment")


@workload(
    "component_registry",
    """
    SELECT c_custkey AS line, n_name AS nation, r_name AS region, CAST(NULL AS VARCHAR) AS raw_message
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    """,
)
def component_registry(spark: SparkSession, folder: str) -> DataFrame:
    """User-made components from registry rows (here: the region names) override nothing and are expanded by name."""
    region = table(spark, folder, "region")
    nation = table(spark, folder, "nation")
    customer = table(spark, folder, "customer")
    registry = region.select(
        F.concat(F.lit("REGION_"), "r_regionkey").alias("name"), F.regexp_replace("r_name", " ", "\\\\s").alias("regex")
    )
    components = component_dictionary(registry)
    names = sorted(name for name in components if name.startswith("REGION_"))
    components["ANY_REGION"] = "|".join(f"%{{{name}}}" for name in names)
    pattern = compile_pattern(r"%{DATA:nation} @ %{ANY_REGION:region}$", "grok", components)
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    lines = as_lines(rows, F.concat_ws(" @ ", "n_name", "r_name"), "c_custkey")
    return extract_fields(lines, pattern).select(F.col("line_id").alias("line"), "nation", "region", "raw_message")


COVERAGE = {
    "email": r"%{GREEDYDATA}%{EMAILADDRESS}",
    "ip": r"%{GREEDYDATA}\b%{IPV4}\b",
    "uuid": r"%{GREEDYDATA}%{UUID}",
    "level": r"%{LOGLEVEL}",
    "date": r"%{DATA}%{DATE_US}",
}


@workload(
    "pattern_coverage",
    r"""
    WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
    h AS (SELECT count(*) AS n,
      count(*) FILTER (WHERE regexp_matches(line, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')) AS email,
      count(*) FILTER (WHERE regexp_matches(line, '\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b')) AS ip,
      count(*) FILTER (WHERE regexp_matches(line, '[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}')) AS uuid,
      count(*) FILTER (WHERE regexp_matches(line, '^(?:TRACE|DEBUG|INFO|NOTICE|WARN|ERR|CRIT|FATAL|SEVERE|EMERG)')) AS level,
      count(*) FILTER (WHERE regexp_matches(line, '(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])[/-][0-9]{2}')) AS date
      FROM l)
    SELECT pattern, n AS lines, matches, CAST(matches AS DOUBLE) / n AS match_rate FROM (
      SELECT 'email' AS pattern, n, email AS matches FROM h UNION ALL SELECT 'ip', n, ip FROM h
      UNION ALL SELECT 'uuid', n, uuid FROM h UNION ALL SELECT 'level', n, level FROM h UNION ALL SELECT 'date', n, date FROM h)
    """,
)
def coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines of all documents each pattern matches."""
    lines = lines_from_column(spread_table(spark, folder, "documents", "doc_id"), "text", "doc_id")
    return pattern_coverage(lines, {name: compile_pattern(text) for name, text in COVERAGE.items()})


@workload(
    "pattern_coverage_many",
    """
    WITH b AS (SELECT unnest(range(1, 26)) AS brand), z AS (SELECT unnest(range(1, 41)) AS size),
    n AS (SELECT p_brand, p_size, count(*) AS matches FROM part GROUP BY ALL), t AS (SELECT count(*) AS lines FROM part)
    SELECT brand || '/' || size AS pattern, lines, coalesce(matches, 0) AS matches, CAST(coalesce(matches, 0) AS DOUBLE) / lines AS match_rate
    FROM b CROSS JOIN z CROSS JOIN t LEFT JOIN n ON p_brand = 'Brand#' || brand AND p_size = size
    UNION ALL SELECT 'any', lines, lines, 1.0 FROM t
    """,
)
def coverage_of_many(spark: SparkSession, folder: str) -> DataFrame:
    """A thousand patterns over the lines of a parts list, and one that has no literal text."""
    parts = table(spark, folder, "part")
    text = F.concat_ws(" ", "p_name", "p_brand", F.concat(F.lit("size "), "p_size", F.lit(";")))
    patterns = {
        f"{brand}/{size}": compile_pattern(f"%{{DATA:name}} Brand#{brand} size {size};")
        for brand in range(1, 26)
        for size in range(1, 41)
    }
    patterns["any"] = compile_pattern("%{WORD}")
    return pattern_coverage(as_lines(parts, text, "p_partkey"), patterns)


@workload(
    "pattern_misses",
    r"""
    WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT line FROM l WHERE NOT regexp_matches(line, '^(?:TRACE|DEBUG|INFO|NOTICE|WARN|ERR|CRIT|FATAL|SEVERE|EMERG)')
    ORDER BY line LIMIT 25
    """,
)
def misses(spark: SparkSession, folder: str) -> DataFrame:
    """The smallest lines that don't start with a level."""
    lines = lines_from_column(spread_table(spark, folder, "documents", "doc_id"), "text", "doc_id")
    return sample_misses(lines, compile_pattern(COVERAGE["level"]), limit=25, smallest=True)


@workload(
    "match_spans",
    r"""
    SELECT page_id, CAST(s AS BIGINT) AS match_start, CAST(s + length(m) AS BIGINT) AS match_end,
           CAST(strpos(substr(url, s + 1), sub) - 1 + s AS BIGINT) AS section_start,
           CAST(strpos(substr(url, s + 1), sub) - 1 + s + length(sub) AS BIGINT) AS section_end
    FROM (SELECT *, strpos(url, m) - 1 AS s FROM (
      SELECT page_id, url, nullif(regexp_extract(url, '/([a-z]{2})/[0-9]*[02468]'), '') AS m,
             nullif(regexp_extract(url, '/([a-z]{2})/[0-9]*[02468]', 1), '') AS sub
      FROM pages))
    """,
)
def spans(spark: SparkSession, folder: str) -> DataFrame:
    """Where in the address the language section before an even digit is found, null where there is none."""
    pages = table(spark, folder, "pages").select("page_id", F.col("url").alias("value"))
    found = match_spans(pages, compile_pattern(r"/(?P<section>[a-z]{2})/[0-9]*[02468]", "regex"))
    return found.select(
        "page_id",
        *[F.col(c).cast("bigint").alias(c) for c in ("match_start", "match_end", "section_start", "section_end")],
    )


@workload(
    "multiline_records",
    """
    WITH l AS (
      SELECT doc_id, CAST(generate_subscripts(parts, 1) AS BIGINT) - 1 AS pos, unnest(parts) AS line
      FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)),
    r AS (SELECT *, max(CASE WHEN regexp_matches(line, '^[A-M]') THEN pos END)
            OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS opened FROM l),
    c AS (SELECT *, pos - (pos - coalesce(opened, 0)) % 4 AS record_at FROM r)
    SELECT doc_id, record_at AS first_line, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY pos)) AS body_md5
    FROM c GROUP BY doc_id, record_at
    """,
)
def multiline_records(spark: SparkSession, folder: str) -> DataFrame:
    """Document lines merged into records of at most four lines that start with A to M."""
    lines = lines_from_column(spread_table(spark, folder, "documents", "doc_id"), "text", "doc_id")
    merged = merge_lines(lines, "[A-M]", max_lines=3)
    return merged.select(
        F.col("source_path").cast("bigint").alias("doc_id"),
        F.col("line_id").alias("first_line"),
        "n_lines",
        F.md5("value").alias("body_md5"),
    )
