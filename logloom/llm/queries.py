"""The registered queries of the training-data operators, with the SQL that must give the same rows."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.bpe import round_trip_digests
from logloom.llm.common import stored
from logloom.llm.hard_negatives import mine_negatives
from logloom.llm.lexical import rank_documents
from logloom.llm.line_dedup import dedup_lines
from logloom.llm.mixing import mix, word_count
from logloom.llm.neighbours import nearest
from logloom.llm.packing import pack_documents
from logloom.llm.quality import judge_quality
from logloom.llm.sharding import LAW, shard_documents
from logloom.llm.simhash import simhash_groups
from logloom.llm.suffix_dedup import remove_repeats
from logloom.llm.tool_calls import SCHEMA_COLUMNS, link_tool_calls
from logloom.llm.toxicity import held_out, score_toxicity, train_toxicity

TOXIC_FROM = 0.7

Build = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_groups(_table(spark, folder, "documents"), width=4, radius=4)


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    return judge_quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


TOOLS = [
    ("lookup", "query", "string", True),
    ("lookup", "limit", "integer", True),
    ("search", "query", "string", True),
    ("search", "page", "integer", True),
    ("search", "limit", "number", False),
    ("translate", "query", "string", True),
    ("translate", "limit", "string", False),
]


def conversation_calls(conversations: DataFrame) -> DataFrame:
    """The table `conversations` as messages with tool calls.

    Every assistant turn calls a tool with its text as an argument and needs the call at half its
    turn; every user turn answers the call of the turn before it.
    """

    def name_at(turn: Column) -> Column:
        return F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))

    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    half = F.when(F.col("turn") >= 1, name_at(F.floor(F.col("turn") / 2)))
    names = F.array(*[F.lit(name) for name in ("search", "lookup", "translate", "weigh")])
    call = F.struct(
        F.when(known, name_at(F.col("turn"))).alias("id"),
        F.element_at(names, F.coalesce(F.col("turn") % 4, F.lit(0)).cast("int") + 1).alias("name"),
        F.to_json(F.struct(F.col("text").alias("query"), F.length("text").alias("limit"))).alias("arguments"),
        F.array(F.when(known, half)).alias("after"),
    )
    answered = (F.col("role") == "user") & known & (F.col("turn") >= 1)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", "tool").otherwise(F.col("role")).alias("role"),
        "text",
        F.when(F.col("role") == "assistant", F.array(call)).alias("tool_calls"),
        F.when(answered, name_at(F.col("turn") - 1)).alias("tool_call_id"),
    )


def op3_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    schemas = spark.createDataFrame(TOOLS, SCHEMA_COLUMNS)
    linked = link_tool_calls(conversation_calls(_table(spark, folder, "conversations")), schemas)
    return linked.withColumn("errors", F.concat_ws(",", "errors"))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(_table(spark, folder, "documents"), tokenizer_path())


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    sharded = shard_documents(_table(spark, folder, "documents"), weights=[1.0] * 8, grown_by=1.0)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", "grown_shard"
    )


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(_table(spark, folder, "documents"), length=400).drop("kept")


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    sized = stored(documents.select("doc_id", "source", word_count("text").alias("size")))
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    model = train_toxicity(documents, _table(spark, folder, "labels"), max_rows=6000)
    return score_toxicity(documents, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= TOXIC_FROM, 1).otherwise(0).alias("predicted"),
    )


def op9_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5, factor=1.0)


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return dedup_lines(documents, min_chars=40, min_docs=5).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(text, 256).alias("kept_sha256")
    )


def op11_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip_digests(_table(spark, folder, "documents"), tokenizer_path())


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label=moved)


def op13_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return rank_documents(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


QUERIES: dict[str, Build] = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_tool_calls": op3_tool_calls,
    "op4_packing": op4_packing,
    "op5_sharding": op5_sharding,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_nearest": op9_nearest,
    "op10_line_dedup": op10_line_dedup,
    "op11_bpe": op11_bpe,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_lexical": op13_lexical,
}

_TERMS = (
    r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])"
)

_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

SQL: dict[str, str] = {
    "op3_tool_calls": """
WITH RECURSIVE base AS (
    SELECT *, CASE WHEN conv_id IS NOT NULL AND turn IS NOT NULL THEN conv_id || '-' || turn END AS own
    FROM conversations
),
said AS (
    SELECT conv_id, own AS id, count(*) AS n_calls, min({'turn': turn, 'text': text}) AS first
    FROM base WHERE role = 'assistant' GROUP BY conv_id, own
),
calls AS (
    SELECT conv_id, id, n_calls, first.turn AS turn, first.text AS text,
           ['search', 'lookup', 'translate', 'weigh'][coalesce(first.turn % 4, 0) + 1] AS name,
           CASE WHEN id IS NOT NULL AND first.turn >= 1 THEN conv_id || '-' || (first.turn // 2) END AS need
    FROM said
),
answers AS (
    SELECT conv_id, conv_id || '-' || (turn - 1) AS id, count(*) AS n_results,
           min({'turn': turn, 'text': text}) AS result
    FROM base WHERE role = 'user' AND own IS NOT NULL AND turn >= 1 GROUP BY ALL
),
ranked AS (
    SELECT conv_id, id, 0 AS level FROM calls c
    WHERE need IS NULL OR NOT EXISTS (SELECT 1 FROM calls d WHERE d.id = c.need)
    UNION ALL
    SELECT c.conv_id, c.id, r.level + 1 FROM calls c JOIN ranked r ON c.need = r.id
),
linked AS (
    SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.id, a.id) AS id, c.name, c.turn, c.text, r.level,
           a.result.turn AS result_turn, a.result.text AS result_text, c.n_calls IS NULL AS no_call,
           coalesce(c.n_calls, 0) AS n_calls, coalesce(a.n_results, 0) AS n_results, a.id IS NULL AS no_result,
           CASE WHEN c.need IS NOT NULL AND d.id IS NULL THEN 'need:' || c.need END AS unmet
    FROM calls c
    LEFT JOIN calls d ON d.id = c.need
    LEFT JOIN ranked r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.id IS NOT DISTINCT FROM c.id
    FULL JOIN answers a ON a.conv_id = c.conv_id AND a.id = c.id
),
judged AS (
    SELECT *, CASE WHEN no_call THEN 'orphan' WHEN level IS NULL THEN 'cycle' WHEN no_result THEN 'unanswered'
                   WHEN coalesce(result_turn <= turn, false) THEN 'early' ELSE 'linked' END AS status,
           list_sort([x FOR x IN [
               unmet,
               CASE WHEN name = 'weigh' THEN 'unknown_tool' END,
               CASE WHEN name <> 'weigh' AND text IS NULL THEN 'missing:query' END,
               CASE WHEN name = 'lookup' AND text IS NULL THEN 'missing:limit' END,
               CASE WHEN name = 'search' THEN 'missing:page' END,
               CASE WHEN name = 'translate' AND text IS NOT NULL THEN 'type:limit' END
           ] IF x IS NOT NULL]) AS wrong
    FROM linked
)
SELECT conv_id,
       row_number() OVER (
           PARTITION BY conv_id ORDER BY level IS NULL, coalesce(level, 0), coalesce(turn, result_turn) NULLS FIRST,
           id NULLS FIRST) - 1 AS position,
       id AS call_id, name, level, turn AS call_turn, result_turn, n_calls, n_results, status,
       array_to_string(wrong, ',') AS errors,
       '{"arguments":' || CASE WHEN no_call THEN 'null' WHEN text IS NULL THEN '{}'
           ELSE '{"limit":' || length(text) || ',"query":' || to_json(text) || '}' END
       || ',"call_id":' || coalesce(to_json(id), 'null') || ',"errors":' || to_json(wrong)
       || ',"name":' || coalesce(to_json(name), 'null') || ',"result":' || coalesce(to_json(result_text), 'null')
       || ',"status":"' || status || '"}' AS json
FROM judged
""",
    "op7_mixing": f"""
WITH sized AS (SELECT doc_id, source, {_WORDS}::BIGINT AS size FROM documents),
keyed AS (
    SELECT *, CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k
    FROM sized
),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
    FROM keyed GROUP BY source
),
weighted AS (
    SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(rank - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap,
           1.5::DOUBLE * sum(source_size) OVER () AS total
    FROM sources
),
levels AS (
    SELECT *, sum(cap) OVER below + cap / weight * (sum(weight) OVER () - sum(weight) OVER below) <= total AS is_full
    FROM weighted WINDOW below AS (ORDER BY cap / weight RANGE UNBOUNDED PRECEDING)
),
targets AS (
    SELECT source, source_size,
           CASE WHEN is_full THEN cap ELSE least(cap,
               (total - sum(CASE WHEN is_full THEN cap ELSE 0.0::DOUBLE END) OVER ())
               / sum(CASE WHEN is_full THEN 0.0::DOUBLE ELSE weight END) OVER () * weight) END AS target
    FROM levels
),
budgets AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs,
           floor(target)::BIGINT AS budget
    FROM targets
),
alike AS (
    SELECT source, k, size, count(*) AS n,
           sum(count(*) * size) OVER (PARTITION BY source ORDER BY k, size) - count(*) * size AS before
    FROM keyed GROUP BY source, k, size
)
SELECT d.doc_id, d.size, b.source_size, b.target,
       (b.epochs * d.size
        + least(d.size, greatest(0, b.budget - b.epochs * b.source_size - a.before) // a.n))::BIGINT AS taken
FROM keyed d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
JOIN alike a ON a.source IS NOT DISTINCT FROM d.source AND a.k = d.k AND a.size = d.size
""",
    "op9_nearest": """
WITH good AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x FOR x IN embedding IF x <> 0]) > 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
    FROM good q JOIN good c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
    WHERE q.vec_id % 50 = 0
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id)::INTEGER AS rank
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op10_line_dedup": r"""
WITH numbered AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
    SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS place
    FROM numbered
),
keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
),
often AS (
    SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT rid) >= 5
),
marked AS (
    SELECT k.*, o.key IS NOT NULL AND o.last IS DISTINCT FROM k.doc_id AS gone
    FROM keyed k LEFT JOIN often o USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid
""",
    "op12_hard_negatives": """
WITH good AS (
    SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
),
scored AS (
    SELECT a.row AS anchor, a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS alike,
           list_inner_product(a.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
    FROM good a JOIN good c ON c.row <> a.row AND len(c.v) = len(a.v)
    WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place FROM scored WHERE alike
),
ranked AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank
    FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.alike
    WHERE p.place <= 5 AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
""",
    "op13_lexical": f"""
WITH said AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS terms FROM documents),
items AS (SELECT row_number() OVER () AS item, item_id, list_distinct({_TERMS}) AS terms FROM benchmark),
asked AS (SELECT item, item_id, unnest(terms) AS term FROM items),
totals AS (
    SELECT count(*) FILTER (len(terms) > 0) AS n_docs, coalesce(sum(len(terms)), 0)::BIGINT AS n_terms FROM said
),
flat AS (SELECT rid, unnest(terms) AS term FROM said),
uses AS (SELECT rid, term, count(*) AS tf FROM flat WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM uses, totals GROUP BY term
),
sized AS (SELECT rid, doc_id, 100 - 90 + ((90 * len(terms) * n_docs) // n_terms) AS m FROM said, totals WHERE len(terms) > 0),
scored AS (
    SELECT item, any_value(item_id) AS item_id, rid, any_value(doc_id) AS doc_id,
           sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM asked JOIN uses USING (term) JOIN weights USING (term) JOIN sized USING (rid) GROUP BY item, rid
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""",
}
