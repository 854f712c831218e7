"""Tool-call linking in DataFrame operations: join, topological order, validation, canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.llm.common import broadcast_checked, stored
from logloom.session import scratch_folder

MESSAGE_COLUMNS = """conv_id long, turn long, role string, text string,
    tool_calls array<struct<id: string, name: string, arguments: string, after: array<string>>>,
    tool_call_id string"""
SCHEMA_COLUMNS = "tool string, parameter string, type string, required boolean"
# Levels and distances beyond this only arise on cycles, where they double each round.
FAR = 1 << 60


def find_calls(messages: DataFrame) -> DataFrame:
    """One row per (conv_id, id): the first call by turn and place, and how many have the id."""
    calls = messages.select("conv_id", "turn", F.posexplode("tool_calls").alias("place", "call"))
    first = F.min(F.struct("turn", "place", "call.name", "call.arguments", "call.after")).alias("first")
    return calls.groupBy("conv_id", F.col("call.id").alias("id")).agg(first, F.count("*").alias("n_calls"))


def find_results(messages: DataFrame) -> DataFrame:
    """One row per (conv_id, id): the first result by turn, and how many there are."""
    return (
        messages.where((F.col("role") == "tool") & F.col("tool_call_id").isNotNull())
        .groupBy("conv_id", F.col("tool_call_id").alias("id"))
        .agg(F.min(F.struct("turn", "text")).alias("result"), F.count("*").alias("n_results"))
    )


def _redirected(waiting: DataFrame, through: DataFrame) -> DataFrame:
    """`waiting` with each edge to a `need` of `through` replaced by what is known of that need.

    The need's level is the larger of `reach` and, unless `to` is null, the level of `to` plus
    `further`. Edges of one call to the same need become one, the longest.
    """
    edges = waiting.select("conv_id", "id", "base", F.explode("edges").alias("edge")).select(
        "conv_id", "id", "base", "edge.*"
    )
    met = F.col("reach").isNotNull()
    far = F.least(F.col("far") + F.when(met, F.col("further")).otherwise(0), F.lit(FAR))
    base = F.greatest("base", F.when(met, F.least(F.col("reach") + F.col("far"), F.lit(FAR))))
    need = F.when(met, F.col("to")).otherwise(F.col("need"))
    moved = edges.join(through, ["conv_id", "need"], "left").select(
        "conv_id", "id", base.alias("base"), need.alias("need"), far.alias("far")
    )
    longest = moved.groupBy("conv_id", "id", "need").agg(F.max("base").alias("base"), F.max("far").alias("far"))
    edge = F.when(F.col("need").isNotNull(), F.struct("need", "far"))
    return longest.groupBy("conv_id", "id").agg(F.max("base").alias("base"), F.collect_list(edge).alias("edges"))


def topological_levels(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, id, level): 0 without needs, else one more than the highest level needed.

    `needs` has (conv_id, id, need), both ends being nodes. A call's level is the largest of `base`
    and, over its edges, the needed call's level plus `far`. Each round puts in the levels found
    last and then doubles chains: an edge to a call that waits for one call only goes on to that
    call. A chain of n calls so takes about log2(n) rounds, whatever side needs it has that are
    known; only calls that wait for two unknown ones at each step take a round a level. Calls on or
    behind a cycle get no row.
    """
    keys = ["conv_id", "id"]
    folder = scratch_folder(nodes.sparkSession)
    edge = F.struct("need", F.lit(1).cast("long").alias("far"))
    waiting = stored(needs.groupBy(*keys).agg(F.lit(0).cast("long").alias("base"), F.collect_set(edge).alias("edges")))
    newly = stored(nodes.join(waiting, keys, "left_anti").select(*keys, F.lit(0).cast("long").alias("level")))
    while not newly.isEmpty():
        newly.write.mode("append").parquet(folder)
        known = newly.select("conv_id", F.col("id").alias("need"), F.col("level").alias("reach"))
        none = (F.lit(None).cast("string").alias("to"), F.lit(None).cast("long").alias("further"))
        told = stored(_redirected(waiting, known.select("*", *none)))
        newly = told.where(F.size("edges") == 0).select(*keys, F.col("base").alias("level"))
        rest = told.where(F.size("edges") > 0)
        single = rest.where(F.size("edges") == 1).select(
            "conv_id",
            F.col("id").alias("need"),
            F.col("base").alias("reach"),
            F.col("edges")[0]["need"].alias("to"),
            F.col("edges")[0]["far"].alias("further"),
        )
        waiting = stored(_redirected(rest, single))
    newly.limit(0).write.mode("append").parquet(folder)
    return nodes.sparkSession.read.schema(newly.schema).parquet(folder).select(*keys, F.col("level").cast("int"))


def kind_of(schema: Column) -> Column:
    """JSON type of a value from its variant schema."""
    return (
        F.when(schema == "STRING", "string")
        .when(schema.rlike(r"^(BIGINT|DECIMAL\(\d+,\s*0\))$"), "integer")
        .when(schema.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .otherwise("null")
    )


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Adds `parsed`, the arguments as a variant, and `errors`, sorted texts; none means valid.

    malformed: no JSON object (a repeated key counts as such); unknown_tool: no schema; missing:P,
    unknown:P and type:P for parameters. A whole number is a `number` too; a JSON null has no type
    of its own and is wrong for every parameter.
    """
    tools = schemas.groupBy(F.col("tool").alias("name")).agg(
        F.array_sort(F.collect_set(F.struct("parameter", "type", "required"))).alias("rules")
    )
    parsed = calls.withColumn("parsed", F.try_parse_json("arguments"))
    is_object = F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False))
    kinds = F.expr("transform_values(cast(parsed AS map<string, variant>), (k, v) -> schema_of_variant(v))")
    given = F.when(is_object, kinds)
    joined = parsed.withColumn("given", given).join(broadcast_checked(stored(tools)), "name", "left")

    def labelled(kind: str, names: Column) -> Column:
        return F.transform(names, lambda name: F.concat(F.lit(f"{kind}:"), name))

    def wrong(rule: Column) -> Column:
        kind = kind_of(F.element_at("given", rule["parameter"]))
        fits = (kind == rule["type"]) | ((kind == "integer") & (rule["type"] == "number"))
        return F.map_contains_key("given", rule["parameter"]) & ~fits

    def names(keep) -> Column:
        return F.transform(F.filter("rules", keep), lambda rule: rule["parameter"])

    known = F.transform("rules", lambda rule: rule["parameter"])
    missing = names(
        lambda rule: F.coalesce(rule["required"], F.lit(False)) & ~F.map_contains_key("given", rule["parameter"])
    )
    errors = (
        F.when(F.col("given").isNull(), F.array(F.lit("malformed")))
        .when(F.col("rules").isNull(), F.array(F.lit("unknown_tool")))
        .otherwise(
            F.array_sort(
                F.concat(
                    labelled("missing", missing),
                    labelled("unknown", F.array_except(F.map_keys("given"), known)),
                    labelled("type", names(wrong)),
                )
            )
        )
    )
    return joined.withColumn("errors", errors).drop("given", "rules")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds `position` from 0 in each conversation: by level, turn and id, rows without level last.

    Rows are dealt to ranges of that order and ranked in each, then shifted by the sizes of the
    ranges before, so one very long conversation is spread over many tasks, with turns or without.
    """
    cut = rows.withColumn("last", F.col("level").isNull().cast("int"))
    cut = cut.withColumn("rank_level", F.coalesce("level", F.lit(0)))
    ordered = stored(cut).repartitionByRange("conv_key", "last", "rank_level", "sort_turn", "id")
    cut = stored(ordered.withColumn("block", F.spark_partition_id()))
    keys = ["conv_key", "last", "rank_level", "block"]
    before = Window.partitionBy("conv_key").orderBy(*keys[1:]).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        cut.groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    inside = Window.partitionBy(*keys).orderBy("sort_turn", "id")
    ranked = cut.withColumn("place", F.row_number().over(inside) - 1)
    return ranked.join(shifts, keys).withColumn("position", (F.col("shift") + F.col("place")).cast("long"))


def link_tool_calls(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """Every tool call with its result, in an order in which each call follows what it needs.

    `messages` has MESSAGE_COLUMNS (a result is a message of role "tool" with tool_call_id), and
    `schemas` SCHEMA_COLUMNS. One row per identifier in a conversation: conv_id, position, call_id,
    name, level, call_turn, result_turn, n_calls, n_results, status, errors (array), and json, the
    canonical form: keys sorted at every depth, no blanks, null written out.

    Calls and results meet in a hash join by conversation and identifier. status: linked;
    unanswered (no result); orphan (a result without call); early (the result's turn isn't after
    the call's); cycle (needs itself through others). Of repeated identifiers the first call and
    the first result count, and their numbers are reported. Calls without id never link; a
    conversation's calls without id are one row. `after` ids that no call has are errors
    (need:ID) and don't order anything. Null conversations are one conversation.
    Other columns of the inputs are ignored; empty inputs give no rows.
    """
    chosen = messages.select("conv_id", "turn", "role", "text", "tool_calls", "tool_call_id")
    found = find_calls(chosen).select("conv_id", "id", "first.*", "n_calls")
    conv_key = F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("conv"))
    calls = stored(
        validated(found, schemas)
        .withColumn("parsed", F.to_json("parsed"))
        .withColumn("conv", F.to_json(conv_key))
        .withColumn("key", F.coalesce(F.concat(F.lit("i"), "id"), F.lit("n")))
    )
    results = find_results(chosen).withColumn("conv", F.to_json(conv_key)).withColumn("key", F.concat(F.lit("i"), "id"))
    asked = calls.select("conv", "key", F.explode(F.array_distinct("after")).alias("after")).where("after IS NOT NULL")
    asked = asked.withColumn("need", F.concat(F.lit("i"), "after"))
    present = calls.select("conv", F.col("key").alias("need"))
    met = asked.join(present, ["conv", "need"])
    needs = met.select(F.col("conv").alias("conv_id"), F.col("key").alias("id"), "need")
    unmet = (
        asked.join(present, ["conv", "need"], "left_anti")
        .groupBy("conv", "key")
        .agg(F.array_sort(F.collect_set(F.concat(F.lit("need:"), "after"))).alias("unmet"))
    )
    nodes = calls.select(F.col("conv").alias("conv_id"), F.col("key").alias("id"))
    levels = topological_levels(nodes, needs).withColumnsRenamed({"conv_id": "conv", "id": "key"})
    answers = results.select("conv", "key", "conv_id", "id", "result", "n_results").hint("shuffle_hash")
    linked = (
        calls.join(levels, ["conv", "key"], "left")
        .join(unmet, ["conv", "key"], "left")
        .withColumnsRenamed({"conv_id": "call_conv", "id": "call_key"})
        .join(answers, ["conv", "key"], "full")
        .withColumn("conv_key", F.col("conv"))
        .withColumn("conv_id", F.coalesce("call_conv", "conv_id"))
        .withColumn("id", F.coalesce("call_key", "id"))
        .withColumn("sort_turn", F.coalesce("turn", "result.turn"))
    )
    status = (
        F.when(F.col("n_calls").isNull(), "orphan")
        .when(F.col("level").isNull(), "cycle")
        .when(F.col("result").isNull(), "unanswered")
        .when(F.coalesce(F.col("result.turn") <= F.col("turn"), F.lit(False)), "early")
        .otherwise("linked")
    )
    none = F.array().cast("array<string>")
    rows = numbered(
        linked.withColumn("status", status).withColumn(
            "errors", F.array_sort(F.concat(F.coalesce("errors", none), F.coalesce("unmet", none)))
        )
    )
    content = F.struct(
        F.try_parse_json("parsed").alias("arguments"),
        F.col("id").alias("call_id"),
        F.col("errors"),
        F.col("name"),
        F.col("result.text").alias("result"),
        F.col("status"),
    )
    return rows.select(
        "conv_id",
        "position",
        F.col("id").alias("call_id"),
        "name",
        "level",
        F.col("turn").alias("call_turn"),
        F.col("result.turn").alias("result_turn"),
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        "status",
        "errors",
        F.to_json(content, {"ignoreNullFields": "false"}).alias("json"),
    )
