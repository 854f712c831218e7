"""Mixing sources to target weights: hash-random order, bucketed prefix sums, exact budget cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.llm.common import WORD, broadcast_checked, source_key, stored

KEY_BITS = 60
BUCKET_BITS = 12


def random_key(doc_id: str, seed: str) -> Column:
    """60 hash bits of the seed and the document id, the position of a document in its source."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def mix_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """Target of each source: share * all sizes, dealt by weight, at most max_epochs * own size.

    `sizes` has one row per source (source, src, source_size). Weights repeat over the sources in
    code-point order, null last. What a full source can't take is dealt again by weight: every
    source gets min(cap, level * weight), and the level follows from prefix sums over the sources
    in the order in which they fill up. Only rows of sources meet here, never documents.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    fill = Window.orderBy("ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cycle = F.array(*[F.lit(float(weight)) for weight in weights])
    caps = (
        sizes.withColumn("rank", F.row_number().over(ordered))
        .withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("caps_below", F.sum("cap").over(fill))
        .withColumn("weight_below", F.sum("weight").over(fill))
        .withColumn(
            "full",
            F.col("caps_below") + F.col("ratio") * (F.col("all_weight") - F.col("weight_below")) <= F.col("total"),
        )
    )
    spare = F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    return caps.select(
        "source",
        "src",
        "source_size",
        F.when(F.col("full"), F.col("cap"))
        .otherwise(F.least(F.col("cap"), spare / open_weight * F.col("weight")))
        .alias("target"),
    )


def mix_cuts(sized: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """One row per source: its target, whole epochs, and the place where its last epoch ends.

    `sized` has source, src, key and size per document. Bucket sums over the key's leading bits
    give each source's prefix sums; only the bucket in which a budget ends is sorted. Documents of
    equal key and size are one entry there, so repeated rows are never sorted one by one.
    """
    sums = sized.groupBy("source", "src").agg(F.sum("size").alias("source_size"))
    targets = broadcast_checked(
        stored(
            mix_targets(sums, weights, share, max_epochs)
            .withColumn("budget", F.floor("target").cast("long"))
            .withColumn(
                "epochs",
                F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size")))
                .otherwise(0)
                .cast("long"),
            )
            .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        )
    )
    bucketed = sized.withColumn("bucket", F.shiftright("key", KEY_BITS - BUCKET_BITS))
    running = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = (
        bucketed.groupBy("src", "bucket")
        .agg(F.sum("size").alias("words"))
        .withColumn("until", F.sum("words").over(running))
        .join(targets.select("src", "rest"), "src")
        .where((F.col("until") - F.col("words") <= F.col("rest")) & (F.col("rest") < F.col("until")))
        .select("src", "bucket", (F.col("rest") - (F.col("until") - F.col("words"))).alias("left"))
    )
    inside = Window.partitionBy("src").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        bucketed.join(broadcast_checked(stored(buckets)), ["src", "bucket"])
        .groupBy("src", "left", "key", "size")
        .agg(F.count("*").alias("alike"))
        .withColumn("until", F.sum(F.col("size") * F.col("alike")).over(inside))
        .where(
            (F.col("until") - F.col("size") * F.col("alike") <= F.col("left")) & (F.col("left") < F.col("until"))
        )
        .select(
            "src",
            F.col("key").alias("cut_key"),
            F.col("size").alias("cut_size"),
            F.floor((F.col("left") - F.col("until") + F.col("size") * F.col("alike")) / F.col("alike"))
            .cast("long")
            .alias("cut_words"),
        )
    )
    return stored(targets.join(cut, "src", "left"))


def mix(
    sized: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """All rows of `sized` (doc_id, source, size, ...) with `source_size`, `target` and `taken`.

    `taken` is the number of words that the mix takes. Documents stand in hash-random order within
    their source. Whole epochs take every word; the last epoch takes documents in order until the
    budget, the document at the cut in part (equal documents there share evenly). So a source takes
    its target, less under one word for each copy at the cut. Documents of size 0 are never taken. A null
    source is a source. Documents with equal or null ids stand together. Input columns named like
    the results are replaced; an empty table stays empty.
    """
    others = [name for name in sized.columns if name not in ("source_size", "target", "taken")]
    keyed = (
        sized.select(*[F.col(f"`{name}`") for name in others])
        .withColumn("__src", source_key("source"))
        .withColumn("__key", random_key("doc_id", seed))
    )
    cuts = mix_cuts(
        keyed.select("source", F.col("__src").alias("src"), F.col("__key").alias("key"), "size"),
        weights,
        share,
        max_epochs,
    ).withColumnsRenamed({name: f"__{name}" for name in ("src", "epochs", "cut_key", "cut_size", "cut_words")})
    at_key = F.col("__key") == F.col("__cut_key")
    last = (
        F.when(F.col("__cut_key").isNull(), 0)
        .when((F.col("__key") < F.col("__cut_key")) | (at_key & (F.col("size") < F.col("__cut_size"))), F.col("size"))
        .when(at_key & (F.col("size") == F.col("__cut_size")), F.col("__cut_words"))
        .otherwise(0)
    )
    return (
        keyed.join(broadcast_checked(cuts.drop("source", "budget", "rest")), "__src")
        .withColumn("taken", (F.col("__epochs") * F.col("size") + last).cast("long"))
        .drop("__src", "__key", "__epochs", "__cut_key", "__cut_size", "__cut_words")
    )


def mixed_documents(documents: DataFrame, **options: object) -> DataFrame:
    """The mix as whole documents: each one as often as the rounded share of its words taken.

    Columns are those of `documents`; a column named `size` is kept under its name.
    """
    packed = documents.select(
        "doc_id",
        "source",
        word_count("text").alias("size"),
        F.struct(*[F.col(f"`{name}`") for name in documents.columns]).alias("__document"),
    )
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return (
        mix(packed, **options)
        .where(times > 0)
        .select("__document", F.explode(F.sequence(F.lit(1), times)).alias("__copy"))
        .select("__document.*")
    )
