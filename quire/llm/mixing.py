"""Mixing sources to target weights: repeat each document by the rate of its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut, small

WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """``sizes`` (source, source_size), one row per source. Adds ``target``.

    The sources, by code point with null last, weigh ``weights`` in turn and share ``share``
    of all sizes; a target stops at ``cap`` times the size of its source, and the excess is
    shared again by weight. In order of cap per weight the capped sources are a prefix, so the
    level at which the rest shares follows from two running sums. One row per source."""
    # Spark compares strings by their UTF-8 bytes, which is code point order.
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)
    ranked = sizes.select("source", "source_size", weight.alias("weight")).withColumn(
        "ratio", F.lit(cap) * F.col("source_size") / F.col("weight")
    )
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.lit(share) * F.sum("source_size").over(total) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ) / (F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = ranked.withColumn("level", level)
    # From the first source that is not capped on, the level falls: its own is the shared one.
    shared = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(total)
    return levels.withColumn("shared", shared).select(
        "source",
        "source_size",
        F.when(F.col("ratio") > F.col("level"), F.col("weight") * F.col("shared"))
        .otherwise(F.lit(cap) * F.col("source_size"))
        .cast("double")
        .alias("target"),
    )


def copies(rate: Column, ident: Column, seed: int = 7) -> Column:
    """floor(rate) copies, and one more with the probability of the fraction: a draw from the
    hash of the identity, so reruns and other partitionings agree."""
    draw = F.pmod(F.xxhash64(F.lit(seed), ident), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix_rates(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS, seed: int = 7, name: str = "mix") -> DataFrame:
    """``docs`` with size, source_size, target and n_copies in the struct ``name``.

    Sizes are summed per source before the shuffle, so a source with a third of all rows is
    one row of each task. Null or empty texts have size 0 and follow the rate of their source;
    a null source is a source of its own, last in order; repeated rows draw alike."""
    sized = docs.withColumn("__size", word_count())
    sizes = sized.groupBy("source").agg(F.sum("__size").alias("source_size"))
    targets = small(cut(source_targets(sizes, share, cap, weights), "targets"))
    targets = targets.select(*[F.col(c).alias(f"__{c}") for c in targets.columns])
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["__source"]), "left")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    mix = F.struct(
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        copies(rate, joined["doc_id"], seed).alias("n_copies"),
    )
    return joined.select(*docs.columns, mix.alias(name))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as its rate and draw say, same columns."""
    rated = mix_rates(docs, name="__mix", **options)
    again = F.explode(F.sequence(F.lit(1), F.col("__mix.n_copies").cast("int")))
    return rated.where("__mix.n_copies > 0").select(*docs.columns, again.alias("__copy")).drop("__copy")
