"""Mixing sources to target weights (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm._io import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Sources up to this many are broadcast (under 1 MB); more are joined by shuffle, where Spark splits hot sources.
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=(3, 2), cap: int = 2) -> DataFrame:
    """Words each source shall give.

    `sizes`: source, source_size, one row per source. Sources by code point (null last) weigh `weights`, repeating,
    and share share[0]/share[1] of all words; a target stops at `cap` times its source and the excess is dealt again
    by weight. With the sources ordered by size per weight those that stop are the first ones, so one running sum
    over the sources gives the fixed point of dealing again and again. All sums are whole numbers: exact and
    independent of order. The windows hold one row per source, after aggregation.
    """
    top, bottom = share
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    place = ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    ranked = (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place).cast("long"))
        .withColumn("rank", F.row_number().over(by_ratio))
        .withColumn("left_over", top * F.sum("source_size").over(whole) - bottom * cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("left_weight", bottom * F.sum("weight").over(onward))
        .withColumn("stops", F.col("weight") * F.col("left_over") / F.col("left_weight") > cap * F.col("source_size"))
    )
    going = F.when(~F.col("stops"), F.col("rank"))
    level = F.min_by(F.struct("left_over", "left_weight"), going).over(whole)
    shared = F.col("weight") * F.col("level.left_over") / F.col("level.left_weight")
    target = F.when(F.col("stops"), (cap * F.col("source_size")).cast("double")).otherwise(shared)
    return ranked.withColumn("level", level).select("source", "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, share=(3, 2), cap: int = 2) -> DataFrame:
    """Adds size, source_size, target and copies to the columns of `docs`.

    A document is emitted floor(rate) times, and once more with probability equal to the fraction, by a uniform from
    md5(seed, doc_id); rate = target / source_size of its source. Null text has size 0; a source without words has
    target 0 and its documents 0 copies; rows without an id draw by their text, and rows that repeat an id (or,
    without one, a text) share a draw. An empty table gives no rows. Columns of docs named size, source_size, target or
    copies are replaced.
    """
    made = ("size", "source_size", "target", "copies")
    docs = docs.drop(*made).withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(sizes, weights, share, cap).withColumnRenamed("source", "mix_source").drop("weight"))
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    mixed = docs.join(targets, docs["source"].eqNullSafe(targets["mix_source"]), "left").drop("mix_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), own))
    uniform = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return mixed.withColumn("copies", (F.floor(rate) + (uniform < rate - F.floor(rate)).cast("long")).cast("int"))
