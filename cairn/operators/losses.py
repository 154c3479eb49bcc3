"""Classification and segmentation losses over tables of logits."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.probability import focal_factor, log_softmax, one_hot, pick, softmax, total

IGNORE = -100


def literal(weights: list[float] | None, classes: Column) -> Column:
    return F.array(*[F.lit(float(w)) for w in weights]) if weights else F.array_repeat(F.lit(1.0), classes)


def row_terms(weights: list[float] | None = None, ignore: int = IGNORE) -> dict[str, Column]:
    """live, weight, nll (weighted) and smooth (the sum of -w_c * logp_c) of a row with logits and y."""
    logp, y = log_softmax(F.col("logits")), F.col("y")
    w = literal(weights, F.size("logits"))
    live = y != ignore
    return {
        "live": live,
        "weight": F.when(live, pick(w, y)).otherwise(0.0),
        "nll": F.when(live, -pick(logp, y) * pick(w, y)).otherwise(0.0),
        "smooth": F.when(live, -total(F.zip_with(logp, w, lambda a, b: a * b))).otherwise(0.0),
    }


def cross_entropy(rows: DataFrame, weights=None, smoothing: float = 0.0, ignore: int = IGNORE, by: tuple[str, ...] = ()) -> DataFrame:
    """loss: sum of weighted losses over the sum of weights, with label smoothing; NaN when every row is ignored."""
    terms = row_terms(weights, ignore)
    sums = rows.groupBy(*by).agg(*[F.sum(terms[c]).alias(c) for c in ("weight", "nll", "smooth")], F.max(F.size("logits")).alias("classes"))
    mixed = (1 - smoothing) * F.col("nll") + smoothing / F.col("classes") * F.col("smooth")
    return sums.select(*by, F.when(F.col("weight") > 0, mixed / F.col("weight")).otherwise(F.lit(float("nan"))).alias("loss"))


def focal_rows(rows: DataFrame, gamma: float = 2.0, weights=None, ignore: int = IGNORE) -> DataFrame:
    """Adds loss: the weighted cross-entropy times the focal factor, which has the weight inside; 0 for ignored rows."""
    ce = row_terms(weights, ignore)["nll"]
    return rows.withColumn("loss", focal_factor(ce, gamma) * ce)


def focal(rows: DataFrame, gamma: float = 2.0, weights=None, reduction: str = "mean", ignore: int = IGNORE, by: tuple[str, ...] = ()) -> DataFrame:
    """loss by reduction; the mean counts ignored rows too."""
    scored = focal_rows(rows, gamma, weights, ignore)
    if reduction == "none":
        return scored
    if reduction not in ("mean", "sum"):
        raise ValueError(f"unknown reduction: {reduction}")
    return scored.groupBy(*by).agg((F.avg if reduction == "mean" else F.sum)("loss").alias("loss"))


def dice(voxels: DataFrame, classes: int, background: bool = False, smooth: float = 1e-5) -> DataFrame:
    """loss: 1 - the mean over classes of the soft overlap of all voxels together; 0 when no class is left."""
    first = 0 if background else 1
    if first >= classes:
        return voxels.agg(F.lit(0.0).alias("loss"))
    probs, truth = softmax(F.col("logits")), one_hot(F.col("y"), classes)
    pairs = voxels.select(F.posexplode(F.arrays_zip(probs.alias("p"), truth.alias("g"))).alias("c", "v")).where(F.col("c") >= first)
    sums = pairs.groupBy("c").agg(F.sum(F.col("v.p") * F.col("v.g")).alias("both"), F.sum("v.p").alias("p"), F.sum("v.g").alias("g"))
    return sums.agg((1 - F.avg((2 * F.col("both") + smooth) / (F.col("p") + F.col("g") + smooth))).alias("loss"))


def dice_ce(voxels: DataFrame, classes: int, dice_weight: float = 1.0, ce_weight: float = 1.0, background: bool = False, smooth: float = 1e-5, weights=None) -> DataFrame:
    """loss: weighted sum of dice and cross-entropy."""
    one = dice(voxels, classes, background, smooth).withColumnRenamed("loss", "d")
    two = cross_entropy(voxels, weights).withColumnRenamed("loss", "c")
    return one.crossJoin(two).select((dice_weight * F.col("d") + ce_weight * F.col("c")).alias("loss"))  # one row each


def bucketed(rows: DataFrame, order: str, buckets: int = 1024) -> DataFrame:
    """Adds bucket_: ranges of the number `order` that hold about as many rows each, wherever the numbers lie.

    The edges are approximate quantiles, found in one pass; a row's bucket is looked up in them. Null orders fall away.
    """
    keyed = rows.where(F.col(order).isNotNull()).withColumn("order_", F.col(order).cast("double"))
    shares = [i / buckets for i in range(1, buckets)]
    edges = sorted({e for e in keyed.approxQuantile("order_", shares, 1 / (4 * buckets)) if math.isfinite(e)})
    places = Bucketizer(splits=[-math.inf, *(edges or [0.0]), math.inf], inputCol="order_", outputCol="bucket_")
    return places.transform(keyed).drop("order_")


def batches(rows: DataFrame, order: str, size: int = 64, drop_last: bool = False, buckets: int = 1024) -> DataFrame:
    """Adds batch: consecutive rows by a unique number `order`, `size` in each; `drop_last` leaves a short last one out.

    Rows are placed by the running counts of ranges with about equally many rows (`bucketed`), so no task holds all
    rows, however the numbers are spread.
    """
    keyed = bucketed(rows, order, buckets)
    cells = keyed.groupBy("bucket_").agg(F.count("*").alias("n_"))
    before = Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.select("bucket_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"), F.sum("n_").over(whole).alias("all_"))
    inside = Window.partitionBy("bucket_").orderBy(order)
    numbered = keyed.withColumn("rank_", F.row_number().over(inside)).join(cells, "bucket_")
    numbered = numbered.withColumn("batch", F.floor((F.col("before_") + F.col("rank_") - 1) / size))
    if drop_last:
        numbered = numbered.where((F.col("batch") + 1) * size <= F.col("all_"))
    return numbered.select(*rows.columns, "batch")


def epoch_loss(rows: DataFrame, order: str, size: int = 64, drop_last: bool = False, loss=cross_entropy, **options) -> DataFrame:
    """loss: the mean of the losses of batches, each counted alike; 0 without batches."""
    each = loss(batches(rows, order, size, drop_last), by=("batch",), **options)
    return each.agg(F.coalesce(F.avg("loss"), F.lit(0.0)).alias("loss"))


CLASSIFICATION = {"ce": "ce", "cross_entropy": "ce", "weighted_ce": "weighted_ce", "weighted_cross_entropy": "weighted_ce", "focal": "focal"}
SEGMENTATION = {"dice": "dice", "dice_ce": "dice_ce", "focal_dice": "dice_ce"}


def classification_loss(name: str, weights=None, gamma: float = 2.0):
    """A function of (rows, by) by name."""
    kind = CLASSIFICATION.get(name.lower())
    if kind is None:
        raise ValueError(f"unknown loss: {name}")
    if kind == "focal":
        return lambda rows, by=(): focal(rows, gamma, weights, by=by)
    return lambda rows, by=(): cross_entropy(rows, weights if kind == "weighted_ce" else None, by=by)


def segmentation_loss(name: str, classes: int, **options):
    """A function of voxels by name; focal_dice is another name of dice_ce."""
    kind = SEGMENTATION.get(name.lower())
    if kind is None:
        raise ValueError(f"unknown segmentation loss: {name}")
    return lambda voxels: (dice if kind == "dice" else dice_ce)(voxels, classes, **options)
