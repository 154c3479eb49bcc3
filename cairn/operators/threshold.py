"""Threshold sweeps and the choice of a threshold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.probability import grid, is_close
from cairn.operators.metrics import histogram, ratio

METRICS = ("youden_j", "f1", "balanced_accuracy")


def reached(prob: Column, points: list[float]) -> Column:
    """How many grid points (as float32, ascending and even) a score reaches: a guess by division, set right by one either way."""
    if not points:
        return F.lit(0)
    levels = F.array(*[F.lit(float(np.float32(p))).cast("float") for p in points])
    step = (points[-1] - points[0]) / max(len(points) - 1, 1) or 1.0
    guess = F.greatest(F.lit(0), F.least(F.lit(len(points)), F.floor((prob - points[0]) / step) + 1)).cast("int")
    more = F.coalesce((prob >= F.try_element_at(levels, guess + 1)).cast("int"), F.lit(0))
    less = F.coalesce((prob < F.try_element_at(levels, F.when(guess > 0, guess))).cast("int"), F.lit(0))
    return guess + more - less


def curve(scores: DataFrame, low: float = 0.05, high: float = 0.95, steps: int = 181, by: tuple[str, ...] = ()) -> DataFrame:
    """by, step, threshold, tn, fp, fn, tp, youden_j, f1, balanced_accuracy for each grid point (of each group).

    A null or NaN score is an error; rows whose y is neither 0 nor 1 don't count.
    """
    return curve_of(histogram(scores, by), low, high, steps, by)


def curve_of(counted: DataFrame, low: float = 0.05, high: float = 0.95, steps: int = 181, by: tuple[str, ...] = ()) -> DataFrame:
    """The curve from a histogram: each score is binned once; the sweep is suffix sums over at most steps + 1 counts a group."""
    points = grid(low, high, steps)
    binned = counted.select(*by, reached(F.col("prob"), points).alias("k"), "p", "n").groupBy(*by, "k").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    held = binned.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("p", "n")))).alias("held"))
    places = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(p).cast("double").alias("threshold")) for i, p in enumerate([None, *points])])
    rows = held.select(*by, "held", F.explode(places).alias("at")).select(*by, "at.*", F.try_element_at("held", F.col("at.step")).alias("cell"))
    onward = Window.partitionBy(*by).orderBy("step").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for c, out in (("p", "tp"), ("n", "fp")):
        rows = rows.withColumn(out, F.sum(F.coalesce(f"cell.{c}", F.lit(0))).over(onward))
    rows = rows.withColumn("fn", F.first("tp").over(whole) - F.col("tp")).withColumn("tn", F.first("fp").over(whole) - F.col("fp"))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    tpr, tnr = ratio(tp, tp + fn), ratio(tn, tn + fp)
    present = (tp + fn > 0).cast("int") + (tn + fp > 0).cast("int")
    return rows.where("step > 0").select(
        *by, "step", "threshold", "tn", "fp", "fn", "tp", (tpr + tnr - 1).alias("youden_j"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.when(present > 0, (tpr + tnr) / present).otherwise(F.lit(float("nan"))).alias("balanced_accuracy"),
    )


def choose(points: DataFrame, metric: str = "youden_j", by: tuple[str, ...] = ()) -> DataFrame:
    """by, threshold, score: the grid is walked upward; a point takes over when its score is greater, or close to the best
    and the point nearer to 0.5. Starts from (0.5, -inf)."""
    if metric not in METRICS:
        raise ValueError(f"unknown threshold metric: {metric}")
    walk = F.sort_array(F.collect_list(F.struct("step", F.col("threshold").alias("t"), F.col(metric).alias("s"))))
    state = lambda t, s: F.struct(t.alias("t"), s.alias("s"))

    def take(best, x):
        nearer = F.abs(x["t"] - 0.5) < F.abs(best["t"] - 0.5)
        better = ~F.isnan(x["s"]) & ((x["s"] > best["s"]) | (is_close(x["s"], best["s"]) & nearer))
        return F.when(better, state(x["t"], x["s"])).otherwise(best)

    start = state(F.lit(0.5), F.lit(float("-inf")))
    return points.groupBy(*by).agg(F.aggregate(walk, start, take).alias("best")).select(*by, F.col("best.t").alias("threshold"), F.col("best.s").alias("score"))


def optimize(scores: DataFrame, metric: str = "youden_j", low: float = 0.05, high: float = 0.95, steps: int = 181, by: tuple[str, ...] = ()) -> DataFrame:
    """The threshold of each group (of all rows without groups), from one scan of the scores."""
    return choose(curve(scores, low, high, steps, by), metric, by)
