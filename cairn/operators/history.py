"""Best epoch and early stop over a history table (a row for each epoch)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def improvements(history: DataFrame, metric: str) -> DataFrame:
    """epoch, value, improved: greater than all values before. NaN, null or an unknown metric count as -val_loss."""
    value = F.col(metric).cast("double") if metric in history.columns else F.lit(None).cast("double")
    value = F.coalesce(F.nanvl(value, F.lit(None).cast("double")), -F.col("val_loss"))
    value = F.nanvl(value, F.lit(None).cast("double"))
    before = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    rows = history.select("epoch", value.alias("value"))
    best = F.coalesce(F.max("value").over(before), F.lit(float("-inf")))
    return rows.withColumn("improved", F.coalesce(F.col("value") > best, F.lit(False)))


def walked(history: DataFrame, metric: str, patience: int) -> DataFrame:
    """Adds waited (epochs since the last improvement, or since the start) and stops: where it first reaches patience."""
    rows = improvements(history, metric)
    upto = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("nth", F.row_number().over(Window.orderBy("epoch")))
    last = F.coalesce(F.max(F.when(F.col("improved"), F.col("nth"))).over(upto), F.lit(0))
    rows = rows.withColumn("waited", F.col("nth") - last)
    stop = (F.col("waited") >= patience).cast("int")
    before = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("over", F.coalesce(F.max(stop).over(before), F.lit(0)) == 1)
    return rows.withColumn("stops", (stop == 1) & ~F.col("over"))


def early_stop(history: DataFrame, metric: str = "val_recall", patience: int = 8) -> DataFrame:
    """epoch, value, improved, waited of the epochs that are run; the last one stops when patience is used up."""
    return walked(history, metric, patience).where(~F.col("over")).select("epoch", "value", "improved", "waited", "stops")


def best_epoch(history: DataFrame, metric: str = "val_recall", patience: int | None = None) -> DataFrame:
    """epoch, value of the last improvement, up to the early stop if patience is given; no improvement is an error."""
    rows = improvements(history, metric) if patience is None else walked(history, metric, patience).where(~F.col("over"))
    best = rows.where("improved").agg(F.max_by("epoch", "epoch").alias("epoch"), F.max_by("value", "epoch").alias("value"))
    return best.select(F.coalesce("epoch", F.raise_error(F.lit("no epoch improves")).cast(rows.schema["epoch"].dataType)).alias("epoch"), "value")
