"""An append-only table of training epochs, from which a fit goes on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The measures of a history row, in order.
ROW = ("train_loss", "val_loss", *(f"{p}_{m}" for p in ("train", "val") for m in ("recall", "specificity", "f1", "auc")))
SCHEMA = (
    "fold int, epoch int, theta array<double>, first array<double>, second array<double>, taken long, best double, waited int, improved boolean, done boolean, "
    + ", ".join(f"{c} double" for c in ROW)
    + ", input_channels int, use_rgb boolean, settings string"
)


@dataclass
class Epoch:
    """Where a head stands after an epoch: weights, both moments, steps taken, best score and how long ago, its history row."""

    fold: int
    epoch: int
    theta: np.ndarray
    first: np.ndarray
    second: np.ndarray
    taken: int
    best: float
    waited: int
    improved: bool
    done: bool
    row: dict
    input_channels: int
    use_rgb: bool
    settings: str


@dataclass
class Past:
    epochs: list[Epoch]  #: all of them, by fold and epoch, without weights
    last: dict[int, Epoch]  #: the last of each fold
    best: dict[int, Epoch]  #: the last that improved


def append(spark: SparkSession, folder: str, epochs: list[Epoch]) -> None:
    """Adds an epoch of all heads as one file: it is there whole or not at all."""
    rows = [
        (e.fold, e.epoch, e.theta.tolist(), e.first.tolist(), e.second.tolist(), e.taken, e.best, e.waited, e.improved, e.done, *(e.row[c] for c in ROW), e.input_channels, e.use_rgb, e.settings)
        for e in epochs
    ]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def table(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table, None where there is none yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read(spark: SparkSession, folder: str) -> Past | None:
    """What a fit needs to go on: every history row, and the weights of the last and the best epochs alone."""
    held = table(spark, folder)
    if held is None:
        return None
    weights = ("theta", "first", "second")
    epochs = [epoch(r) for r in held.drop(*weights).orderBy("fold", "epoch").collect()]
    if not epochs:
        return None
    last, best = {}, {}
    for e in epochs:
        last[e.fold] = e
        if e.improved:
            best[e.fold] = e
    wanted = F.array(*[F.struct(F.lit(e.fold).alias("fold"), F.lit(e.epoch).alias("epoch")) for e in {id(e): e for e in (*last.values(), *best.values())}.values()])
    for r in held.where(F.array_contains(wanted, F.struct("fold", "epoch"))).collect():
        for own in (last, best):
            if r["fold"] in own and own[r["fold"]].epoch == r["epoch"]:
                own[r["fold"]] = epoch(r)
    return Past(epochs, last, best)


def epoch(r) -> Epoch:
    held = r.asDict()
    theta, first, second = (np.array(held.get(c) or [], float) for c in ("theta", "first", "second"))
    row = {"epoch": held["epoch"]} | {c: held[c] for c in ROW}
    kept = {c: held[c] for c in ("fold", "epoch", "taken", "best", "waited", "improved", "done", "input_channels", "use_rgb", "settings")}
    return Epoch(theta=theta, first=first, second=second, row=row, **kept)


def best_model(spark: SparkSession, folder: str, fold: int = 0) -> dict:
    """The model of a fold's best epoch so far, while the fit goes on or after it; none yet is an error."""
    held = table(spark, folder)
    found = held and held.where(F.col("improved") & (F.col("fold") == fold)).orderBy(F.desc("epoch")).first()
    if not found:
        raise ValueError(f"{folder} holds no epoch that improves")
    theta = np.array(found["theta"])
    return {"coef": theta[:-2].reshape(2, -1).tolist(), "intercept": theta[-2:].tolist(), "best_score": found["best"]} | {c: found[c] for c in ("epoch", "input_channels", "use_rgb")}
