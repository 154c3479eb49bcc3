"""Binary metrics of score tables (y int, prob float).

A score table is counted once, by group and score (`histogram`); the counts are exact, add up over parts of the table
(`merged`), and answer every threshold, AUROC and report. A null or NaN score is an error everywhere; rows whose y is
neither 0 nor 1 (null too) don't count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.probability import decided, finite

COUNTS = ("tn", "fp", "fn", "tp")


def confusion(threshold: float) -> list[Column]:
    """Aggregates tn, fp, fn, tp at a threshold."""
    hit, y = decided(F.col("prob"), threshold), F.col("y")
    cells = {"tn": (y == 0) & (hit == 0), "fp": (y == 0) & (hit == 1), "fn": (y == 1) & (hit == 0), "tp": (y == 1) & (hit == 1)}
    return [F.count_if(cells[c]).alias(c) for c in COUNTS]


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def rates() -> dict[str, Column]:
    """recall, specificity and f1 from the four counts; 0 for 0/0."""
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    return {"recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "f1": ratio(2 * tp, 2 * tp + fp + fn)}


def histogram(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, prob, p, n: how many rows of each class have a score. Null groups are groups."""
    checked = scores.withColumn("prob", finite(F.col("prob")))
    return checked.groupBy(*by, "prob").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))


def merged(parts: list[DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """The histogram of all the parts' rows together."""
    return reduce(DataFrame.unionByName, parts).groupBy(*by, "prob").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def summary(counted: DataFrame, levels: dict[str, float | Column], by: tuple[str, ...] = (), buckets: int = 1024) -> DataFrame:
    """by, auc, loss, and tn_, fp_, fn_ and tp_ of each named threshold, all from one pass over a histogram.

    auc is tie-aware, NaN with one class only. Scores fall into buckets of their log-odds (they crowd near 0 and 1),
    whose running sums place them; inside a bucket a window adds the rest. The sum is of whole numbers, as decimals: it
    doesn't depend on order and holds 10^18 rows of each class. loss is the mean cross-entropy of scores kept 1e-7 away
    from 0 and 1. A threshold may be a column of the histogram. Without rows and groups: one row of zero counts, auc NaN.
    """
    by, p = list(by), F.col("prob").cast("double")
    odds = F.when(p <= 0, -20.0).when(p >= 1, 20.0).otherwise(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.ln(p / (1 - p)))))
    values = counted.withColumn("bucket", F.least(F.lit(buckets - 1), F.floor((odds + 20) * buckets / 40)))
    inside = Window.partitionBy(*by, "bucket").orderBy("prob").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("below", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    pair = whole("p") * (2 * whole("below") + whole("n"))
    safe = F.greatest(F.least(p, F.lit(1 - 1e-7)), F.lit(1e-7))
    hits = {k: decided(F.col("prob"), t) == 1 for k, t in levels.items()}
    sides = [F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(f"{name}_{k}") for k, hit in hits.items() for c, name in (("p", "tp"), ("n", "fp"))]
    cells = values.groupBy(*by, "bucket").agg(
        F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(pair.cast("decimal(38,0)")).alias("own"),
        F.sum(-F.col("p") * F.ln(safe) - F.col("n") * F.ln(1 - safe)).alias("loss"), *sides,
    )
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
    twice = F.sum(F.col("own") + (2 * whole("p") * whole("below")).cast("decimal(38,0)"))
    both = F.sum("p").cast("double") * F.sum("n").cast("double")
    found = cells.groupBy(*by).agg(
        F.when(both > 0, twice.cast("double") / (2 * both)).otherwise(F.lit(float("nan"))).alias("auc"), (F.sum("loss") / F.sum(F.col("p") + F.col("n"))).alias("loss"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("p_"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_"),
        *[F.coalesce(F.sum(f"{c}_{k}"), F.lit(0)).alias(f"{c}_{k}") for k in levels for c in ("tp", "fp")],
    )
    rest = {f"tn_{k}": F.col("n_") - F.col(f"fp_{k}") for k in levels} | {f"fn_{k}": F.col("p_") - F.col(f"tp_{k}") for k in levels}
    return found.withColumns(rest).drop("p_", "n_")


def at_level(found: DataFrame, level: str) -> DataFrame:
    """A summary's counts at one threshold under their plain names, with the rates."""
    return found.withColumnsRenamed({f"{c}_{level}": c for c in COUNTS}).withColumns(rates())


def auroc(scores: DataFrame, by: tuple[str, ...] = (), buckets: int = 1024) -> DataFrame:
    """auc (by groups) of a score table."""
    return summary(histogram(scores, by), {}, by, buckets).select(*by, "auc")


def binary_metrics(scores: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """recall, specificity, f1, auc, tn, fp, fn, tp: one row (a group); the scores are scanned once."""
    return at_level(summary(histogram(scores, by), {"x": threshold}, by), "x").select(*by, "recall", "specificity", "f1", "auc", *COUNTS)


def evaluation(scores: DataFrame, threshold: float) -> DataFrame:
    """threshold, metrics and matrix [[tn, fp], [fn, tp]] at 0.5 and at the tuned threshold: two rows, one pass."""
    return evaluation_of(histogram(scores), threshold)


def evaluation_of(counted: DataFrame, threshold: float) -> DataFrame:
    levels = {"0_5": 0.5, "optimized": float(threshold)}
    found = summary(counted, levels)
    each = [F.struct(F.lit(k).alias("at"), F.lit(t).alias("threshold"), *[F.col(f"{c}_{k}").alias(c) for c in COUNTS]) for k, t in levels.items()]
    report = found.select("auc", F.explode(F.array(*each)).alias("r")).select("auc", "r.*").withColumns(rates())
    return report.select("at", "threshold", "recall", "specificity", "f1", "auc", F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("matrix"))


def report_record(
    counted: DataFrame, tuned: tuple[float, float], model: dict, test_loss: float, run_name: str = "run", tuned_for: str = "youden_j", saved_for: str = "val_recall"
) -> DataFrame:
    """The test report as one nested row: the model's best epoch and score, the tuned (threshold, score) and what it was tuned for,
    the loss, and metrics and matrix at 0.5 and at the threshold. `counted`: a histogram of the test scores."""
    # The report's field names.
    level, score = map(float, tuned)
    levels = {"0_5": 0.5, "optimized": level}
    found = summary(counted, levels)
    cells = {k: {c: F.col(f"{c}_{k}") for c in COUNTS} for k in levels}
    rate = lambda own: {
        "recall": ratio(own["tp"], own["tp"] + own["fn"]), "specificity": ratio(own["tn"], own["tn"] + own["fp"]),
        "f1": ratio(2 * own["tp"], 2 * own["tp"] + own["fp"] + own["fn"]), "auc": F.col("auc"),
    }
    metric = [F.struct(*[c.alias(n) for n, c in (rate(own) | own).items()]).alias(f"test_metrics_threshold_{k}") for k, own in cells.items()]
    matrix = [F.array(F.array(own["tn"], own["fp"]), F.array(own["fn"], own["tp"])).alias(f"confusion_matrix_threshold_{k}") for k, own in cells.items()]
    plain = {
        "run_name": run_name, "best_epoch": int(model["epoch"]), "best_score": float(model["best_score"]), "save_best_metric": saved_for,
        "val_optimized_threshold": level, "val_optimized_threshold_metric": tuned_for, "val_optimized_threshold_score": score, "test_loss": float(test_loss),
    }
    return found.select(*[F.lit(x).alias(n) for n, x in plain.items()], *metric, *matrix)


def predictions(scores: DataFrame, threshold: float, key: str) -> DataFrame:
    """key, true_label, prob_sick and the decisions at 0.5 and at the tuned threshold."""
    prob = F.col("prob")
    return scores.select(
        key, F.col("y").alias("true_label"), prob.cast("double").alias("prob_sick"), decided(prob, 0.5).alias("pred_label_thr_0_5"),
        decided(prob, threshold).alias("pred_label_thr_opt"),
    )


def epoch_metrics(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """epoch, then loss, recall, specificity, f1 and auc of phases train and val; `scores` has epoch, phase, y, prob."""
    by = ("epoch", "phase")
    rows = at_level(summary(histogram(scores, by), {"x": threshold}, by, 16), "x")
    names = ("loss", "recall", "specificity", "f1", "auc")
    return rows.groupBy("epoch").agg(*[F.max(F.when(F.col("phase") == p, F.col(c))).alias(f"{p}_{c}") for p in ("train", "val") for c in names])


def fold_spread(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, mean and sample standard deviation over folds."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))
    return folds.select(pairs.alias("m")).groupBy("m.metric").agg(F.avg("m.value").alias("mean"), F.stddev_samp("m.value").alias("std"))
