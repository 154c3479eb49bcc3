"""Class counts, class weights and weighted resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.keys import order_key, uniform
from cairn.operators.positions import number_rows


def class_counts(labels: DataFrame, classes: int) -> DataFrame:
    """label, n for every class, absent ones with 0."""
    found = labels.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"))
    every = labels.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    return every.join(found, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def class_weights(labels: DataFrame, classes: int) -> DataFrame:
    """label, weight (float32): 1 / max(n, 1), scaled to sum to the number of classes."""
    inverse = class_counts(labels, classes).withColumn("inverse", 1 / F.greatest("n", F.lit(1)))
    whole = inverse.agg(F.sum("inverse").alias("whole"))
    return inverse.crossJoin(whole).select("label", (F.col("inverse") / F.col("whole") * classes).cast("float").alias("weight"))  # one row


def chosen_weights(labels: DataFrame, classes: int, given: list[float] | None = None) -> DataFrame:
    """The weights given, else those from the counts."""
    if given is None:
        return class_weights(labels, classes)
    return labels.sparkSession.createDataFrame(list(enumerate(map(float, given))), "label int, weight double")


def weighted_sample(rows: DataFrame, key: str, weights: list[float] | None = None, seed: int = 42) -> DataFrame:
    """draw, label and `key` of n draws with replacement from n rows; a row's chance is the weight of its class.

    Weights depend on the class alone, so a draw picks a class by its share n_c * w_c and then a row of the class by
    number: an equi-join with the rows, no search in running sums. Without weights, classes weigh 1 / n_c.
    """
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    shares, edges, reached = {c: n * (weights[c] if weights else 1 / n) for c, n in sorted(counts.items())}, [], 0.0
    for c, share in shares.items():
        reached += share
        edges.append((c, reached))
    number = F.col("draw")
    point = uniform(seed, F.lit("class"), number) * reached
    picked = F.when(F.lit(False), F.lit(None).cast("int"))
    for c, edge in edges[:-1]:
        picked = picked.when(point < edge, c)
    draws = rows.sparkSession.range(sum(counts.values())).select(F.col("id").alias("draw"))
    draws = draws.withColumn("label", picked.otherwise(edges[-1][0]) if edges else F.lit(None).cast("int"))
    size = F.element_at(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]), F.col("label")) if counts else F.lit(0)
    draws = draws.withColumn("position", F.floor(uniform(seed, F.lit("row"), number) * size))
    numbered = number_rows(rows.select("label", key), order_key(seed, F.col(key)), [key], ["label"])
    return draws.join(numbered, ["label", "position"]).select("draw", "label", key)


def shuffled(rows: DataFrame, key: str, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Adds `draw`: a seeded order of all rows."""
    return number_rows(rows, order_key(seed, epoch, F.col(key)), [key], name="draw")


def check_strategy(strategy: str) -> None:
    if strategy not in ("sampler", "loss_weights", "none"):
        raise ValueError(f"unknown imbalance strategy: {strategy}")


def training_order(rows: DataFrame, key: str, strategy: str = "sampler", weights: list[float] | None = None, seed: int = 42, epoch: int = 0) -> DataFrame:
    check_strategy(strategy)
    if strategy == "sampler":
        return weighted_sample(rows, key, weights, seed + epoch)
    return shuffled(rows, key, seed, epoch).select("draw", "label", key)
