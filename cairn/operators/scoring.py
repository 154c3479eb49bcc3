"""Scoring tables with a linear head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.paths import decode_label
from cairn.functions.probability import softmax
from cairn.operators import pixels


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def score(rows: DataFrame, coef: list[list[float]], intercept: list[float]) -> DataFrame:
    """Adds logits and prob_sick (float32) to rows with `features`; null features give nulls, a size other than the model's is an error."""
    wrong = F.raise_error(F.concat(F.lit(f"the model takes {len(coef[0])} features, not "), F.size("features").cast("string"))).cast("array<double>")
    fits = F.col("features").isNull() | (F.size("features") == len(coef[0]))
    features = F.when(fits, F.transform("features", lambda x: x.cast("double"))).otherwise(wrong)
    logits = F.array(*[dot(features, F.array(*[F.lit(float(w)) for w in ws])) + F.lit(float(b)) for ws, b in zip(coef, intercept, strict=True)])
    scored = rows.withColumn("logits", logits)
    return scored.withColumn("prob_sick", F.element_at(softmax(F.col("logits")), 2).cast("float"))


def predict(rows: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """A prediction record for each row with two logits; decisions compare doubles."""
    probs = rows.withColumn("probs", softmax(F.col("logits")))
    normal, sick = F.col("probs")[0], F.col("probs")[1]
    label = (sick >= F.lit(float(threshold))).cast("int")
    return probs.select(
        key, label.alias("predicted_label"), decode_label(label).alias("predicted_class"), normal.alias("prob_normal"), sick.alias("prob_sick"),
        F.greatest(normal, sick).alias("confidence"), F.lit(float(threshold)).alias("threshold"),
    )


def predict_images(images: DataFrame, model: dict, size: int | None = 224, threshold: float = 0.5) -> DataFrame:
    """Decoded images to prediction records, all in one pass: gray where the model has one channel, resized, made a tensor, scored.

    `images`: image_id, h, w, c and pixels (bytes). `model`: coef and intercept, and input_channels (1 without it).
    """
    channels = model.get("input_channels", 1)
    given = pixels.gray(images) if channels == 1 else images
    ready = pixels.prepare(given, size=size, channels=channels).withColumnRenamed("pixels", "features")
    return predict(score(ready, model["coef"], model["intercept"]), "image_id", threshold)
