"""Array functions on logits and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def softmax(logits: Column) -> Column:
    powers = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(powers, lambda x: x / total(powers))


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    spread = F.ln(total(F.transform(logits, lambda x: F.exp(x - top))))
    return F.transform(logits, lambda x: x - top - spread)


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == label).cast("double"))


def pick(values: Column, label: Column) -> Column:
    """The element at a 0-based label; null outside."""
    return F.try_element_at(values, F.when(label >= 0, label.cast("int") + 1))


def focal_factor(loss: Column, gamma: float) -> Column:
    return F.pow(1 - F.exp(-loss), F.lit(float(gamma)))


def is_close(a: Column, b: Column, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    return F.abs(a - b) <= absolute + relative * F.abs(b)


def grid(low: float, high: float, steps: int) -> list[float]:
    """Evenly spaced points, the last exactly `high`."""
    if steps < 2:
        return [float(low)] * steps
    step = (high - low) / (steps - 1)
    return [i * step + low for i in range(steps - 1)] + [float(high)]


def decided(score: Column, threshold: float | Column) -> Column:
    """1 where a float32 score reaches the threshold as float32; NaN and null scores are an error."""
    level = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (finite(score) >= level.cast("float")).cast("int")


def finite(score: Column) -> Column:
    """The score; NaN and null are an error, so that no metric leaves such rows out or ranks them."""
    kind = F.when(score.isNull(), "null score").otherwise("NaN score")
    return F.when(score.isNull() | F.isnan(score), F.raise_error(kind).cast("float")).otherwise(score)
