"""Image preparation and augmentation over tables of pixels.

Rows have image_id, h, w, c and pixels: a flat array, by rows with channels last for raw bytes, by channel (CHW) once
`to_tensor` has run. Resizing works on Arrow batches, on all images of one shape together; the rest is built-in
functions. Null pixels stay null.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.keys import uniform

# Channel means and deviations.
GRAY = ((0.5,), (0.5,))
RGB = ((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))


def once(column: Column) -> Column:
    """`column` where pixels aren't null. As it names the pixels twice, the optimizer doesn't put the step that makes
    them inside the lambda, where each pixel would make them all again."""
    return F.when(F.col("pixels").isNotNull(), column)


def gray(images: DataFrame) -> DataFrame:
    """8-bit luma of blue-green-red bytes; one-channel images stay."""
    part = lambda i, k: F.col("pixels")[i * 3 + k]
    places = F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)
    luma = F.transform(places, lambda i: F.shiftright(19595 * part(i, 2) + 38470 * part(i, 1) + 7471 * part(i, 0) + 32768, 16))
    return images.withColumns({"pixels": F.when(F.col("c") == 1, F.col("pixels")).otherwise(luma), "c": F.lit(1)})


@lru_cache(maxsize=256)
def weights(size: int, out: int) -> np.ndarray:
    """(out, size) triangle weights; the support widens with the reduction."""
    scale = size / out
    reach = max(scale, 1.0)
    table = np.zeros((out, size))
    for o in range(out):
        center = (o + 0.5) * scale
        lo, hi = max(int(center - reach + 0.5), 0), min(int(center + reach + 0.5), size)
        w = np.maximum(0, 1 - np.abs((np.arange(lo, hi) + 0.5 - center) / reach))
        table[o, lo:hi] = w / w.sum()
    return table


#: Bytes of doubles that a stack of images may take, before or after its step.
STACK = 1 << 26


def per_shape(images: DataFrame, step, out_area: int) -> DataFrame:
    """`step` takes a stack of blocks of one shape, (n, h, w, c) or (n, c, h, w), and gives another of `out_area` pixels; pixels, h and w change.

    Stacks are cut by the larger of both sizes, so a task holds STACK bytes of doubles (or one image), however many
    images come at once and however far they are enlarged.
    """
    floats = dict(images.dtypes)["pixels"] in ("array<float>", "array<double>")

    def run(batches):
        for whole in batches:
            yield whole.filter(whole["pixels"].is_null())
            batch = whole.filter(whole["pixels"].is_valid())
            sizes = np.stack([batch[k].to_numpy(zero_copy_only=False) for k in "hwc"], 1)
            for h, w, c in np.unique(sizes, axis=0).tolist():
                alike, n = batch.filter(pa.array((sizes == (h, w, c)).all(axis=1))), max(1, STACK // (8 * c * max(h * w, out_area, h * math.isqrt(out_area), 1)))
                for part in (alike.slice(lo, n) for lo in range(0, len(alike), n)):
                    yield stepped(part, h, w, c, whole.schema)

    def stepped(part, h, w, c, schema):
        flat = part["pixels"].flatten().to_numpy(zero_copy_only=False)
        stack = step(flat.reshape(len(part), *((c, h, w) if floats else (h, w, c))))
        columns = {n: part[n] for n in part.schema.names}
        kind = part.schema.field("pixels").type
        made = pa.array(stack.ravel(), kind.value_type)
        columns["pixels"] = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * (len(made) // len(part))), made, type=kind)
        for k, size in zip("hw", stack.shape[2:] if floats else stack.shape[1:3], strict=True):
            columns[k] = pa.array(np.full(len(part), size), part.schema.field(k).type)
        return pa.RecordBatch.from_arrays(list(columns.values()), schema=schema)

    return images.mapInArrow(run, images.schema)


def resize(images: DataFrame, size: int) -> DataFrame:
    """size x size, aspect not kept; bilinear, rounded where pixels are whole numbers. Rows without pixels stay as they are."""

    def step(stack):
        floats = stack.dtype.kind == "f"
        nhwc = stack.transpose(0, 2, 3, 1) if floats else stack
        across = np.einsum("ij,nkjc->nkic", weights(nhwc.shape[2], size), nhwc.astype(float))
        out = np.einsum("ij,njkc->nikc", weights(nhwc.shape[1], size), across)
        return out.transpose(0, 3, 1, 2).astype(stack.dtype) if floats else np.clip(np.floor(np.round(out, 9) + 0.5), 0, 255).astype(stack.dtype)

    return per_shape(images, step, size * size)


def to_tensor(images: DataFrame) -> DataFrame:
    """Bytes with channels last to CHW floats in [0, 1]."""
    area = F.col("h") * F.col("w")
    source = lambda i: F.col("pixels")[((i % area) * F.col("c") + F.floor(i / area)).cast("int")]
    chw = F.transform(F.sequence(F.lit(0), area * F.col("c") - 1), lambda i: (source(i) / 255).cast("float"))
    return images.withColumn("pixels", once(chw))


def repeat_channels(images: DataFrame, channels: int) -> DataFrame:
    """One channel becomes `channels`; that many stay; any other number is an error."""
    wrong = F.raise_error(F.concat(F.lit("channels: "), F.col("c").cast("string"))).cast("array<float>")
    pixels = F.when(F.col("c") == channels, F.col("pixels")).when(F.col("c") == 1, F.flatten(F.array_repeat("pixels", channels))).otherwise(wrong)
    return images.withColumns({"pixels": pixels, "c": F.lit(channels)})


def normalise(images: DataFrame, mean, std) -> DataFrame:
    at = lambda v, i: F.array(*[F.lit(float(x)) for x in v])[F.floor(i / (F.col("h") * F.col("w"))).cast("int")]
    return images.withColumn("pixels", F.transform("pixels", lambda x, i: ((x - at(mean, i)) / at(std, i)).cast("float")))


def coin(name: str, seed: int, epoch: int) -> Column:
    return uniform(seed, epoch, F.lit(name), F.col("image_id"))


@dataclass(frozen=True)
class Move:
    """Where a step takes pixels from: `source(y, x)` of each place, in terms of the columns it needs."""

    columns: dict[str, Column]
    source: Callable[[Column, Column], tuple[Column, Column]]


def mirroring(p: float = 0.5, seed: int = 42, epoch: int = 0) -> Move:
    """Mirrored columns where the image's coin falls below p."""
    return Move({"flip_": coin("flip", seed, epoch) < p}, lambda y, x: (y, F.when(F.col("flip_"), F.col("w") - 1 - x).otherwise(x)))


def shifting(share: float = 0.1, seed: int = 42, epoch: int = 0) -> Move:
    """A shift by whole pixels, at most `share` of each side."""
    shift = lambda side, name: F.round((2 * coin(name, seed, epoch) - 1) * share * F.col(side)).cast("int")
    return Move({"dy_": shift("h", "dy"), "dx_": shift("w", "dx")}, lambda y, x: (y - F.col("dy_"), x - F.col("dx_")))


def turning(degrees: float = 15, seed: int = 42, epoch: int = 0) -> Move:
    """A turn about the centre by an angle of at most `degrees`, nearest neighbour."""
    angle = F.radians((2 * coin("rotate", seed, epoch) - 1) * degrees)
    cos, sin, cy, cx = F.col("cos_"), F.col("sin_"), (F.col("h") - 1) / 2, (F.col("w") - 1) / 2

    def source(y, x):
        along = F.floor(cos * (x - cx) - sin * (y - cy) + cx + 0.5).cast("int")
        return F.floor(sin * (x - cx) + cos * (y - cy) + cy + 0.5).cast("int"), along

    return Move({"cos_": F.cos(angle), "sin_": F.sin(angle)}, source)


def gathered(images: DataFrame, *moves: Move) -> DataFrame:
    """The images after all moves, the first one first, same size; zeros come in wherever a move looks outside.

    The moves' places are composed before any pixel is touched: each place of the result looks up one pixel.
    """
    kind = dict(images.dtypes)["pixels"]
    h, w, c, floats = F.col("h"), F.col("w"), F.col("c"), kind in ("array<float>", "array<double>")
    columns = {n: x for m in moves for n, x in m.columns.items()}

    def pixel(i):
        place = i % (h * w) if floats else F.floor(i / c).cast("int")
        y, x, inside = F.floor(place / w).cast("int"), place % w, F.lit(True)
        for m in reversed(moves):
            y, x = m.source(y, x)
            inside = inside & (y >= 0) & (y < h) & (x >= 0) & (x < w)
        at = i - place + y * w + x if floats else (y * w + x) * c + i % c
        return F.when(inside, F.col("pixels")[at.cast("int")]).otherwise(F.lit(0))

    places = F.sequence(F.lit(0), h * w * c - 1)
    return images.withColumns(columns).withColumn("pixels", once(F.transform(places, pixel).cast(kind))).drop(*columns)


def flip(images: DataFrame, p: float = 0.5, seed: int = 42, epoch: int = 0) -> DataFrame:
    return gathered(images, mirroring(p, seed, epoch))


def translate(images: DataFrame, share: float = 0.1, seed: int = 42, epoch: int = 0) -> DataFrame:
    return gathered(images, shifting(share, seed, epoch))


def rotate(images: DataFrame, degrees: float = 15, seed: int = 42, epoch: int = 0) -> DataFrame:
    return gathered(images, turning(degrees, seed, epoch))


def sharpen(images: DataFrame, factor: float = 1.2, p: float = 0.3, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Moves away from a 3x3 smooth (centre 5, others 1, over 13) by `factor`; the border stays."""
    kind = dict(images.dtypes)["pixels"]
    h, w, c, floats = F.col("h"), F.col("w"), F.col("c"), kind in ("array<float>", "array<double>")

    def pixel(value, i):
        place = i % (h * w) if floats else F.floor(i / c).cast("int")
        y, x, step = F.floor(place / w), place % w, F.lit(1) if floats else c
        near = [F.col("pixels")[(i + (a * w + b) * step).cast("int")] for a in (-1, 0, 1) for b in (-1, 0, 1)]
        smooth = (sum(near[1:], near[0]).cast("double") + 4 * value) / 13
        sharp = F.greatest(F.lit(0.0), F.least(F.lit(1.0 if floats else 255.0), smooth + factor * (value - smooth)))
        inner = (y > 0) & (y < h - 1) & (x > 0) & (x < w - 1)
        return F.when(inner, sharp if floats else F.floor(sharp + 0.5)).otherwise(value)

    return images.withColumn("pixels", F.when(coin("sharpen", seed, epoch) < p, F.transform("pixels", pixel).cast(kind)).otherwise(F.col("pixels")))


def noise(images: DataFrame, std: float = 0.01, p: float = 0.3, mean: float = 0.0, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Gaussian noise on tensors where the image's coin falls below p, clamped to [0, 1]: two uniforms from one md5 a pixel."""

    def pixel(value, i):
        digest = F.md5(F.concat_ws(":", F.lit(f"{seed}:{epoch}:grain"), F.col("image_id").cast("string"), i.cast("string")))
        part = lambda at: F.conv(F.substring(digest, at, 13), 16, 10).cast("long").cast("double")
        radius = F.sqrt(-2 * F.ln((part(1) + 1) / float(1 << 52)))
        moved_ = value + mean + std * radius * F.cos(2 * math.pi * part(14) / float(1 << 52))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved_)).cast("float")

    noisy = F.transform("pixels", pixel).cast(dict(images.dtypes)["pixels"])
    return images.withColumn("pixels", F.when(coin("noise", seed, epoch) < p, noisy).otherwise(F.col("pixels")))


def prepare(images: DataFrame, size: int | None = 224, train: bool = False, channels: int = 1, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Resize, (rotate, flip, translate, sharpen), to tensor, (noise), repeat, normalise; steps in brackets for training."""
    images = resize(images, size) if size else images
    if train:
        images = gathered(images, *(m(seed=seed, epoch=epoch) for m in (turning, mirroring, shifting)))
        images = sharpen(images, seed=seed, epoch=epoch)
    images = to_tensor(images)
    if train:
        images = noise(images, seed=seed, epoch=epoch)
    return normalise(repeat_channels(images, channels), *(RGB if channels == 3 else GRAY))


def input_channels(replicate: bool, pretrained: bool) -> int:
    return 3 if replicate and pretrained else 1
