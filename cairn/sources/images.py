"""Image tables from directory trees, manifests and split tables; decoded pixels; sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.paths import CLASSES, is_image
from cairn.sources.trees import files_below

IMAGE_COLUMNS = ("patient_id", "class", "image_path")


def parse_paths(paths: DataFrame, root: str, classes=CLASSES, column: str = "path") -> DataFrame:
    """patient_id, class, image_path of the images below <root>/<class>/<patient>/, at any depth.

    Other classes, files directly below a class and files that aren't images fall away.
    """
    path = F.col(column)
    pattern = rf"^{re.escape(root.rstrip('/'))}/([^/]+)/([^/]+)/(?:.*/)?[^/]+$"
    name, patient = F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2)
    rows = paths.where(name.isin(*classes) & is_image(path))
    return rows.select(F.concat_ws("/", name, patient).alias("patient_id"), name.alias("class"), path.alias("image_path"))


def scan_images(spark: SparkSession, root: str, classes=CLASSES) -> DataFrame:
    """parse_paths over a directory tree; only names are read, a missing class is skipped, no image gives no row.

    Only the folders of known classes are entered. Tasks list the tree level by level (`trees.files_below`), names that
    begin with a dot or underscore too.
    """
    root = re.sub("^file:/+", "/", root).rstrip("/")
    return parse_paths(files_below(spark, [f"{root}/{c}" for c in classes]), root, classes)


def ordered_scan(images: DataFrame, classes=CLASSES) -> DataFrame:
    """By class index, patient directory, path."""
    return images.orderBy(F.array_position(F.array(*map(F.lit, classes)), F.col("class")), "patient_id", "image_path")


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with the three image columns; a missing file or column is an error."""
    table = spark.read.option("header", True).option("escape", '"').csv(path)
    missing = sorted(set(IMAGE_COLUMNS) - set(table.columns))
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return table


def decode_images(spark: SparkSession, path: str, keep_broken: bool = False) -> DataFrame:
    """image_path, h, w, c and pixels (gray or blue-green-red bytes by rows); undecodable files are an error or dropped."""
    images = spark.read.format("image").option("dropInvalid", str(not keep_broken).lower()).load(path).select("image.*")

    def flat(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = [np.frombuffer(b, np.uint8).astype(np.int32) for b in batch["data"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["image_path"], batch["h"], batch["w"], batch["c"], pa.array(rows, pa.list_(pa.int32()))], names=["image_path", "h", "w", "c", "pixels"]
            )

    origin = F.url_decode(F.regexp_replace("origin", "^file:/+", "/"))
    named = images.select(origin.alias("image_path"), F.col("height").alias("h"), F.col("width").alias("w"), F.col("nChannels").alias("c"), "data")
    return named.mapInArrow(flat, "image_path string, h int, w int, c int, pixels array<int>")


def write_csv(table: DataFrame, path: str, by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> None:
    table = table.orderBy(*order) if order else table
    table.write.mode("overwrite").partitionBy(*by).option("header", True).option("escape", '"').csv(path)


def write_splits(assigned: DataFrame, path: str) -> None:
    """One folder for each split; with a fold column one for each fold and split."""
    write_csv(assigned, path, tuple(c for c in ("fold", "split") if c in assigned.columns), ("image_path",))


def write_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def save_model(spark: SparkSession, model: dict, path: str) -> None:
    """One row: coef, intercept, epoch, best_score, input_channels (1 if not given) and use_rgb (whether it has three)."""
    channels = int(model.get("input_channels", 1))
    row = (model["coef"], model["intercept"], model["epoch"], model["best_score"], channels, bool(model.get("use_rgb", channels == 3)))
    schema = "coef array<array<double>>, intercept array<double>, epoch int, best_score double, input_channels int, use_rgb boolean"
    spark.createDataFrame([row], schema).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> dict:
    return spark.read.parquet(path).first().asDict()
