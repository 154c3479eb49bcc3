"""Tables published whole: files are written first, a manifest last, and readers take only what a manifest names.

A folder holds `data`, where every publication writes under a name of its own, and `manifests`, a table to which a
publication adds its rows as one file when all its data are written and counted. A run that was cut short has added
nothing, so readers see the publication before it, whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import splits
from cairn.sources.scratch import shuffles_freed

FILES = "array<struct<file string, rows long, digest string>>"
MANIFEST = f"version long, name string, format string, base string, columns string, files {FILES}"
#: A null is an empty field, an empty text two quotes.
OPTIONS = {"csv": {"header": "true", "escape": '"', "quote": '"', "nullValue": "", "emptyValue": '""'}, "json": {"ignoreNullFields": "false"}, "parquet": {}, "text": {}}


@dataclass
class Table:
    """A table to publish: its format (csv, json, parquet, text), the columns that name its folders, and the order of rows in a file.

    `spread` makes the table's rows of `rows` when these are dealt to their tasks by `order`: many rows of one, which no
    shuffle moves. `compression`: of the files, where the format has it not by itself.
    """

    rows: DataFrame
    format: str = "csv"
    by: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    spread: Callable[[DataFrame], DataFrame] | None = None
    compression: str | None = None

    def laid(self) -> DataFrame:
        """The rows, dealt to tasks and ordered as they are written."""
        if self.spread:
            return self.spread(self.rows.repartitionByRange(*self.order)).sortWithinPartitions(*self.by, *self.order)
        keys = (*self.by, *self.order)
        return self.rows.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else self.rows


def read_files(spark: SparkSession, base: str, kind: str, columns: str, files: list[str]) -> DataFrame:
    reader = spark.read.schema(columns).format(kind).options(**OPTIONS[kind]).option("basePath", base)
    if kind == "csv":  # a field that is empty without quotes is null, whatever stands for null in values
        reader = reader.option("emptyValue", "").option("nullValue", "\0")
    return reader.load(files)


def counted(table: DataFrame) -> DataFrame:
    """file, rows, digest of each file of a read table; the digest is the sum of its rows' hashes, so order doesn't matter."""
    digest = F.sum(F.xxhash64(*sorted(table.columns)).cast("decimal(38,0)")).cast("string")
    return table.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), digest.alias("digest"))


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).json(f"{folder}/manifests")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def publish(spark: SparkSession, folder: str, tables: dict[str, Table]) -> int:
    """Writes the tables and then makes them visible together; the publication's number.

    Each table is read back once, as readers will read it, for the counts and digests of its files; only these come to
    the driver. Tables without rows are published too. Two publications at the same time may take one number: the
    caller keeps them apart.
    """
    version = (manifests(spark, folder).agg(F.max("version")).first()[0] or 0) + 1
    draft, rows = f"{folder}/data/{version:06d}-{uuid.uuid4().hex}", []
    for name, t in tables.items():
        base = f"{draft}/{name}"
        laid, options = t.laid(), OPTIONS[t.format] | ({"compression": t.compression} if t.compression else {})
        laid.write.format(t.format).options(**options).partitionBy(*t.by).save(base)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.schema)
        found = counted(read_files(spark, base, t.format, columns, [base])).orderBy("file").collect()
        rows.append((version, name, t.format, base, columns, [tuple(r) for r in found]))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{folder}/manifests")
    return version


def published(spark: SparkSession, folder: str, name: str, version: int | None = None, check: bool = False) -> DataFrame:
    """A published table, of the last publication or a given one. `check`: its files must have the rows that the manifest counts."""
    held = manifests(spark, folder)
    version = version or held.agg(F.max("version")).first()[0]
    entry = held.where((F.col("version") == version) & (F.col("name") == name)).first()
    if entry is None:
        raise FileNotFoundError(f"{folder} has no published {name}" + (f" of version {version}" if version else ""))
    if not entry["files"]:
        return spark.createDataFrame([], entry["columns"])
    table = read_files(spark, entry["base"], entry["format"], entry["columns"], [f["file"] for f in entry["files"]])
    if check:
        found = {r["file"]: (r["rows"], r["digest"]) for r in counted(table).collect()}
        changed = sorted(f["file"] for f in entry["files"] if found.get(f["file"]) != (f["rows"], f["digest"]))
        if changed:
            raise ValueError(f"{len(changed)} files of {name} aren't as published, {changed[0]} for one")
    return table


def json_list(rows: DataFrame, order: str) -> DataFrame:
    """One row, value: the rows as a JSON list in order. For tables that are small by construction (folds, epochs)."""
    held = F.sort_array(F.collect_list(F.struct(order, *[c for c in rows.columns if c != order])))
    return rows.agg(F.to_json(held, {"ignoreNullFields": "false"}).alias("value"))


def publish_folds(spark: SparkSession, folder: str, images: DataFrame, summary: DataFrame, assigned: DataFrame | None = None) -> int:
    """The images of every fold and split in folders fold=fold_NN/split=..., by path, and folds_summary as a JSON list.

    `images`: with fold (its name) and split, or without them, and `assigned` has these of each patient_id; then an image
    is moved once for all folds. `summary`: a row a fold. The folds' files are gzip: they name each image once a fold.
    """
    spread = None
    if assigned is not None:
        names, images = images.columns, splits.with_folds(images, assigned)
        spread = lambda rows: splits.spread_folds(rows, names)
    folds = Table(images, "csv", ("fold", "split"), ("image_path",), spread, "gzip")
    with shuffles_freed(spark):
        return publish(spark, folder, {"folds": folds, "folds_summary": Table(json_list(summary, "fold"), "text")})
