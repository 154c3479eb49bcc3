"""Shared plumbing: scratch tables, Arrow text buffers, packed rows."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cairn.sources.scratch import shuffles_freed  # noqa: F401  for the modules beside this one


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: `spark.checkpoint.dir`, or in local mode a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="cairn-")
    spark.conf.set("spark.checkpoint.dir", f"file://{root}")
    return f"file://{root}"


#: Folders that `temporary` removes, a list for each of those that are open.
_open: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("open", default=())


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Tables written inside go from the shared folder at the end, but for lasting ones, which go with an outer `temporary`, if any.

    What reads them must be written before that, as a lasting table. Gives a function that hands what was written so far
    to the outer `temporary`, if any.
    """
    mine, around = [], _open.get()

    def keep():
        if around:
            around[-1].extend(mine)
        mine.clear()

    token = _open.set((*around, mine))
    try:
        yield keep
    finally:
        _open.reset(token)
        for folder in mine:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _folder(spark: SparkSession, name: str, lasting: bool) -> str:
    path = f"{shared_folder(spark)}/{name}"
    around = _open.get()[: -1 if lasting else None]
    if around:
        around[-1].append(path)
    return path


def materialise(df: DataFrame, lasting: bool = False, by: list[str] | None = None) -> DataFrame:
    """Writes `df` once in the shared folder and returns a reader of it: cuts lineage, survives lost executors.

    With `by` (the last columns), rows lie in a folder for each of their values.
    """
    path = _folder(df.sparkSession, f"cairn-{uuid.uuid4().hex}", lasting)
    df.write.option("compression", "zstd").parquet(path, partitionBy=by or None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def bucketed(df: DataFrame, *by: str):
    """A reader of `df`, written once in the shared folder in as many buckets of `by` as a shuffle has partitions.

    Joins by those columns don't shuffle it again. The table's name goes at the end, its files with `temporary`.
    """
    spark, name = df.sparkSession, f"cairn_{uuid.uuid4().hex}"
    n = min(partitions(spark), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    out = df.repartition(n, *by).write.option("compression", "zstd").option("path", _folder(spark, name, False))
    out.format("parquet").bucketBy(n, *by).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Gives memory that Python and Arrow hold free back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """The function of batches (mapInArrow) `run`; its worker trims when the task ends. Spark keeps idle workers, several an
    executor, and turns to each of them by and by: what each holds free is lacking elsewhere."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return whole


def trimmed_group(run):
    """The group function (applyInArrow) `run`; its worker trims after each group."""

    @functools.wraps(run)
    def whole(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            trim()

    return whole


def pack(**columns) -> bytes:
    """Arrow IPC bytes (zstd) of equally long columns."""
    batch = pa.record_batch({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob) -> pa.Table:
    return pa.ipc.open_stream(blob.as_buffer() if isinstance(blob, pa.Scalar) else blob).read_all()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, limit: int = 1 << 23):
    """Batches cut to about `limit` bytes of text each."""
    for batch in batches:
        _, offsets = text_buffer(batch["text"])
        for lo, hi in row_chunks(offsets, limit):
            yield batch.slice(lo, hi - lo)


def row_chunks(offsets: np.ndarray, limit: int = 1 << 21):
    """Row ranges of about `limit` bytes each; a longer row stands alone."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi
