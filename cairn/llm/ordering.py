"""Training-order materialisation: every sequence gets a global slot, and slots fixed-stride shards."""

from __future__ import annotations

import json
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._hash import mix
from cairn.llm._io import materialise, row_chunks, shuffles_freed, temporary, text_buffer, trimmed
from cairn.llm.packing import encoder

MANIFEST = "manifest.json"
#: Bytes of texts whose ids a task holds at a time, and bytes of sequences that it gives out at a time.
TEXT_BYTES, GIVEN_BYTES = 1 << 22, 1 << 23


def feistel(index: np.ndarray, size: int, key: int, rounds: int = 4) -> np.ndarray:
    """A keyed permutation of 0..size-1: Feistel rounds over the next even power of two, walked until inside."""
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, walking = index.astype(np.uint64), np.arange(len(index))
    while len(walking):
        left, right = out[walking] >> half, out[walking] & mask
        for r in range(rounds):
            turn = mix(right ^ np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) % (1 << 64))) & mask
            left, right = right, left ^ turn
        out[walking] = left << half | right
        walking = walking[out[walking] >= size]
    return out.astype(np.int64)


def token_sequences(docs: DataFrame, vocabulary: str, length: int = 1024, end_id: int = 50256) -> DataFrame:
    """doc_id, piece, n_ids, ids: each document's ids and `end_id`, cut into pieces of `length` ids (16 bits each).

    The last piece is filled up with `end_id`; n_ids counts the others. Null and empty texts give a piece of `end_id`
    alone; null ids stay null, rows that repeat an id give pieces of their own, an empty table none, and columns but
    doc_id and text aren't read. An id beyond 16 bits is an error.
    """
    if end_id >= 1 << 16:
        raise ValueError("ids are written in 16 bits")

    def cut(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            for lo, hi in row_chunks(text_buffer(batch["text"])[1], TEXT_BYTES):
                made = encode([text or "" for text in batch["text"].slice(lo, hi - lo).to_pylist()])
                if max(int(ids.max(initial=0)) for ids in made) >= 1 << 16:
                    raise ValueError("ids are written in 16 bits")
                sizes = np.array([len(ids) + 1 for ids in made])
                pieces = -(-sizes // length)
                last = np.cumsum(pieces)
                full = np.full(last[-1] * length, end_id, "<u2")
                for at, ids in zip(((last - pieces) * length).tolist(), made, strict=True):
                    full[at : at + len(ids)] = ids
                row = np.repeat(np.arange(hi - lo), pieces)
                piece = np.arange(last[-1]) - (last - pieces)[row]
                n = np.minimum(length, sizes[row] - piece * length)
                step = max(1, GIVEN_BYTES // (2 * length))
                for a in range(0, len(row), step):
                    b = min(len(row), a + step)
                    places = pa.py_buffer(np.arange(b - a + 1, dtype=np.int32) * (2 * length))
                    ids = pa.Array.from_buffers(pa.binary(), b - a, [None, places, pa.py_buffer(full[a * length : b * length])])
                    columns = [batch["doc_id"].take(pa.array(lo + row[a:b])), pa.array(piece[a:b], pa.int32()), pa.array(n[a:b], pa.int32()), ids]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "n_ids", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(cut), "doc_id long, piece int, n_ids int, ids binary")


def wave_name(waves: int) -> str:
    """The column that says in which of so many waves a row's shard is written."""
    return f"wave_of_{waves}"


def training_order(sequences: DataFrame, key: int = 17, per_shard: int = 4096, waves: int = 1) -> DataFrame:
    """Adds slot, shard and place (bytes from the shard's start) to `sequences` (doc_id, piece, ids of one size, any others).

    Sequences are made once, for the ranges' bounds are sampled from what is written, sorted by (doc_id, piece, hash of
    the ids) into ranges and written again; the first table goes then. A row's number is its place in its file, after the
    rows of the files before. So numbers follow the data, not files or partitions, and only one
    count a range reaches the driver. The keyed permutation turns numbers into slots. Rows come back range-partitioned
    by whole shards and sorted by slot: a reader of any range of slots reads on, and write_shards writes the partitions
    as they are.
    Null ids come first. Rows that agree in the three are interchangeable and get slots of their own. An empty table
    gives none. Columns of sequences named slot, shard or place are replaced.
    Slots are written with the rows, once. With `waves`, so are the waves of write_shards: each wave's rows lie in a folder
    of their own (a column, `wave_name`, is added), so that a wave reads no others.
    """
    wave = [wave_name(waves)] if waves > 1 else []
    sequences = sequences.drop("slot", "shard", "place", *wave)
    hashed = "hash_" + "_" * max(map(len, sequences.columns))  # a name that no column has
    by = [F.col(c).asc_nulls_first() for c in ("doc_id", "piece", hashed)]
    spark = sequences.sparkSession
    with temporary(spark):
        with temporary(spark), shuffles_freed(spark):
            given = materialise(sequences.withColumn(hashed, F.xxhash64("ids")))
            rows = materialise(given.repartitionByRange(*by).sortWithinPartitions(*by).drop(hashed), lasting=True)
        rows = slotted(rows, key).withColumns({name: F.floor(F.col("slot") / per_shard) % waves for name in wave})
        rows = materialise(rows, lasting=True, by=wave)
    placed = rows.withColumn("shard", F.floor(F.col("slot") / per_shard))
    placed = placed.withColumn("place", (F.col("slot") % per_shard) * F.length("ids"))
    return placed.select(*sequences.columns, "slot", "shard", "place", *wave).repartitionByRange("shard").sortWithinPartitions("slot")


def slotted(rows: DataFrame, key: int) -> DataFrame:
    """Adds slot to `rows`, a table written in ranges that are sorted."""
    columns = rows.columns
    rows = rows.select("*", F.col("_metadata.file_name").alias("file_"), F.col("_metadata.row_index").alias("row_"))
    counts = {r["file_"]: r["count"] for r in rows.groupBy("file_").count().collect()}
    size, before = 0, {}
    for name in sorted(counts, key=lambda name: [int(x) for x in re.findall(r"\d+", re.sub(r"-[0-9a-f]{8}(-[0-9a-f]+)+", "", name))]):
        before[name] = size  # files are named by the number of their range
        size += counts[name]

    @F.pandas_udf("long")
    def slot(file: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series(feistel(file.map(before).to_numpy(np.int64) + row.to_numpy(), size, key))

    return rows.select(*columns, slot("file_", "row_").alias("slot"))


def write_shards(ordered: DataFrame, folder: str, per_shard: int = 4096, waves: int = 1) -> dict:
    """Writes each shard as one file of fixed-stride rows in slot order, and a manifest, which is returned: per_shard, rows, stride.

    `ordered` is as training_order returns it: each shard lies whole in one partition, by slot; other rows are an error.
    `folder` is a URI that executors reach (file:, hdfs:, s3:, ...). A file is written under another name and moved
    when whole, so a task that runs twice leaves one file; a run that was cut short goes on where the folder has its
    shards already: these are read and compared byte by byte, and a shard of other sequences, or of another order, is an
    error. An empty table gives a manifest of no rows.
    Shards are written in `waves`, each of every `waves`-th shard, so that a shuffle holds the ids of one wave alone. Where
    training_order was given as many, a wave reads its own rows; else each wave reads all.
    """

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        shard = out = draft = held = there = None
        rows = stride = slot = 0

        def finish() -> pa.RecordBatch:
            if out is None:
                there.close()
                if held != rows * stride:
                    raise ValueError(f"shard {shard} is there already with other rows")
            else:
                out.close()
                store.move(draft, name(shard))
            return pa.record_batch({"shard": [shard], "rows": [rows], "stride": [stride]})

        def name(shard) -> str:
            return f"{root}/shard-{shard:08d}.bin"

        try:
            for batch in batches:
                for number, at, place, ids in zip(*(batch[c].to_pylist() for c in ("shard", "slot", "place", "ids")), strict=True):
                    if number != shard:
                        if shard is not None:
                            yield finish()
                        store.create_dir(root, recursive=True)
                        shard, rows, stride, slot, out = number, 0, len(ids), at, None
                        info = store.get_file_info(name(shard))
                        held = info.size if info.type == fs.FileType.File else None
                        there = None if held is None else store.open_input_stream(name(shard))
                        if held is None:
                            draft = f"{root}/.{uuid.uuid4().hex}"
                            out = store.open_output_stream(draft)
                    if at != slot + rows or place != rows * stride or len(ids) != stride:
                        raise ValueError(f"slot {at} isn't next in shard {shard}: rows must come as training_order returns them")
                    if out is not None:
                        out.write(ids)
                    elif there.read(stride) != ids:
                        raise ValueError(f"shard {shard} is there already with other sequences or in another order")
                    rows += 1
            if shard is not None:
                yield finish()
        finally:
            if out is not None and not out.closed:
                out.close()
                store.delete_file(draft)

    own_wave = F.col(wave_name(waves)) if wave_name(waves) in ordered.columns else F.col("shard") % waves
    sums = []
    with shuffles_freed(ordered.sparkSession):
        for wave in range(waves):
            own = ordered.where(own_wave == wave) if waves > 1 else ordered
            written = own.select("shard", "slot", "place", "ids").mapInArrow(write, "shard long, rows long, stride long")
            sums.append(written.agg(F.count("*"), F.sum("rows"), F.max("shard"), F.min("stride"), F.max("stride")).first())
    n, *held = sum(s[0] for s in sums), *zip(*(s[1:] for s in sums if s[0]), strict=True)
    rows, last, least, most = (f(x) for f, x in zip((sum, max, min, max), held, strict=True)) if n else (0, None, None, None)
    if n and (last + 1 != n or least != most or -(-rows // per_shard) != n):
        raise ValueError("shards are missing, or their rows differ in size")
    manifest = {"per_shard": per_shard, "rows": rows or 0, "stride": most or 0}
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{MANIFEST}") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_shards(spark: SparkSession, folder: str, from_slot: int = 0, rows_a_read: int = 512) -> DataFrame:
    """slot, ids from a slot on, as the manifest describes the folder: earlier shards aren't opened, and the first one is
    read from the slot's place on. A task reads a shard, some rows at a time."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/{MANIFEST}") as file:
        manifest = json.loads(file.read())
    per_shard, rows, stride = (manifest[k] for k in ("per_shard", "rows", "stride"))
    first, shards = from_slot // per_shard, -(-rows // per_shard)

    def read(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard in batch["id"].to_pylist():
                slot, end = max(from_slot, shard * per_shard), min(rows, (shard + 1) * per_shard)
                with store.open_input_file(f"{root}/shard-{shard:08d}.bin") as file:
                    file.seek((slot - shard * per_shard) * stride)
                    while slot < end:
                        n = min(rows_a_read, end - slot)
                        content = file.read(n * stride)
                        ids = [content[i * stride : (i + 1) * stride] for i in range(n)]
                        yield pa.record_batch({"slot": pa.array(np.arange(slot, slot + n)), "ids": pa.array(ids, pa.binary())})
                        slot += n

    numbers = spark.range(first, max(first, shards), 1, max(1, min(shards - first, 10_000)))
    return numbers.mapInArrow(read, "slot long, ids binary")
