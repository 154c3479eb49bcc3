"""A data source of the images that a split table names: `spark.read.format("split_images").load(folder)`.

The folder holds CSV files (plain or gzip) with patient_id, class and image_path (as `write_splits` writes them). Only these files are
listed; partitions are byte ranges of them, and each task fetches and decodes the images of its lines by their paths.
"""

from __future__ import annotations

import csv
import gzip
import io
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "patient_id string, class string, image_path string, h int, w int, c int, pixels array<int>"
COLUMNS = ("patient_id", "class", "image_path")
#: Bytes of the table that a partition reads (some thousand images), and bytes of pixels that a batch holds.
RANGE, BATCH = 1 << 18, 1 << 24


def decoded_png(data: bytes) -> tuple[int, int, int, np.ndarray]:
    """(h, w, c, bytes by rows) of a PNG of eight bits or fewer a sample: gray alone, or blue, green, red (and alpha)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, palette, clear = 8, b"", None, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            w, h, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            packed += body
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    if interlaced or depth == 16 or (clear and color != 3):
        raise ValueError("interlaced, 16-bit and colour-keyed PNGs aren't decoded")
    width, step = (w * samples * depth + 7) // 8, max(1, samples * depth // 8)
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, width + 1)
    rows, above = np.zeros((h, width), np.uint8), np.zeros(width, np.uint8)
    for y in range(h):
        rows[y] = above = unfiltered(lines[y, 0], lines[y, 1:], above, step)
    if depth < 8:
        bits = np.unpackbits(rows, axis=1)[:, : w * depth].reshape(h, w, depth)
        rows = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8)
        rows = rows if color == 3 else rows * np.uint8(255 // ((1 << depth) - 1))
    image = rows.reshape(h, w, samples)
    if color in (0, 4):
        image = image[..., :1]
    elif color == 3:
        alpha = np.append(np.frombuffer(clear, np.uint8), np.full(len(palette) - len(clear), 255, np.uint8))
        image = np.concatenate([palette, alpha[:, None]], axis=1)[image[..., 0]] if clear else palette[image[..., 0]]
        image = image[..., [2, 1, 0, 3][: image.shape[2]]]
    else:
        image = image[..., [2, 1, 0, 3][:samples]]
    return h, w, image.shape[2], image.reshape(-1)


def unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A line of samples from its filtered bytes and the line above it."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:  # running sums of each byte of a pixel
        padded = np.zeros(-(-len(line) // step) * step, np.uint8)
        padded[: len(line)] = line
        return np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(line)]
    out, up = line.tolist(), above.tolist()
    for i in range(len(out)):
        a, b, c = (out[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = (out[i] + guess) & 255
    return np.array(out, np.uint8)


def fetched(path: str) -> bytes:
    """The file's bytes; a missing file is an error that names it."""
    plain = path.removeprefix("file://") if path.startswith("file:///") else path
    if "://" not in plain:
        with open(plain, "rb") as file:
            return file.read()
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_stream(name) as file:
        return file.read()


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))


class SplitImages(DataSource):
    """Options: path (a folder or file of split CSVs), root (put before image paths that aren't absolute), bytes (of the table, a partition)."""

    @classmethod
    def name(cls) -> str:
        return "split_images"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SplitImagesReader:
        return SplitImagesReader(self.options)


class SplitImagesReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.root = options["path"].removeprefix("file://"), options.get("root", "")
        self.bytes = int(options.get("bytes", RANGE))

    def partitions(self) -> list[Range]:
        if not os.path.exists(self.path):
            raise FileNotFoundError(self.path)
        if os.path.isdir(self.path):
            names = [os.path.join(d, n) for d, _, files in os.walk(self.path) for n in files if not n.startswith((".", "_"))]
        else:
            names = [self.path]
        sizes = {n: table_bytes(n) for n in sorted(names)}
        return [Range(n, lo, min(lo + self.bytes, size)) for n, size in sizes.items() for lo in range(0, size, self.bytes)]

    def read(self, partition: Range):
        path, start, end = partition.value
        held, size = [], 0
        for row in self.lines(path, start, end):
            image = row["image_path"]
            where = image if not self.root or image.startswith("/") or "://" in image else f"{self.root.rstrip('/')}/{image}"
            try:
                h, w, c, pixels = decoded_png(fetched(where))
            except FileNotFoundError:
                raise FileNotFoundError(f"{where}, named in {path}") from None
            except (ValueError, KeyError, struct.error, zlib.error) as e:
                raise ValueError(f"{where} can't be decoded: {e}") from e
            held.append((*(row[k] for k in COLUMNS), h, w, c, pixels))
            size += len(pixels)
            if size >= BATCH:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    @staticmethod
    def lines(path: str, start: int, end: int):
        """The rows whose lines begin in (start, end], after the header's; the first range also has the one at its start."""
        with gzip.open(path) if path.endswith(".gz") else open(path, "rb") as file:
            header = next(csv.reader([file.readline().decode()]))
            if missing := sorted(set(COLUMNS) - set(header)):
                raise ValueError(f"{path}: missing columns {missing}")
            if start > file.tell():
                file.seek(start - 1)
                file.readline()  # the line that begins before is the range's before
            while file.tell() < end and (line := file.readline()):
                for row in csv.reader(io.StringIO(line.decode())):
                    yield dict(zip(header, row, strict=True))


def table_bytes(path: str) -> int:
    """Bytes of a table, of a gzip file (of one member, below 4 GB) when it is unpacked."""
    if not path.endswith(".gz"):
        return os.path.getsize(path)
    with open(path, "rb") as file:
        file.seek(-4, os.SEEK_END)
        return int.from_bytes(file.read(), "little")


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    *plain, pixels = zip(*rows, strict=True)
    kinds = [pa.string()] * 3 + [pa.int32()] * 3
    offsets = np.cumsum([0, *map(len, pixels)]).astype(np.int32)
    flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(pixels).astype(np.int32)))
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(plain, kinds, strict=True)), flat], names=[*COLUMNS, "h", "w", "c", "pixels"])


def read_split_images(spark: SparkSession, path: str, root: str = "", bytes_a_partition: int = RANGE) -> DataFrame:
    """patient_id, class, image_path, h, w, c and pixels of the images a split's CSV names, one row a line.

    A missing file, and one that isn't a decodable PNG, is an error that names it. No other image is listed or read. Lines hold no line
    ends within values. An empty table gives no row.
    """
    spark.dataSource.register(SplitImages)
    return spark.read.format("split_images").option("root", root).option("bytes", bytes_a_partition).load(path)
