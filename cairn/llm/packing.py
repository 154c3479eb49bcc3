"""Best-fit packing of token pieces by minimum bin slack."""

from __future__ import annotations

import base64
import re
import zlib
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm._io import materialise, trimmed

SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """A function from texts to id arrays: those of `tokenizers` for a byte-level BPE file, add_special_tokens=False.

    Where the rank file of the same vocabulary lies beside the JSON file, `tiktoken` gives the same ids several times
    faster; texts that hold a special token's string go to `tokenizers` itself.
    """
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    whole = cache(lambda: Tokenizer.from_file(vocabulary))  # where texts ask for it
    ranks = re.sub(r"\.json$", ".tiktoken", vocabulary)
    if ranks == vocabulary or not os.path.exists(ranks):
        return lambda texts: [np.array(x.ids, "<u4") for x in whole().encode_batch(texts, add_special_tokens=False)]
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(texts):
        return [
            np.array(whole().encode(t, add_special_tokens=False).ids if SPECIAL in t else fast.encode_ordinary(t), "<u4") for t in texts
        ]

    return encode


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's ids and `end_id`, cut from the end.

    All pieces but the first have `capacity` ids. Null and empty texts give one piece that holds `end_id`. Null ids stay
    null, rows that repeat an id give pieces of their own, an empty table none, and columns but doc_id and text aren't
    read.
    """

    def cut(batches):
        try:
            yield from pieces(encoder(vocabulary), batches)
        finally:
            encoder.cache_clear()  # else each of the executor's idle workers comes to hold one

    def pieces(encode, batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.append(encode([text or ""])[0], np.uint32(end_id)).astype("<u4")
                head = (len(ids) - 1) % capacity + 1
                for piece, start in enumerate([0, *range(head, len(ids), capacity)]):
                    part = ids[start : head if not piece else start + capacity]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), part.tolist() if with_ids else None))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            for lo in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 20_000], strict=True), kinds, strict=False)], names=names
                )

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())][: 5 + with_ids]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(cut), schema)


def fullest(counts: dict[int, int], room: int, lengths: list[int]) -> dict[int, int]:
    """The fullest multiset of available lengths within `room`: subset sums as bits of one integer.

    `lengths` descend, so of the fullest sets one with large members is found. A length's copies come in powers of
    two; each step keeps the sums it could reach, for the way back.
    """
    sums, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in lengths:
        if length > room:
            continue
        left, copies = min(counts[length], room // length), 1
        while left:
            copies = min(copies, left)
            left -= copies
            grown = (sums | sums << (length * copies)) & mask
            steps.append((sums, length, copies))
            sums, copies = grown, copies * 2
        if sums >> room & 1:
            break
    at, used = sums.bit_length() - 1, {}
    for before, length, copies in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + copies
            at -= length * copies
    return used


def bin_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(bins, lengths of each) in order: minimum bin slack with the longest piece left as the bin's first.

    A combination is used for as many bins as its scarcest length allows. Each use leaves a length with fewer
    pieces than the combination takes, so the plan's size depends on `capacity` alone (some thousands at 1024).
    """
    counts, plan = {k: v for k, v in histogram.items() if v > 0}, []
    lengths = sorted(counts, reverse=True)
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        used = fullest(counts, capacity - first, lengths)
        counts[first] += 1
        used[first] = used.get(first, 0) + 1
        bins = min(counts[k] // n for k, n in used.items())
        plan.append((bins, used))
        for k, n in used.items():
            counts[k] -= bins * n
        lengths = [k for k in lengths if counts[k]]
    return plan


def plan_table(plan) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first bin, pieces a bin, place of the first in a bin)."""
    rows, taken, base = {}, {}, 0
    for bins, used in plan:
        place = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            rows.setdefault(length, []).append((taken.get(length, 0), base, n, place))
            taken[length] = taken.get(length, 0) + bins * n
            place += length * n
        base += bins
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack_pieces(pieces: DataFrame, capacity: int = 1024, cell: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to `pieces` (doc_id, piece, start, length in 1..capacity, ids_crc32, any others).

    Only the histogram of lengths (at most `capacity` rows) reaches the driver, where the bins are planned; every
    piece finds its own place from its rank among the pieces of its length. Ranks come from two levels: counts by
    (length, salt), then a window inside one salt of about `cell` pieces at most, so that no length stands in one task.
    Pieces that agree in doc_id, piece and ids_crc32 are interchangeable, null ids too. An empty table gives none.
    Columns of pieces named sequence_id or offset are replaced; others may have any name.
    """
    pieces = pieces.drop("sequence_id", "offset")
    rows = materialise(pieces.select(F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("row")))
    histogram = {r["length"]: r["count"] for r in rows.groupBy(F.col("row.length").alias("length")).count().collect()}
    salts = max(histogram.values(), default=0) // cell + 1
    salt = F.pmod(F.xxhash64("row.doc_id", "row.piece", "row.ids_crc32"), F.lit(salts))
    rows = rows.withColumns({"length": F.col("row.length"), "salt": salt})
    above = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("length", "salt").count()
    cells = cells.withColumn("above", F.coalesce(F.sum("count").over(above), F.lit(0))).select("length", "salt", "above")
    table = rows.sparkSession.sparkContext.broadcast(plan_table(bin_plan(histogram, capacity)))
    inside = Window.partitionBy("length", "salt").orderBy("row.doc_id", "row.piece", "row.ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(inside) - 1).join(cells, ["length", "salt"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), np.int64)
        for k, at in pd.Series(np.arange(len(length))).groupby(length.to_numpy()).indices.items():
            rows = table.value[int(k)]
            own = rank.to_numpy()[at]
            row = rows[np.searchsorted(rows[:, 0], own, "right") - 1]
            nth = own - row[:, 0]
            out[at, 0] = row[:, 1] + nth // row[:, 2]
            out[at, 1] = row[:, 3] + nth % row[:, 2] * int(k)
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    placed = ranked.withColumn("place", place("length", F.col("above") + F.col("rank")))
    return placed.select("row.*", "place.sequence_id", "place.offset")
