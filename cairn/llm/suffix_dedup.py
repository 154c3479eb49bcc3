"""Suffix-array dedup: bytes of long strings that started earlier are removed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm._io import materialise, shuffles_freed, trimmed_group
from cairn.llm._repeats import ALONE, HOT, SPAN, Spec, classed, context_rows, cut_rows, judged, spans

#: The documents enter the index in so many batches, by ranges of doc_id.
BATCHES = 4
#: Bytes of text that a part of the index holds on average.
PART_BYTES = 1 << 21

CONTEXT = "seed long, cls long, doc long, start long, at long, count long, text binary"
CONTEXT_ARROW = pa.schema([*((c, pa.int64()) for c in ("seed", "cls", "doc", "start", "at", "count")), ("text", pa.binary())])
#: A level holds, for each part, the text of its suffixes and their places in order: its suffix array.
INDEXED = "part long, cls long, doc long, start long, at long, n long, text binary, array binary"
INDEXED_ARROW = pa.schema([*((c, pa.int64()) for c in ("part", "cls", "doc", "start", "at", "n")), ("text", pa.binary()), ("array", pa.binary())])


class Contexts:
    """Cuts the texts of records out of documents. A hot seed's windows go one by one, equal ones of a batch once."""

    def __init__(self, length: int):
        self.length, self.out, self.windows = length, [], {}

    def add(self, text: bytes, doc: int, records) -> None:
        for cls, seed, start, count, kind in zip(*(x.tolist() for x in records), strict=True):
            if kind != HOT:
                # A seed without another class: one suffix stands for the class.
                n = 1 if kind == ALONE else count
                self.out.append((seed, cls, doc, start, 0, n, text[start : start + n - 1 + self.length]))
                continue
            for at in range(count):
                window = text[start + at : start + at + self.length]
                self.windows.setdefault(window, []).append((doc, start + at, cls, start, at))

    def rows(self):
        for window, places in self.windows.items():
            least = min(places)
            for place in places:
                doc, _, cls, start, at = place
                # A later place of the window is known as repeated; its row bears no text.
                self.out.append((0, cls, doc, start, at, 1, window if place == least else None))
        self.windows = {}
        for lo in range(0, len(self.out), 20_000):
            columns = zip(zip(*self.out[lo : lo + 20_000], strict=True), CONTEXT_ARROW.types, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], schema=CONTEXT_ARROW)
        self.out = []


def suffixes(text: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """The `length` bytes from each place on, as strings that sort bytewise."""
    if not len(places):
        return np.zeros(0, f"S{length}")
    rows = np.lib.stride_tricks.sliding_window_view(text, length)[places]
    return np.ascontiguousarray(rows).view(f"S{length}").ravel()


def common_prefixes(array: np.ndarray) -> np.ndarray:
    """How many bytes each suffix of a sorted array shares with the one before it; 0 for the first."""
    width = array.dtype.itemsize
    rows, out = array.view(np.uint8).reshape(-1, width), np.zeros(len(array), np.int64)
    for lo in range(1, len(array), 1 << 16):
        apart = rows[lo : lo + (1 << 16)] != rows[lo - 1 : lo - 1 + len(rows[lo : lo + (1 << 16)])]
        out[lo : lo + (1 << 16)] = np.where(apart.any(axis=1), apart.argmax(axis=1), width)
    return out


def merge_scan(level: np.ndarray, batch: np.ndarray) -> np.ndarray:
    """Which suffixes of a sorted batch have a match over their whole length in a sorted level.

    The two runs are merged (the stable sort finds them and merges in one pass); a suffix that is joined to one of the
    level by common prefixes of whole length is matched.
    """
    both = np.concatenate([level, batch])
    order = np.argsort(both, kind="stable")
    whole = common_prefixes(both[order]) == both.dtype.itemsize
    first = np.flatnonzero(~whole)[np.cumsum(~whole) - 1]
    known = np.zeros(len(both), bool)
    known[order] = order[first] < len(level)
    return known[len(level) :]


def merge_levels(length: int):
    """Group function: the levels' suffix arrays of a part, merged."""

    def run(table: pa.Table) -> pa.Table:
        texts = table["text"].to_pylist()
        arrays = [np.frombuffer(a, np.int64) for a in table["array"].to_pylist()]
        base = np.cumsum([0, *map(len, texts[:-1])])
        text = np.frombuffer(b"".join(texts), np.uint8)
        places = np.concatenate([a + b for a, b in zip(arrays, base, strict=True)])
        places = places[np.argsort(suffixes(text, places, length), kind="stable")]
        return level_row(table["part"][0].as_py(), text.tobytes(), places)

    return run


def level_row(part: int, text: bytes, places: np.ndarray) -> pa.Table:
    zero = [0]
    columns = [[part], zero, zero, zero, zero, [len(places)], [text], [places.astype(np.int64).tobytes()]]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, INDEXED_ARROW.types, strict=True)], schema=INDEXED_ARROW)


def scan_batch(length: int):
    """Group function of a part: a batch gets its suffix array, which is merge-scanned against the part of each level.

    Returns what is repeated, a row with n = 0 for each record, and what is new as a part of a new level.
    """

    def run(table: pa.Table) -> pa.Table:
        old = table["array"].is_valid().to_numpy(zero_copy_only=False)
        levels, batch = table.filter(pa.array(old)), table.filter(pa.array(~old))
        batch = batch.sort_by([("doc", "ascending"), ("start", "ascending"), ("at", "ascending")])
        cls, doc, start, at, n = (batch[c].to_numpy() for c in ("cls", "doc", "start", "at", "n"))
        twice = np.zeros(len(batch), bool)  # rows of a document that stands twice
        twice[1:] = (doc[1:] == doc[:-1]) & (start[1:] == start[:-1]) & (at[1:] == at[:-1]) & (cls[1:] == cls[:-1])
        own = np.flatnonzero(~twice)
        texts = batch["text"].take(pa.array(own)).to_pylist()
        text, count = np.frombuffer(b"".join(texts), np.uint8), n[own]
        base = np.cumsum([0, *map(len, texts[:-1])]) if texts else np.zeros(0, np.int64)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        places, context = np.repeat(base, count) + nth, np.repeat(np.arange(len(own)), count)
        strings = suffixes(text, places, length)
        order = np.argsort(strings, kind="stable")
        array = strings[order]
        again = common_prefixes(array) == length  # the earliest place of equal suffixes comes first
        known = again.copy()
        for places_, text_ in zip(levels["array"].to_pylist(), levels["text"].to_pylist(), strict=True):
            known |= merge_scan(suffixes(np.frombuffer(text_, np.uint8), np.frombuffer(places_, np.int64), length), array)
        repeated = np.zeros(len(places), bool)
        repeated[order] = known
        edges = np.flatnonzero(repeated & ~(np.concatenate([[False], repeated[:-1]]) & (nth > 0)))
        ends = np.flatnonzero(repeated & ~np.concatenate([repeated[1:] & (nth[1:] > 0), [False]]))
        of = own[context[edges]]
        heads = np.flatnonzero((at == 0) & ~twice)
        zeros, part = np.zeros(len(heads), np.int64), table["part"][0].as_py()
        rows = np.concatenate([of, heads])
        columns = [
            np.full(len(rows), part), cls[rows], doc[rows], start[rows],
            np.concatenate([at[of] + nth[edges], zeros]), np.concatenate([ends - edges + 1, zeros]),
        ]
        nulls = pa.nulls(len(rows), pa.binary())
        said = pa.Table.from_arrays([*(pa.array(np.asarray(c, np.int64)) for c in columns), nulls, nulls], schema=INDEXED_ARROW)
        fresh = order[~known]  # in order of suffixes
        if not len(fresh):
            return said
        kept = np.zeros(len(own), bool)
        kept[context[fresh]] = True
        sizes = np.array([len(t) for t in texts])
        moved = np.cumsum(np.where(kept, sizes, 0)) - np.where(kept, sizes, 0)
        new = moved[context[fresh]] + nth[fresh]
        return pa.concat_tables([said, level_row(part, b"".join(t for t, k in zip(texts, kept, strict=True) if k), new)])

    return run


class IndexFamily:
    """Suffix arrays in levels of geometrically growing size, written in the shared folder.

    A level is a table with a row for each part of the suffixes (those of one seed are in one part). A suffix stands
    once, as its earliest batch put it.
    """

    def __init__(self, length: int):
        self.length, self.levels = length, []  # (suffixes, table)

    def merge(self) -> None:
        """Merges the last two levels while they are of one size, as the power of two below it."""
        while len(self.levels) > 1 and self.levels[-2][0].bit_length() <= self.levels[-1][0].bit_length():
            (n, one), (m, two) = self.levels[-2:]
            both = one.union(two).groupBy("part").applyInArrow(trimmed_group(merge_levels(self.length)), INDEXED)
            self.levels[-2:] = [(n + m, materialise(both))]

    def add(self, batch: DataFrame) -> DataFrame:
        """What repeats an earlier suffix of this or an earlier batch. `batch`: part, cls, doc, start, at, count, text.

        What is new becomes a level. Levels of one size merge before the next batch is scanned.
        """
        self.merge()
        rows = batch.select("part", "cls", "doc", "start", "at", F.col("count").alias("n"), "text", F.lit(None).cast("binary").alias("array"))
        for _, level in self.levels:
            rows = rows.union(level)
        found = materialise(rows.groupBy("part").applyInArrow(trimmed_group(scan_batch(self.length)), INDEXED))
        fresh = found.where("array is not null")
        size = fresh.agg(F.sum("n")).first()[0]
        if size:
            self.levels.append((size, fresh))
        return found.where("array is null").select("cls", "doc", "start", "at", "n")


def index_verdicts(contexts: DataFrame, length: int, batches: int = BATCHES) -> DataFrame:
    """Puts the documents' contexts into an index family, batch by batch in the order of doc_id."""
    given = contexts.where("text is not null")
    found = given.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    cuts = sorted(set(given.approxQuantile("doc", [k / batches for k in range(1, batches)], 0.01))) if found else []
    # A hot seed's windows are dealt by themselves.
    key = F.when(F.col("seed") != 0, F.xxhash64("seed")).otherwise(F.xxhash64("text"))
    given = given.withColumn("part", F.pmod(key, F.lit(found // PART_BYTES + 1)))
    bare = contexts.where("text is null").select("cls", "doc", "start", "at", "count")
    verdicts, family = bare.union(bare.where("at = 0").withColumn("count", F.lit(0).cast("long"))).toDF("cls", "doc", "start", "at", "n"), IndexFamily(length)
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        inside = F.lit(True)
        if lo is not None:
            inside = inside & (F.col("doc") > int(lo))
        if hi is not None:
            inside = inside & (F.col("doc") <= int(hi))
        verdicts = verdicts.union(family.add(given.where(inside)))
    return verdicts


def remove_repeats(docs: DataFrame, length: int = 100, whole_characters: bool = False, batches: int = BATCHES, **spread) -> DataFrame:
    """All columns of `docs` but text, and n_bytes, spans (removed, as start and end), kept (the bytes that remain).

    A byte goes when a `length`-byte string that covers it also starts earlier: in a row of a smaller doc_id, or
    before in the same one. Strings are judged on the input and don't cross documents. One text of each class of equal
    records goes to the index, where suffixes are compared over their whole length; equal records (by two 64-bit
    fingerprints, of seed and text) follow it. `whole_characters` narrows each span to whole UTF-8 characters.
    Null text counts as empty. Rows without doc_id lose nothing and count for nothing. Rows that repeat a doc_id with
    its text are one document and get the same spans; where the texts of an id differ, that of the least hash is the
    document and the other rows lose nothing and count for nothing. Columns of docs named n_bytes, spans or kept are
    replaced. Empty tables give none.
    `batches`: into how many ranges of doc_id the documents are split for the index. `spread`: hot and hot_total of Spec.
    """
    docs = docs.drop("n_bytes", "spans", "kept")
    spec = Spec(by_word=False, seed=24, length=length, within=True, **spread)
    with shuffles_freed(docs.sparkSession):
        given = judged(docs)
        classes = classed(given, spec)
        contexts = materialise(context_rows(given, classes, lambda: Contexts(length), CONTEXT))
        found = spans(classes, index_verdicts(contexts, length, batches), spec)
    fields = [f for f in docs.schema.fields if f.name != "text"]
    kind = T._parse_datatype_string(f"n_bytes long, spans {SPAN}, kept binary")

    def cut(text, first, n):
        own, left, at = [], [], 0
        if len(first):
            ends = np.minimum(np.maximum.accumulate(first + n - 1 + length), len(text))
            new = np.ones(len(first), bool)
            new[1:] = first[1:] > ends[:-1]
            own = list(zip(first[new].tolist(), ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)].tolist(), strict=True))
        if whole_characters:
            own = [(a, b) for a, b in (narrow(text, a, b) for a, b in own) if a < b]
        for a, b in own:
            left.append(text[at:a])
            at = b
        left.append(text[at:])
        return len(text), [{"start": a, "end": b} for a, b in own], b"".join(left)

    return cut_rows(given, found, cut, fields, T.StructType([*fields, *kind.fields]))


def narrow(text: bytes, start: int, end: int) -> tuple[int, int]:
    """The largest part of a span that holds whole UTF-8 characters."""
    while start < end and text[start] & 0xC0 == 0x80:
        start += 1
    while end > start and end < len(text) and text[end] & 0xC0 == 0x80:
        end -= 1
    return start, end
