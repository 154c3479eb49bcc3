"""Substring dedup by prefix-partitioned suffix trees: words of windows that an earlier document has are removed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm._io import materialise, partitions, text_buffer
from cairn.llm._repeats import ALONE, HOT, SPAN, VERDICT, Spec, classed, context_rows, cut_rows, judged, spans

#: Bytes of suffixes in a group; longer prefixes split a group with more.
GROUP_BYTES = 1 << 23
#: Prefixes that are too frequent are told to all tasks up to this many bytes (32 a prefix beside its words), else they are joined.
BROADCAST_BYTES = 1 << 25
#: Equal suffixes of one batch beyond this many are sent once.
OFTEN = 8
#: Bytes that are compared at a time.
CELLS = 1 << 18

SUFFIX = "cls long, doc long, start long, at long, n long, suffix string"
SUFFIX_ARROW = pa.schema([*((c, pa.int64()) for c in ("cls", "doc", "start", "at", "n")), ("suffix", pa.string())])


class Suffixes:
    """Suffixes of records, a space after each word: a suffix of n windows runs from its first word to its record's end.

    Of a seed without another class one window is enough; of a hot seed each suffix is one window, so that equal ones meet.
    """

    def __init__(self, length: int):
        self.length, self.out, self.found = length, [], {}

    def add(self, text: bytes, doc: int, records) -> None:
        words = text.split()
        flat = b" ".join([*words, b""])
        edges = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
        for cls, _, start, count, kind in zip(*(x.tolist() for x in records), strict=True):
            for at in range(1 if kind == ALONE else count):
                n = 1 if kind in (ALONE, HOT) else count - at
                suffix = flat[edges[start + at] : edges[start + at + n - 1 + self.length]]
                self.found.setdefault(suffix, []).append((cls, doc, start, at, n))

    def rows(self):
        for suffix, places in self.found.items():
            least = min(p[1] for p in places) if len(places) > OFTEN else None
            # Many equal suffixes of a batch: those of later documents are known as repeated and bear no text.
            self.out += [(*p, suffix.decode() if least is None or p[1] == least else None) for p in places]
        self.found = {}
        for lo in range(0, len(self.out), 20_000):
            columns = zip(zip(*self.out[lo : lo + 20_000], strict=True), SUFFIX_ARROW.types, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], schema=SUFFIX_ARROW)
        self.out = []


def prefix(words: int) -> Column:
    return F.substring_index("suffix", " ", words)


def prefixed(suffixes: DataFrame, length: int, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Adds `prefix`: the fewest words of 4, 8 or `length` that suffixes of at most `group_bytes` begin with; and `flat`.

    The counts cover all suffixes. Only suffixes under prefixes that are too frequent are counted again by more words. A
    prefix of `length` words is a window itself: its suffixes are cut to it (`flat`), so however many they are, its
    subtree is one node, which a task reads as a stream.
    """
    steps = [k for k in (4, 8) if k < length]
    rows, longer = suffixes, []
    for k in steps:
        size = F.sum(F.octet_length("suffix") + 32)
        often = rows.where("suffix is not null").groupBy(prefix(k).alias(f"p{k}")).agg(size.alias("size")).where(F.col("size") > group_bytes)
        often = materialise(often.select(f"p{k}"))
        told = often.agg(F.sum(F.octet_length(f"p{k}") + 32)).first()[0]
        if told is None:
            break
        often = F.broadcast(often) if told <= BROADCAST_BYTES else often.hint("merge")
        longer.append((k, often))
        rows = rows.join(often, prefix(k) == often[f"p{k}"], "left_semi")
    for k, often in longer:
        suffixes = suffixes.join(often, prefix(k) == often[f"p{k}"], "left")
    chosen = prefix([*steps, length][len(longer)])
    for k, _ in reversed(longer):
        chosen = F.when(F.col(f"p{k}").isNull(), prefix(k)).otherwise(chosen)
    flat = F.lit(len(longer) == len(steps))
    for k, _ in longer:
        flat = flat & F.col(f"p{k}").isNotNull()
    cut = F.when(flat, F.concat(prefix(length), F.lit(" "))).otherwise(F.col("suffix"))
    return suffixes.withColumns({"prefix": chosen, "flat": flat, "suffix": cut}).drop(*(f"p{k}" for k, _ in longer))


def common_bytes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes each string shares with the one before it; 0 for the first."""
    sizes, out = np.diff(offsets), np.zeros(len(offsets) - 1, np.int64)
    most = np.minimum(sizes[1:], sizes[:-1])
    live, at, width = np.arange(1, len(sizes)), 0, 32
    while len(live):
        step = max(1, CELLS // width)
        for own in (live[lo : lo + step] for lo in range(0, len(live), step)):
            k = at + np.arange(width)
            one, two = (data[np.minimum(offsets[x, None] + k, len(data) - 1)] for x in (own, own - 1))
            apart = (one != two) | (k >= most[own - 1, None])
            out[own] = at + np.where(apart.any(axis=1), apart.argmax(axis=1), width)
        live = live[out[live] == at + width]
        at, width = at + width, min(2 * width, CELLS)
    return out


def depths(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For sorted suffixes, the depth in words of the node that joins each to the one before; 0 for the first."""
    spaces = np.flatnonzero(data == 0x20)
    return np.searchsorted(spaces, offsets[:-1] + common_bytes(data, offsets)) - np.searchsorted(spaces, offsets[:-1])


def nodes(depth: np.ndarray, least: int):
    """The internal nodes of subtrees that are at least `least` words deep, the shallow ones first: (depth, their first
    leaves, the ends of their leaves). `depth` is that of each sorted leaf and the one before.

    A node's leaves are neighbours that share no fewer words than it is deep, and two of them no more.
    """
    for d in np.unique(depth[depth >= least]).tolist():
        first = np.flatnonzero(depth < d)
        own = np.add.reduceat((depth == d).astype(np.int64), first) > 0
        yield d, first[own], np.append(first[1:], len(depth))[own]


def repeated_windows(depth: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """For each leaf, how many windows from its start on the deepest node above it has that an earlier document is under too."""
    out = np.zeros(len(doc), np.int64)
    for d, first, end in nodes(depth, length):
        size = end - first
        leaves = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
        own = doc[leaves]
        least = np.minimum.reduceat(own, np.cumsum(size) - size)
        out[leaves[own > np.repeat(least, size)]] = d - length + 1
    return out


def subtrees(length: int, held_bytes: int = 2 * GROUP_BYTES):
    """Batches of suffixes in the order of (suffix, doc) to verdicts, of `held_bytes` at a time and what ends their last node.

    Suffixes that share their first `length` words are held together: they lie in one group, whose size is bounded. Only
    a flat group may be parted, since its one node's first leaf is of its least document, which goes on into what follows.
    """

    def grow(table: pa.Table, before, last: bool):
        """Verdicts of the first rows, the number of these rows, and (suffix, least document) of a node that goes on."""
        data, offsets = text_buffer(table["suffix"].combine_chunks())
        doc = table["doc"].to_numpy()
        depth = depths(data, offsets)
        edges = np.flatnonzero(depth < length)
        parted = table["flat"][-1].as_py() and not last
        end = len(doc) if last or parted else int(edges[-1])
        n = repeated_windows(depth[:end], doc[:end], length)
        goes_on = before is not None and data[: offsets[1]].tobytes() == before[0]
        if goes_on:
            first_end = edges[1] if len(edges) > 1 else len(doc)
            n[:first_end] = doc[:first_end] > before[1]
        after = None
        if parted:
            least = before[1] if goes_on and len(edges) == 1 else int(doc[edges[-1]])
            after = data[offsets[-2] :].tobytes(), least
        columns = [table[c].slice(0, end).combine_chunks() for c in ("cls", "doc", "start", "at")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n)], names=["cls", "doc", "start", "at", "n"]), end, after

    def run(batches):
        held, size, before = [], 0, None
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= held_bytes and batch.num_rows:
                table = pa.Table.from_batches(held)
                said, end, after = grow(table, before, last=False)
                if end:
                    yield said
                    before = after
                held = table.slice(end).to_batches()
                size = sum(b.nbytes for b in held)
        if sum(b.num_rows for b in held):
            yield grow(pa.Table.from_batches(held), before, last=True)[0]

    return run


def tree_verdicts(suffixes: DataFrame, length: int, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Splits suffixes by prefix into groups, makes subtrees of each, and says what repeats.

    Whole groups go to as many partitions as hold `group_bytes` each on average.
    """
    size = suffixes.agg(F.sum(F.octet_length("suffix") + 32)).first()[0] or 0
    parts = max(size // group_bytes + 1, partitions(suffixes.sparkSession))
    given = prefixed(suffixes.where("suffix is not null"), length, group_bytes)
    leaves = given.select("cls", "doc", "start", "at", "suffix", "flat", F.xxhash64("prefix").alias("group")).repartition(parts, "group")
    leaves = leaves.drop("group").sortWithinPartitions("suffix", "doc")
    known = suffixes.where("suffix is null").select("cls", "doc", "start", "at", "n")
    found = materialise(leaves.mapInArrow(subtrees(length, 2 * group_bytes), VERDICT).union(known))
    heads = found.where("at = 0").select("cls", "doc", "start", F.lit(0).cast("long"), F.lit(0).cast("long"))
    return found.where("n > 0").union(heads)


def remove_repeats(docs: DataFrame, length: int = 13, **spread) -> DataFrame:
    """All columns of `docs` but text, and n_words, spans (removed, as first word and end), kept (the rest, by one space).

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A word goes when a window of `length` words that covers it also starts
    in a document of smaller doc_id; windows are judged on the input and don't cross documents. One text of each class
    of equal records goes to the trees, where suffixes are compared by their words; equal records (by two 64-bit
    fingerprints, of seed and text) follow it. Suffixes run to the end of their record and are split by prefixes of as
    many words as leave a group small; a suffix's run of removed words is as long as the deepest node of `length` words or
    more that an earlier document is under too.
    Null text has no words. Rows without doc_id lose nothing and count for nothing. Rows that repeat a doc_id with its
    text get the same spans; where the texts of an id differ, that of the least hash is the document and the other rows
    lose nothing and count for nothing. Columns of docs named n_words, spans or kept are replaced. Empty tables give
    none.
    `spread`: hot and hot_total of Spec.
    """
    docs = docs.drop("n_words", "spans", "kept")
    spec = Spec(by_word=True, seed=4, length=length, within=False, **spread)
    given = judged(docs)
    classes = classed(given, spec)
    suffixes = materialise(context_rows(given, classes, lambda: Suffixes(length), SUFFIX))
    found = spans(classes, tree_verdicts(suffixes, length), spec)
    fields = [f for f in docs.schema.fields if f.name != "text"]
    kind = T._parse_datatype_string(f"n_words long, spans {SPAN}, kept string")

    def cut(text, first, n):
        words = text.split()
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, first, 1)
        np.add.at(gone, np.minimum(first + n - 1 + length, len(words)), -1)
        gone = np.cumsum(gone)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if len(edges) else b" ".join(words)
        return len(words), [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)], kept.decode()

    return cut_rows(given, found, cut, fields, T.StructType([*fields, *kind.fields]))
