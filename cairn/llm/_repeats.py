"""What the suffix-array and the suffix-tree operator share: which strings can repeat at all, and the way back.

A window is `length` consecutive units (bytes or words) of a document. Every window is charged to its anchor: the place
in it whose seed (`seed` units) has the least fingerprint, so equal windows have equal anchors and equal seeds.
Consecutive windows of one anchor make a record, about one for every `length - seed` / 2 units; records of one seed and
one text make a class.

1. `classed`: records are sorted by seed. A seed that occurs once has no repeated window and is dropped. Of every other
   class the earliest record stands for the class; the others are its followers.
2. `context_rows`: the records that stand for classes get their texts from their documents.
3. An index (suffix arrays or trees) compares these texts unit by unit and says which windows repeat earlier ones.
4. `spans`: each follower takes the verdict of its class, as the index gives it: all its windows when the class's first
   place counts as earlier, else those that are repeated at that place.
5. `cut_rows`: spans go to their documents, one row a document.

Nothing is gathered by key: sorts, joins and streams of batches carry all steps, so a task's memory doesn't follow the
number of a key's rows. Records that agree are merged in each batch of documents before the shuffle, and a seed with
many surroundings (more than `hot` in a batch) is spread by its surroundings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._hash import GRAM, SpanHash, grams, mix, sliding_min, word_hashes, words
from cairn.llm._io import materialise, partitions, row_chunks, slices, text_buffer, trimmed

#: Kinds of rows: a record, one of a spread seed, a seed that is spread elsewhere, a follower; a class whose seed has no
#: other class, one that shares its seed, a seed with very many classes; a follower of a class with many in its batch.
NORMAL, SPREAD, MARKER, FOLLOWER, ALONE, SHARED, HOT, CROWDED = range(8)
#: Bit of a record that stands for followers of its batch.
LEADS = 8
#: A class with more followers in a batch than this deals all such followers to this many tasks when they meet its verdict.
CROWD = 64
SEGMENT = 1 << 20
#: Records whose texts a task holds before it gives them out.
HELD = 5_000
#: Packed bytes of the documents that a task cuts at a time.
CUT_BYTES = 1 << 20
#: Bytes of texts that a task packs at a time, and rows that it gives out at a time.
SQUEEZED, GIVEN = 1 << 22, 1 << 16


@dataclass(frozen=True)
class Spec:
    by_word: bool
    seed: int
    length: int
    within: bool  # whether an earlier start in the same document counts
    hot: int = 256  # classes of a seed in a batch, and in all, beyond which it is spread
    hot_total: int = 10_000

    @property
    def less(self) -> int:
        """A byte's value is that of the gram from it on: a span has so many values less than bytes."""
        return 0 if self.by_word else GRAM - 1


@dataclass
class Units:
    values: np.ndarray  # 64 bits a unit
    offsets: np.ndarray  # of the rows, in units


def units(data: np.ndarray, offsets: np.ndarray, spec: Spec) -> Units:
    if not spec.by_word:
        return Units(grams(data), offsets)
    starts, ends, rows = words(data, offsets)
    return Units(word_hashes(data, starts, ends), rows)


def anchored(values: np.ndarray, offsets: np.ndarray, spec: Spec):
    """(row, first window, windows, seed, text) of the records of some rows; positions within `values`."""
    n, empty = len(values), np.zeros(0, np.int64)
    if n < spec.length:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    spans = SpanHash(values)
    at = np.arange(n - spec.seed + 1)
    seeds = spans(at, at + spec.seed - spec.less)
    order = (seeds & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    anchor = (sliding_min(order, spec.length - spec.seed + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    windows = np.flatnonzero(row_of[: n - spec.length + 1] == row_of[spec.length - 1 :])
    if not len(windows):
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    anchor = anchor[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(windows)))
    start, anchor = windows[first], anchor[first]
    text = spans(start, start + count - 1 + spec.length - spec.less) ^ mix((anchor - start).astype(np.uint64))
    return row_of[start], start, count, seeds[anchor], text


def batch_records(batch: pa.RecordBatch, spec: Spec):
    """(doc, start, windows, seed, text) of all rows of a batch; long rows by overlapping segments."""
    data, offsets = text_buffer(batch["text"])
    ids = batch["id"].to_numpy(zero_copy_only=False)
    parts = []
    for lo, hi in row_chunks(offsets, SEGMENT):
        own = units(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], spec)
        if len(own.values) <= 2 * SEGMENT:
            row, start, *rest = anchored(own.values, own.offsets, spec)
            parts.append((ids[lo + row], start - own.offsets[row], *rest))
            continue
        for base in range(0, len(own.values), SEGMENT):
            piece = own.values[base : base + SEGMENT + spec.length - 1]
            row, start, *rest = anchored(piece, np.array([0, len(piece)]), spec)
            parts.append((ids[lo + row], start + base, *rest))
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2


def class_names(seed: np.ndarray, text: np.ndarray) -> np.ndarray:
    return mix(seed ^ mix(text)).view(np.int64)


def longs(**columns) -> pa.RecordBatch:
    return pa.record_batch({k: pa.array(np.asarray(v, np.int64)) for k, v in columns.items()})


RECORDS = "seed long, text long, doc long, start long, kind long"


def to_records(spec: Spec):
    """Batches of (id, text) to records, of which each batch's first of a class leads; kind: windows, and what the row is."""

    def rows(seed, text, doc, start, count, kind):
        return longs(seed=seed.view(np.int64), text=text.view(np.int64), doc=doc, start=start, kind=count * 16 + kind)

    def merged(batch):
        doc, start, count, seed, text = batch_records(batch, spec)
        order = np.lexsort((start, doc, text, seed))
        doc, start, count, seed, text = (x[order] for x in (doc, start, count, seed, text))
        new = np.ones(len(doc), bool)
        new[1:] = (seed[1:] != seed[:-1]) | (text[1:] != text[:-1])
        follows, lead = np.flatnonzero(~new), np.flatnonzero(new)
        if not len(lead):
            return
        name = class_names(seed[follows], text[follows]).view(np.uint64)
        followers = np.diff(np.append(lead, len(doc))) - 1
        crowded = np.repeat(followers > CROWD, followers)
        yield rows(name, np.zeros(len(name), np.uint64), doc[follows], start[follows], count[follows], np.where(crowded, CROWDED, FOLLOWER))
        leads = followers > 0
        doc, start, count, seed, text = (x[lead] for x in (doc, start, count, seed, text))
        _, own, n = np.unique(seed, return_inverse=True, return_counts=True)
        hot = n[own] > spec.hot
        marked = np.unique(seed[hot])
        zeros = np.zeros(len(marked), np.int64)
        yield rows(marked, zeros.view(np.uint64), zeros, zeros, zeros, MARKER)
        yield rows(seed, text, doc, start, count, np.where(hot, SPREAD, NORMAL) + leads * LEADS)

    def run(batches):
        for batch in slices(batches, 1 << 24):
            for out in merged(batch):  # whose arrays go before the next ones are made
                for lo in range(0, out.num_rows, GIVEN):
                    yield out.slice(lo, GIVEN)

    return run


CLASSED = "cls long, seed long, doc long, start long, count long, kind long"


def settled(spec: Spec):
    """Records in the order of (seed, text, doc, start) to classes' first records, followers, and seeds that are hot.

    A stream: of what came before only the last class's first record is kept, with the number of its seed's classes.
    """

    def run(batches):
        held = None  # (seed, text, doc, start, count, leads, given out), and how many classes its seed has so far
        classes = 0

        def rows(seed, text, doc, start, count, kind):
            kind = np.full(len(seed), kind) if np.isscalar(kind) else kind
            return longs(cls=class_names(seed, text), seed=seed.view(np.int64), doc=doc, start=start, count=count, kind=kind)

        def last(held, classes):
            one = [np.array([x]) for x in held]
            if classes == 1 and one[5][0]:
                yield rows(*one[:5], ALONE)
            if classes > spec.hot_total:
                yield rows(*one[:5], HOT)

        for batch in batches:
            seed, text = (batch[c].to_numpy().view(np.uint64) for c in ("seed", "text"))
            doc, start, kind = (batch[c].to_numpy() for c in ("doc", "start", "kind"))
            count, leads, kind = kind >> 4, kind & LEADS > 0, kind & (LEADS - 1)
            passed = (kind == FOLLOWER) | (kind == CROWDED)
            if passed.any():
                yield longs(cls=seed[passed].view(np.int64), seed=np.zeros(passed.sum()), doc=doc[passed], start=start[passed], count=count[passed], kind=kind[passed])
            marks = kind == MARKER
            if marks.any():
                yield rows(seed[marks], text[marks], doc[marks], start[marks], count[marks], HOT)
            live = ~passed & ~marks
            if not live.any():
                continue
            spread = kind[live] == SPREAD
            columns = [x[live] for x in (seed, text, doc, start, count, leads)] + [np.zeros(live.sum(), bool)]
            if held is not None:
                columns = [np.concatenate([[h], x]).astype(x.dtype) for h, x in zip(held, columns, strict=True)]
                spread = np.concatenate([[False], spread])
            s, t, d, p, c, more, given = columns
            new_seed, new = np.ones(len(s), bool), np.ones(len(s), bool)
            new_seed[1:] = s[1:] != s[:-1]
            new[1:] = new_seed[1:] | (t[1:] != t[:-1])
            if not new.all():
                yield rows(*(x[~new] for x in (s, t, d, p, c)), FOLLOWER)
            lead = np.flatnonzero(new)
            more = more[lead] | (np.diff(np.append(lead, len(s))) > 1)
            s, t, d, p, c, given, spread = (x[lead] for x in (s, t, d, p, c, given, spread))
            edges = np.flatnonzero(new_seed[lead])
            n = np.diff(np.append(edges, len(s)))
            if held is not None:
                n[0] += classes - 1
            many = np.repeat(n, np.diff(np.append(edges, len(s)))) + spread > 1
            open_ = np.arange(len(s)) >= edges[-1]  # the last seed may go on
            out = ~given & (many | (more & ~open_))
            yield rows(*(x[out] for x in (s, t, d, p, c)), np.where(many, SHARED, ALONE)[out])
            hot = edges[:-1][n[:-1] > spec.hot_total]
            yield rows(*(x[hot] for x in (s, t, d, p, c)), HOT)
            held, classes = (s[-1], t[-1], d[-1], p[-1], c[-1], more[-1], given[-1] or out[-1]), int(n[-1])
        if held is not None:
            yield from last(held, classes)

    return run


def judged(docs: DataFrame) -> DataFrame:
    """id, text, rest (all columns but the text) of `docs`. An id whose rows have different texts stands for the text
    of the least hash; rows with another text have a null id here."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")
    given = docs.select(F.col("doc_id").cast("long").alias("id"), "text", rest)
    marks = given.where("id is not null").groupBy("id").agg(*(f(F.xxhash64("text")).alias(n) for f, n in ((F.min, "least"), (F.max, "most"))))
    unclear = materialise(marks.where("least <> most").select(F.col("id").alias("unclear"), "least"))
    if unclear.isEmpty():
        return given
    own = given.join(unclear, given["id"] == F.col("unclear"), "left")
    return own.select(F.when(F.col("unclear").isNull() | (F.xxhash64("text") == F.col("least")), F.col("id")).alias("id"), "text", "rest")


def classed(given: DataFrame, spec: Spec) -> DataFrame:
    """Classes and followers of all rows with id and text, written once."""
    records = given.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "text").mapInArrow(trimmed(to_records(spec)), RECORDS)
    # Followers only pass; a spread seed's records meet by class.
    spread = F.when(F.col("kind") % LEADS == SPREAD, F.xxhash64("seed", "text")).when((F.col("kind") % 16).isin(FOLLOWER, CROWDED), F.xxhash64("doc", "start")).otherwise(F.col("seed"))
    records = records.repartition(spread).sortWithinPartitions("seed", "text", "doc", "start")
    return materialise(records.mapInArrow(trimmed(settled(spec)), CLASSED))


def squeeze(batches):
    """Packs texts (zstd) for a shuffle; null stays null."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in slices(batches, SQUEEZED):
        packed = [None if t is None else packer.compress(t) for t in batch["text"].cast(pa.large_binary()).to_pylist()]
        at = batch.schema.names.index("text")
        columns = list(batch.columns)
        columns[at] = pa.array(packed, pa.binary())
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def packed(given: DataFrame) -> DataFrame:
    return given.mapInArrow(trimmed(squeeze), given.withColumn("text", F.lit(None).cast("binary")).schema)


def unsqueeze(column) -> list[bytes]:
    opener = zstandard.ZstdDecompressor()
    return [b"" if t is None else opener.decompress(t) for t in column.to_pylist()]


def context_rows(given: DataFrame, classes: DataFrame, cut, schema: str) -> DataFrame:
    """The texts of the records that stand for classes: `cut()` makes an object whose `add(text, doc, records)` takes a
    document and whose `rows()` yields batches of `schema` and forgets them.

    `records`: arrays cls, seed, start, count, kind of one document; a hot seed's kind is HOT. The list of a document's
    records is no longer than itself. Documents that stand twice give their rows twice. Nothing is broadcast: else a task
    would hold two Python workers, one that packs and one that cuts.
    """
    hot = classes.where(F.col("kind") == HOT).select(F.col("seed").alias("hot_seed")).distinct()
    reps = classes.where(F.col("kind").isin(ALONE, SHARED)).join(hot, F.col("seed") == F.col("hot_seed"), "left")
    kind = F.when(F.col("hot_seed").isNull(), F.col("kind")).otherwise(HOT)
    wanted = reps.groupBy("doc").agg(F.collect_list(F.struct("cls", "seed", "start", "count", kind.alias("kind"))).alias("records"))
    texts = packed(given.where("id is not null").select("id", "text"))
    rows = texts.join(wanted.hint("merge"), texts["id"] == wanted["doc"])

    def run(batches):
        made, held = cut(), 0
        for batch in batches:
            lists = batch["records"]
            edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            fields = [x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten()]
            for i, doc in enumerate(batch["id"].to_pylist()):
                made.add(unsqueeze(batch["text"].slice(i, 1))[0], doc, [x[edges[i] : edges[i + 1]] for x in fields])
                held += edges[i + 1] - edges[i]
                if held > HELD:
                    yield from made.rows()
                    held = 0
        yield from made.rows()

    return rows.select("id", "text", "records").mapInArrow(trimmed(run), schema)


#: What an index says: windows at..at+n of the record (cls, doc, start) repeat an earlier place; and n = 0 for each record.
VERDICT = "cls long, doc long, start long, at long, n long"


def spans(classes: DataFrame, verdicts: DataFrame, spec: Spec) -> DataFrame:
    """doc, first, n: runs of repeated windows of records that stand for classes, and of their followers.

    A class's followers that are crowded in their batches go to CROWD tasks, each with the class's first place. The other
    ones are at most CROWD of a batch. A batch has CROWD of them for each class that is copied, so copies are no more than
    the followers.
    """
    said = verdicts.where("n > 0")
    leads = verdicts.where("n = 0").groupBy("cls").agg(F.min(F.struct("doc", "start")).alias("lead"))
    crowded = F.col("kind") == CROWDED
    crowds = classes.where(crowded).groupBy("cls").agg(F.lit(CROWD).alias("deals"))
    dealt = F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(0))))
    leads = leads.join(crowds, "cls", "left").select("cls", "lead", dealt.alias("deal"))
    deal = F.when(crowded, F.pmod(F.xxhash64("doc", "start"), F.lit(CROWD)) + 1).otherwise(0).cast("int")
    followers = classes.where(F.col("kind").isin(FOLLOWER, CROWDED)).select("cls", "doc", "start", "count", deal.alias("deal"))
    followers = followers.join(leads, ["cls", "deal"]).drop("deal")
    later = F.col("doc") > F.col("lead.doc")
    if spec.within:
        whole, own = followers.where(later | (F.col("start") > F.col("lead.start"))), None
    else:  # in the document of its class's first record, a follower shares that one's verdict
        whole, own = followers.where(later), followers.where(~later).select("cls", F.col("doc").alias("d"), F.col("start").alias("s"))
    found = said.select("doc", (F.col("start") + F.col("at")).alias("first"), "n").union(whole.select("doc", "start", "count"))
    if own is not None:
        own = own.join(said, "cls").where("d = doc").select("doc", F.col("s") + F.col("at"), "n")
        found = found.union(own)
    return found


def cut_rows(given: DataFrame, found: DataFrame, cut, fields, schema) -> DataFrame:
    """All rows of `given` (judged), by `cut(text, first, n)`: the values of the columns that `schema` adds to `fields`.

    Rows without an id don't meet the join. They are shuffled as the others are, and no side is broadcast: else a task would
    hold two Python workers, one that packs and one that cuts.
    """
    runs = found.groupBy("doc").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    joined = packed(given.where("id is not null")).join(runs.hint("merge"), F.col("id") == F.col("doc"), "left").select("text", "rest", "runs")
    others = packed(given.where("id is null")).repartition(partitions(given.sparkSession))
    joined = joined.union(others.select("text", "rest", F.lit(None).cast(runs.schema["runs"].dataType)))

    def run(batches):
        none = np.zeros(0, np.int64)
        for whole in batches:
            sizes = pa.compute.binary_length(whole["text"].fill_null(b"")).to_numpy(zero_copy_only=False)
            for one, end in row_chunks(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), CUT_BYTES):
                batch = whole.slice(one, end - one)
                lists = batch["runs"]
                edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                first, n = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten()) if len(lists.flatten()) else (none, none)
                made = []
                for i, text in enumerate(unsqueeze(batch["text"])):
                    lo, hi = edges[i], edges[i + 1]
                    order = lo + np.argsort(first[lo:hi], kind="stable")
                    made.append(cut(text, first[order], n[order]))
                rest = batch["rest"]
                columns = [rest.field(k) for k in range(len(fields))]
                for values, field in zip(zip(*made, strict=True), list(schema)[len(fields) :], strict=True):
                    columns.append(pa.array(values, ARROW[field.dataType.simpleString()]))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(trimmed(run), schema)


SPAN = "array<struct<start:bigint,end:bigint>>"
ARROW = {
    "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), SPAN: pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
}
