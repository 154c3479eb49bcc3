"""Exact top-k inner products from an impact-ordered index, a segment level at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm._io import materialise, pack, unpack

BLOCK_SCHEMA = "dim int, ids binary, segments binary, norm double, n long"
INDEX_BLOCK, QUERY_BLOCK = 4096, 4096
#: Vectors of the index that a task takes.
SLICE = 8192
#: So many of a block's queries are scored together.
TOGETHER = 256
#: When at most this share of a block can still be among the best, its members are rescored.
RESCORE_SHARE = 0.02


def quantised(vectors: DataFrame, scale: float) -> DataFrame:
    """vec_id and floor(scale * x) of the vectors that have an id and are all finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(F.lit(float(scale)) * x))
    good = F.col("vec_id").isNotNull() & F.coalesce(F.forall(F.col("embedding").cast("array<double>"), finite), F.lit(False))
    return vectors.where(good).select(F.col("vec_id").cast("long"), whole.alias("impact"))


def posting_blocks(size: int):
    """Batches of (vec_id, impact) to one row a block: ids, the longest norm, and postings by descending absolute impact.

    A posting segment is the rows that have one impact in one dimension; segments are laid end to end.
    """

    def run(batches):
        for batch in batches:
            widths = pa.compute.list_value_length(batch["impact"]).to_numpy(zero_copy_only=False)
            for dim in np.unique(widths):
                of = batch.filter(pa.array(widths == dim))
                for lo in range(0, len(of), size):
                    part = of.slice(lo, size)
                    x = part["impact"].flatten().to_numpy(zero_copy_only=False).reshape(len(part), int(dim)).astype(np.int64)
                    longest = float(np.sqrt((x.astype(float) ** 2).sum(axis=1)).max())
                    row, axis = np.nonzero(x)
                    value = x[row, axis]
                    order = np.lexsort((row, value, axis, -np.abs(value)))
                    segments = pack(axis=axis[order].astype(np.int32), impact=value[order], row=row[order].astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(dim)], pa.int32()), pa.array([pack(vec_id=part["vec_id"])]), pa.array([segments]), pa.array([longest]), pa.array([len(part)])],
                        names=["dim", "ids", "segments", "norm", "n"],
                    )

    return run


def best(owner, score, ids, k):
    """Positions of each owner's k highest scores, ties to smaller ids, owners and ranks in order."""
    order = np.lexsort((ids, -score, owner))
    own = owner[order]
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    return order[rank < k]


def levels(impact: np.ndarray) -> np.ndarray:
    """Where the quarters of the postings end; segments of one absolute impact aren't parted."""
    level = np.abs(impact)
    edges = [np.searchsorted(-level, -np.quantile(level, q), "right") for q in (0.75, 0.5, 0.25)] if len(level) else []
    return np.unique([*edges, len(level)])


def score_block(queries, query_ids, block, dim, held, k, floor=None):
    """Merges a block's members into `held` (owner, score, id: the best so far of each query).

    Levels are taken by descending impact. A row's parts not yet taken have a known norm, so partial scores bound
    the full ones from both sides. A row is dropped when its upper bound is below the k-th best score that is proven
    for the query (`floor`: what other blocks proved); segments whose rows no query can have among its best any more
    are skipped, as are queries without such a row. With few rows left, or all levels taken, the rest are scored
    exactly in whole numbers.
    """
    ids, segments = block
    impact, axis, row = (segments[c].to_numpy() for c in ("impact", "axis", "row"))
    n, m = len(ids), len(queries)
    proven = np.full(m, -np.inf) if floor is None else floor.astype(float)
    full = np.flatnonzero(np.bincount(held[0], minlength=m) >= k)
    if len(full):
        lowest = np.full(m, np.inf)
        np.minimum.at(lowest, held[0], held[1].astype(float))
        proven[full] = np.maximum(proven[full], lowest[full])
    rest = np.bincount(row, impact.astype(float) ** 2, n)
    norms = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
    asks, may = np.arange(m), np.arange(n)  # queries and rows that can still meet
    partial, lo = np.zeros((m, n)), 0
    possible = query_ids[:, None] != ids[None, :]
    own = ~possible
    for hi in levels(impact):
        at = np.full(n, -1)
        at[may] = np.arange(len(may))
        taken = lo + np.flatnonzero(at[row[lo:hi]] >= 0)
        piece = np.zeros((len(may), dim))
        piece[at[row[taken]], axis[taken]] = impact[taken]
        partial += queries[asks] @ piece.T
        rest -= np.bincount(row[lo:hi], impact[lo:hi].astype(float) ** 2, n)
        bound = norms[asks, None] * np.sqrt(np.maximum(rest[may], 0))[None, :] * (1 + 1e-9)
        lo = hi
        if len(may) > k:
            lower = np.where(own, -np.inf, partial - bound)
            proven[asks] = np.maximum(proven[asks], np.partition(lower, len(may) - k, axis=1)[:, len(may) - k])
        possible &= partial + bound >= proven[asks, None]
        if possible.mean() <= RESCORE_SHARE:
            break
        some, any_ = possible.any(axis=1), possible.any(axis=0)
        if some.mean() < 0.9 or any_.mean() < 0.9:
            asks, may = asks[some], may[any_]
            partial, possible, own = (x[np.ix_(some, any_)] for x in (partial, possible, own))
    q, r = np.nonzero(possible)
    q, r = asks[q], may[r]
    exact = np.zeros((n, dim), np.int64)
    exact[row, axis] = impact
    whole = queries.astype(np.int64)
    scores = np.concatenate([np.einsum("ij,ij->i", whole[q[i : i + 65536]], exact[r[i : i + 65536]]) for i in range(0, len(q), 65536)] or [np.zeros(0, np.int64)])
    owner, score, found = np.concatenate([held[0], q]), np.concatenate([held[1], scores]), np.concatenate([held[2], ids[r]])
    keep = best(owner, score, found, k)
    return owner[keep], score[keep], found[keep]


def dense(ids, segments, dim) -> np.ndarray:
    table = unpack(segments)
    out = np.zeros((len(ids), dim))
    out[table["row"].to_numpy(), table["axis"].to_numpy()] = table["impact"].to_numpy()
    return out


#: Best scores of queries; or, with a part, what a block of queries has proven: `floor` by query, and `reach`, the norm
#: below which a vector can't be among the best of any.
FOUND = "query_id long, vec_id long, score long, part long, reach double, floor array<double>"
FOUND_ARROW = pa.schema([*((c, pa.int64()) for c in ("query_id", "vec_id", "score", "part")), ("reach", pa.float64()), ("floor", pa.list_(pa.float64()))])


def scored(k: int, prove: bool):
    """Cogroup function: a block of queries against some blocks of the index; with `prove` also what that proves."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [FOUND_ARROW.empty_table()]
        blocks = [(unpack(i)["vec_id"].to_numpy(), unpack(s)) for i, s in zip(right["ids"].to_pylist(), right["segments"].to_pylist(), strict=True)]
        for part in left.to_pylist():
            ids = unpack(part["ids"])["vec_id"].to_numpy()
            queries = dense(ids, part["segments"], part["dim"])
            floor = np.array(part["floor"], float) if part["floor"] is not None else np.full(len(ids), -np.inf)
            for lo in range(0, len(ids), TOGETHER):
                at = slice(lo, lo + TOGETHER)
                held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
                for block in blocks:
                    held = score_block(queries[at], ids[at], block, part["dim"], held, k, floor[at])
                n = len(held[0])
                columns = [ids[at][held[0]], held[2], held[1]]
                nulls = [pa.nulls(n, t) for t in FOUND_ARROW.types[3:]]
                out.append(pa.Table.from_arrays([*map(pa.array, columns), *nulls], schema=FOUND_ARROW))
                full = np.flatnonzero(np.bincount(held[0], minlength=len(ids[at])) >= k)
                lowest = np.full(len(ids[at]), np.inf)
                np.minimum.at(lowest, held[0], held[1].astype(float))
                floor[lo + full] = np.maximum(floor[lo + full], lowest[full])
            if prove:
                norms = np.sqrt((queries**2).sum(axis=1))
                reach = np.where(norms > 0, floor / np.maximum(norms, 1e-300), -np.inf).min()
                row = [pa.array([x], t) for x, t in zip((None, None, None, part["part"], reach, floor.tolist()), FOUND_ARROW.types, strict=True)]
                out.append(pa.Table.from_arrays(row, schema=FOUND_ARROW))
        return pa.concat_tables(out)

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products over all `vectors` but its own id.

    Components become floor(scale * x). Ties go to the smaller id; a query has fewer rows when fewer vectors are
    there. Null vectors, null ids and vectors with null or non-finite components take no part; zero vectors do.
    Dimensions don't mix. Rows that repeat an id are candidates of their own (not for queries of that id), and a
    query id that repeats is answered once. Empty tables give none. Scores are whole numbers, exact: an error is raised
    where one could reach 2^52.

    Blocks of queries meet blocks of the index, in two rounds. The index is sorted by norm. First each block of queries
    meets one group of the longest vectors, which proves a k-th best score for each query; then it meets only the
    groups whose longest vector times a query's norm reaches that query's score. A task holds some blocks of each side,
    whatever the tables' sizes.
    """
    norm = F.sqrt(F.aggregate("impact", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    index = quantised(vectors, scale).withColumn("norm", norm)
    asked = quantised(queries, scale).dropDuplicates(["vec_id"])
    longest = index.agg(F.max("norm")).first()[0] or 0.0
    n, most = asked.agg(F.count("*"), F.max(norm)).first()
    if longest * (most or 0.0) >= 2.0**52:
        raise ValueError("scores beyond 2^52 aren't supported: choose a smaller scale")
    index = index.repartitionByRange(F.desc("norm")).sortWithinPartitions(F.desc("norm")).select("vec_id", "impact")
    index = materialise(index.mapInArrow(posting_blocks(INDEX_BLOCK), BLOCK_SCHEMA).withColumn("block", F.monotonically_increasing_id()))
    asked = materialise(asked.repartition(n // QUERY_BLOCK + 1).mapInArrow(posting_blocks(QUERY_BLOCK), BLOCK_SCHEMA))
    asked = asked.select("dim", "ids", "segments", F.xxhash64("ids").alias("part"))
    # A row of this window is a block, not a vector.
    order = Window.partitionBy("dim").orderBy(F.desc("norm"), "block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(order), F.lit(0))
    numbers = index.select("dim", "block", "norm", "n").withColumn("slice", F.floor(before / SLICE)).drop("n")
    index = index.select("block", "ids", "segments").join(numbers, "block")
    bounds = numbers.groupBy("dim", "slice").agg(F.max("norm").alias("norm"))

    def meet(left: DataFrame, prove: bool) -> DataFrame:
        """`left`: blocks of queries with the slices they go to."""
        to = left.select(F.col("dim").alias("d"), F.col("slice").alias("s"), F.col("part").alias("p"))
        right = index.join(to, (F.col("dim") == F.col("d")) & (F.col("slice") == F.col("s"))).select("d", "s", "p", "ids", "segments")
        return left.groupBy("dim", "slice", "part").cogroup(right.groupBy("d", "s", "p")).applyInArrow(scored(k, prove), FOUND)

    first = materialise(meet(asked.withColumns({"floor": F.lit(None).cast("array<double>"), "slice": F.lit(0).cast("long")}), True))
    proven = first.where("part is not null").select("part", "reach", "floor")
    left = asked.join(proven, "part").join(bounds.where("slice > 0"), "dim").where(F.col("norm") * (1 + 1e-9) >= F.col("reach"))
    rest = meet(left.select("dim", "ids", "segments", "part", "floor", "slice"), False)
    found = first.union(rest).where("part is null").select("query_id", "vec_id", "score")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
