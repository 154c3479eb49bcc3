"""Embedding near-duplicates from randomised-rotation binary codes."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm._graph import components
from cairn.llm._io import materialise

#: A bucket's members are compared in blocks of this many; larger buckets are dealt out as pairs of blocks.
BLOCK = 2048
#: Rows of a block that are compared with the other block at a time.
STEP = 512


def usable(column: str) -> Column:
    """Whether an array is a vector: not null, not all zero, every component finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    vector = F.col(column).cast("array<double>")
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def bucket_plan(n: int, threshold: float, recall_odds: float = 4.0) -> tuple[int, int]:
    """(bits of a bucket key, tables). A pair at the threshold shares a sign with probability p, so it misses all tables
    with probability (1 - p^bits)^tables, about exp(-recall_odds). The bits follow log2 of the number of vectors."""
    p = 1 - math.acos(threshold) / math.pi
    bits = max(4, math.ceil(math.log2(max(n, 1) / 64)))
    return bits, math.ceil(recall_odds / p**bits)


CODED = "bucket long, rep long, size long, code binary, factor float, rounded binary, scale float, error float, keys binary"


def encode(dim: int, bits: int, tables: int, seed: int):
    """Batches of (rep, size, embedding) to a row for each table: see CODED.

    `code` is the signs of the rotated vector and `factor` their correction; `rounded` times `scale` is the vector itself
    up to `error` (its norm); `keys` are the buckets in all tables.
    """

    def run(batches):
        turn = rotation(dim, seed)
        planes = np.random.default_rng(seed + 1).standard_normal((dim, bits * tables)).astype(np.float32)
        rng = np.random.default_rng(seed + 2)
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.slice(lo, 2000)
                x = part["embedding"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                y = (x @ turn).astype(np.float32)
                factor = np.abs(y).sum(axis=1) / math.sqrt(dim)
                scale = np.abs(y).max(axis=1) / 127
                rounded = np.clip(np.floor(y / scale[:, None] + rng.random(y.shape, np.float32)), -127, 127).astype(np.int8)
                error = np.linalg.norm(y - rounded * scale[:, None], axis=1)
                codes = np.packbits(y > 0, axis=1)
                signs = ((x @ planes) > 0).reshape(len(x), tables, bits)
                keys = (signs << np.arange(bits)).sum(axis=2) + (np.arange(tables, dtype=np.int64) << bits)
                rows = pa.array(np.repeat(np.arange(len(x)), tables))
                blob = lambda m: pa.array([r.tobytes() for r in m], pa.binary()).take(rows)
                real = lambda v: pa.array(v.astype(np.float32)).take(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys.ravel()), part["rep"].take(rows), part["size"].take(rows), blob(codes), real(factor), blob(rounded),
                        real(scale), real(error), blob(keys.astype(np.int64)),
                    ],
                    names=["bucket", "rep", "size", "code", "factor", "rounded", "scale", "error", "keys"],
                )

    return run


#: Kinds of rows: how many vectors a class links with here, an edge of its component, a pair to compute exactly.
COUNT, EDGE, OPEN = 0, 1, 2
FOUND = "kind int, a long, b long"


def joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that each of n places reaches by links i - j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def block_links(dim: int, threshold: float, deviations: float):
    """Group function of two blocks of a bucket (or one): link counts, edges that join what links, and open pairs.

    With o rotated, code c = sign(o) / sqrt(dim) and factor <c, o>, <c, q> / factor is an unbiased estimate of <o, q>
    whose error stays within deviations * sqrt((1 - factor^2) / factor^2 / (dim - 1)). Each side serves once as the
    code; a pair needs both bounds. Of the pairs that remain the rounded vectors give the cosine up to their errors: a
    pair links for certain, or not, or is open. A pair belongs to the first table in which both have one bucket.
    """

    def run(key, table):
        ids, side, size = (table[c].to_numpy() for c in ("rep", "side", "size"))
        signs = np.unpackbits(np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(len(ids), -1), axis=1, count=dim)
        signs = (signs * np.float32(2) - 1) / np.float32(math.sqrt(dim))
        factor, scale, error = (table[c].to_numpy() for c in ("factor", "scale", "error"))
        keys = np.ascontiguousarray(np.frombuffer(b"".join(table["keys"].to_pylist()), np.int64).reshape(len(ids), -1).T)
        own = int(np.flatnonzero(keys[:, 0] == key[0].as_py())[0])
        y = np.frombuffer(b"".join(table["rounded"].to_pylist()), np.int8).reshape(-1, dim) * scale[:, None]
        slack = deviations * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(dim - 1, 1)) + 0.01
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        links, edges, open_ = np.zeros(len(ids), np.int64), [], []
        for lo in range(0, len(left), STEP):
            a = left[lo : lo + STEP]
            may = (signs[a] @ y[right].T) / factor[a, None] + slack[a, None] >= threshold
            may &= (y[a] @ signs[right].T) / factor[right] + slack[right] >= threshold
            i, j = np.nonzero(may)
            near = (y[a] @ y[right].T)[i, j]
            i, j = a[i], right[j]
            # A pair of one block stands twice there.
            single = (i != j) & ((side[i] != 2) | (ids[i] < ids[j]))
            i, j, near = i[single], j[single], near[single]
            met = np.zeros(len(i), bool)
            for earlier in keys[:own]:
                met |= earlier[i] == earlier[j]
            i, j, near = i[~met], j[~met], near[~met]
            off = error[i] + error[j] + error[i] * error[j] + 1e-4
            sure = near - off >= threshold
            np.add.at(links, i[sure], size[j[sure]])
            np.add.at(links, j[sure], size[i[sure]])
            label = joined(len(ids), i[sure], j[sure])
            apart = np.flatnonzero(label != np.arange(len(ids)))
            edges.append(np.stack([apart, label[apart]], 1))
            rest = ~sure & (near + off >= threshold)
            open_.append(np.stack([i[rest], j[rest]], 1))
        edges, open_ = (np.concatenate(x) if x else np.zeros((0, 2), np.int64) for x in (edges, open_))
        some = np.flatnonzero(links)
        return pa.table(
            {
                "kind": pa.array(np.repeat([COUNT, EDGE, OPEN], [len(some), len(edges), len(open_)]), pa.int32()),
                "a": np.concatenate([ids[some], ids[edges[:, 0]], ids[open_[:, 0]]]),
                "b": np.concatenate([links[some], ids[edges[:, 1]], ids[open_[:, 1]]]),
            }
        )

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, deviations: float = 3.0, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding; other columns are not read).

    Rows link when their cosine is at least `threshold`: by the rounded vectors where these leave no doubt, else
    recomputed in double precision. Pairs that link for certain are only counted where they meet. Equal arrays form one
    class that is compared once and counted in full. Null, zero or non-finite
    vectors link with nothing; so does a row whose id is null (component null, kept false). Vectors of different
    dimension don't link. Rows that repeat an id count as vectors of their own. An empty table gives none.
    """
    rows = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("embedding"))
    rows = rows.withColumn("good", usable("embedding") & F.col("vec_id").isNotNull())
    good = rows.where("good").withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(1), "embedding")})
    classes = good.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.min_by("embedding", "vec_id").alias("embedding"))
    classes = materialise(classes)
    # ids needn't be unique over classes: a class is named by its keys, one number a class
    classes = classes.withColumn("cls", F.xxhash64("k1", "k2"))
    found = []
    for dim, n in [(r[0], r[1]) for r in classes.groupBy(F.size("embedding")).count().collect()]:
        own = classes.where(F.size("embedding") == dim)
        bits, tables = bucket_plan(n, threshold)
        coded = materialise(own.select(F.col("cls").alias("rep"), "size", "embedding").mapInArrow(encode(dim, bits, tables, seed), CODED))
        large = coded.groupBy("bucket").count().where(F.col("count") > BLOCK)
        large = large.select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
        one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side")))
        mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
        spread = F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda k: F.struct(
                F.least(mine, k).alias("i"), F.greatest(mine, k).alias("j"), F.when(mine == k, 2).when(mine < k, 0).otherwise(1).alias("side")
            ),
        )
        dealt = coded.join(large, "bucket", "left").withColumn("at", F.explode(F.when(F.col("blocks").isNull(), one).otherwise(spread)))
        blocks = dealt.select("bucket", "at.*", *(c for c in coded.columns if c != "bucket")).groupBy("bucket", "i", "j")
        said = materialise(blocks.applyInArrow(block_links(dim, threshold, deviations), FOUND))
        pairs = said.where(F.col("kind") == OPEN).select("a", "b")
        vector = own.select("cls", "embedding", "size")
        both = pairs.join(vector.select(F.col("cls").alias("a"), F.col("embedding").alias("u"), F.col("size").alias("size_a")), "a")
        both = both.join(vector.select(F.col("cls").alias("b"), F.col("embedding").alias("v"), F.col("size").alias("size_b")), "b")
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
        links = materialise(both.where(dot("u", "v") / (F.sqrt(dot("u", "u")) * F.sqrt(dot("v", "v"))) >= threshold).select("a", "b", "size_a", "size_b"))
        found.append((said, links))
    if not found:
        return rows.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")
        )
    counts = [part for said, links in found for part in (
        said.where(F.col("kind") == COUNT).select("a", "b"), links.select("a", "size_b"), links.select("b", "size_a"),
    )]
    degree = reduce(DataFrame.union, counts).toDF("cls", "n").groupBy("cls").agg(F.sum("n").alias("n"))
    edges = reduce(DataFrame.union, [part for said, links in found for part in (said.where(F.col("kind") == EDGE).select("a", "b"), links.select("a", "b"))])
    parts = components(edges).withColumnRenamed("node", "cls")
    placed = classes.select("cls", "k1", "k2", "rep", "size").join(degree, "cls", "left").join(parts, "cls", "left")
    placed = placed.withColumn("component", F.coalesce("component", "cls"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    placed = placed.join(least, "component").select(
        F.col("k1").alias("c1"), F.col("k2").alias("c2"), (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("links"), "component_id"
    )
    good = good.join(placed, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")))
    good = good.select("vec_id", F.col("links").alias("n_links"), F.col("component_id").cast("long"))
    rest = rows.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return good.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
