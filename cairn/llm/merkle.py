"""Merkle trees over a dataset: one tree a group of rows, one over the groups, and octopus multiproofs for any rows."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm._io import materialise

#: Levels that a task builds from a block of 2^12 nodes, and that a leaf partition of a proof spans.
HEIGHT = 12
STEP = T.StructType([T.StructField("left", T.BooleanType()), T.StructField("digest", T.StringType())])
NODES = "tree string, level int, index long, digest string"


def digest(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """SHA-256 (lowercase hex) of the fields, each `-` if null, else its UTF-8 size, a colon and its text: no two rows read alike."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def tree_key(group: Column) -> Column:
    """A name without null that sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds index (from 0, gapless in each tree, in the order given) and size (rows of the tree).

    Rows are sorted by (tree, order) into ranges and written once; a row's number is its place in its file, after the
    tree's rows in files before. So a tree of any share of the rows spreads over many tasks, and the windows see a row
    for each file and tree.
    """
    by = [F.col("tree"), *order]
    written = materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by))
    placed = written.select("*", F.col("_metadata.file_name").alias("file_"), F.col("_metadata.row_index").alias("row_"))
    cells = placed.groupBy("tree", "file_").agg(F.count("*").alias("n_"), F.min("row_").alias("first_"))
    part = F.regexp_extract("file_", r"^part-(\d+)", 1).cast("long")  # the number of the range
    before = Window.partitionBy("tree").orderBy(part, "file_").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "tree", "file_", (F.coalesce(F.sum("n_").over(before), F.lit(0)) - F.col("first_")).alias("shift_"), F.sum("n_").over(Window.partitionBy("tree")).alias("size")
    )
    found = placed.join(cells, ["tree", "file_"])
    return materialise(found.select(*rows.columns, (F.col("row_") + F.col("shift_")).alias("index"), "size"))


def counts(size: int) -> list[int]:
    """Nodes of each level of a tree of `size` leaves, up to the one at the top."""
    out = [size]
    while out[-1] > 1:
        out.append((out[-1] + 1) // 2)
    return out


def grown(leaves: DataFrame) -> DataFrame:
    """All nodes above `leaves` (tree, index, digest, size): tree, level, index, digest.

    Each round raises blocks of 2^HEIGHT nodes by HEIGHT levels, a block a task, so a round's rows are a
    4,096th of those before: three rounds for 68 billion leaves. A node alone at the end of its level is hashed alone.
    """

    def raised(key, rows):
        at = np.argsort(rows["index"].to_numpy())
        digests, (level, size) = rows["digest"].take(pa.array(at)).to_pylist(), (rows[c][0].as_py() for c in ("level", "size"))
        first, out = rows["index"][int(at[0])].as_py(), ([], [], [])
        for _ in range(HEIGHT):
            if size == 1:
                break
            digests = [digest(*digests[i : i + 2]) for i in range(0, len(digests), 2)]
            level, size, first = level + 1, (size + 1) // 2, first // 2
            for held, new in zip(out, ([level] * len(digests), range(first, first + len(digests)), digests), strict=True):
                held.extend(new)
        tree = pa.array([key[0].as_py()] * len(out[0]), pa.string())
        return pa.table([tree, pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["tree", "level", "index", "digest"])

    rows, base, found = leaves.select("tree", F.lit(0).alias("level"), "index", "digest", "size"), 0, None
    largest = leaves.agg(F.max("size")).first()[0] or 0
    while largest > 1:
        blocks = rows.groupBy("tree", F.shiftright("index", HEIGHT).alias("block"))
        new = materialise(blocks.applyInArrow(raised, NODES))
        found, base, largest = new if found is None else found.union(new), base + HEIGHT, -(-largest >> HEIGHT)
        if largest > 1:
            tops = new.where(F.col("level") == base)
            sizes = tops.groupBy("tree").agg(F.count("*").alias("size")).where("size > 1")
            rows = tops.join(sizes, "tree")
    return leaves.sparkSession.createDataFrame([], NODES) if found is None else found


def missing_nodes(wanted: DataFrame) -> DataFrame:
    """tree, block, level, index of the nodes that each leaf partition of `wanted` needs and can't derive.

    A leaf partition is what is wanted of a block of 2^HEIGHT leaves. From its indexes alone follow the siblings of known
    nodes that aren't known themselves, level by level; a node is known if a leaf below it is wanted.
    """

    def missing(key, rows):
        known, out = np.unique(rows["index"].to_numpy()), []
        for level, n in enumerate(counts(rows["size"][0].as_py())[:-1]):
            beside = np.setdiff1d(known ^ 1, known)
            out += [(level, i) for i in beside[beside < n].tolist()]
            known = np.unique(known >> 1)
        levels, at = zip(*out, strict=True) if out else ((), ())
        columns = [pa.array([k.as_py()] * len(out), t) for k, t in zip(key, (pa.string(), pa.int64()), strict=True)]
        return pa.table([*columns, pa.array(levels, pa.int32()), pa.array(at, pa.int64())], names=["tree", "block", "level", "index"])

    block = F.shiftright("index", HEIGHT).alias("block")
    return wanted.select("tree", block, "index", "size").groupBy("tree", "block").applyInArrow(missing, "tree string, block long, level int, index long")


def multiproofs(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds proof and derived to `wanted`, any of the leaves with tree, index, digest and size; other columns stay.

    proof: for each level upward (left, digest) of the sibling, left telling the side; digest is null where there is
    none. derived: the top that the partition's own leaves and the nodes it fetched give.
    Each leaf partition fetches the union of its missing nodes once, by one join; nodes that several paths share are
    hashed once, and each leaf's proof is read off the levels.
    """

    def expand(key, rows, fetched):
        own, levels = rows["index"].to_numpy(), counts(rows["size"][0].as_py())
        known = dict(zip(own.tolist(), rows["digest"].to_pylist(), strict=True))
        given = [{} for _ in levels]
        for level, i, d in zip(*(fetched[c].to_pylist() for c in ("level", "index", "digest")), strict=True):
            given[level][i] = d
        pool, places = [None], np.zeros((len(own), len(levels) - 1), np.int64)
        for level, n in enumerate(levels[:-1]):
            known |= given[level]
            index = np.fromiter(known, np.int64, len(known))
            order = np.argsort(index)
            beside = (own >> level) ^ 1
            found = np.searchsorted(index[order], beside)
            places[:, level] = np.where(beside < n, len(pool) + order[np.minimum(found, len(index) - 1)], 0)
            pool.extend(known.values())
            known = {i: digest(known[2 * i], known[2 * i + 1]) if 2 * i + 1 < n else digest(known[2 * i]) for i in np.unique(index >> 1).tolist()}
        flat = pa.array(places.ravel())
        digests = pa.array(pool, pa.string()).take(flat)
        left = pa.array(((own[:, None] >> np.arange(len(levels) - 1)) & 1).astype(bool).ravel())
        steps = pa.StructArray.from_arrays([left, digests], names=["left", "digest"])
        offsets = pa.array(np.arange(len(own) + 1, dtype=np.int32) * (len(levels) - 1))
        kept = rows.drop_columns(["block"])
        return kept.append_column("proof", pa.ListArray.from_arrays(offsets, steps)).append_column("derived", pa.array([known[0]] * len(own), pa.string()))

    block = F.shiftright("index", HEIGHT).alias("block")
    fetched = missing_nodes(wanted).join(nodes, ["tree", "level", "index"]).select("tree", "block", "level", "index", "digest")
    schema = T.StructType([*wanted.schema.fields, T.StructField("proof", T.ArrayType(STEP)), T.StructField("derived", T.StringType())])
    mine = wanted.select("*", block).groupBy("tree", "block")
    return mine.cogroup(fetched.groupBy("tree", "block")).applyInArrow(expand, schema)


@dataclass
class Manifest:
    leaves: DataFrame  #: tree, index, size, digest and the columns kept
    nodes: DataFrame  #: tree, level, index, digest of all nodes, leaves included
    tops: DataFrame  #: tree, subroot, path (from it to the root)
    root: str | None


def manifest(rows: DataFrame, group: str, order: str, digests: str = "digest") -> Manifest:
    """The trees of `rows`, which have a leaf's digest in `digests`, one tree for each value of `group`, and the tree over them.

    Leaves ascend by `order` (null first), rows that agree in it by digest; trees by group, null first, as UTF-8 bytes.
    While a level has several nodes, every two in turn become their hash; one left over is hashed alone. A tree of one
    leaf is that leaf. Without rows the root is None. All columns of `rows` stay with the leaves; columns named tree,
    index or size are replaced. Rows that repeat are leaves of their own.
    """
    given = rows.drop("tree", "index", "size").withColumn("tree", tree_key(F.col(group)))
    given = given if digests == "digest" else given.drop("digest").withColumnRenamed(digests, "digest")
    leaves = numbered(materialise(given), [F.col(order).asc_nulls_first(), F.col("digest")])
    nodes = whole(leaves, grown(leaves))
    tops = nodes.where("index = 0").groupBy("tree").agg(F.max_by("digest", "level").alias("digest"))
    forest = numbered(tops.select(F.col("tree").alias("name_"), "digest", F.lit("").alias("tree")), [F.col("name_")])
    paths = materialise(multiproofs(forest, whole(forest, grown(forest))))
    root = paths.select("derived").first()
    return Manifest(leaves, nodes, paths.select(F.col("name_").alias("tree"), F.col("digest").alias("subroot"), F.col("proof").alias("path")), root and root[0])


def whole(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    return leaves.select("tree", F.lit(0).alias("level"), "index", "digest").union(nodes)


def proofs(held: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """The columns of `wanted` (rows of held.leaves; all if None), subroot, root, and proof: the steps from leaf to root."""
    rows = multiproofs(held.leaves if wanted is None else wanted, held.nodes)
    found = rows.join(held.tops, "tree")
    kept = [c for c in rows.columns if c not in ("proof", "derived")]
    return found.select(*kept, "subroot", F.lit(held.root).cast("string").alias("root"), F.concat("proof", "path").alias("proof"))


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof give."""
    joined = lambda own, step: F.when(step["digest"].isNull(), own).when(step["left"], F.concat(step["digest"], own)).otherwise(F.concat(own, step["digest"]))
    return F.aggregate(proof, start, lambda own, step: F.sha2(joined(own, step), 256))


def proof_digest(proof: Column) -> Column:
    """H of the siblings in their order."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: step["digest"]), ""), 256)
