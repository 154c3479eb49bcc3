"""Directory trees listed by tasks, level by level."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch while a large directory is listed.
LISTED = 10_000
ENTRIES = "path string, directory boolean, size long"


def entries(folder: str):
    """(path, is a directory, size) of what a folder holds, hidden names too; nothing if it isn't there.

    Links to files count as files, links to directories aren't followed. Paths with a scheme other than file: go through
    the file system of that scheme.
    """
    plain = folder.removeprefix("file://") if folder.startswith("file:///") else folder
    if "://" not in plain:
        try:
            with os.scandir(plain) as found:
                for e in found:
                    if e.is_dir(follow_symlinks=False):
                        yield e.path, True, 0
                    elif e.is_file():
                        yield e.path, False, e.stat().st_size
        except FileNotFoundError:
            pass
        return
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    prefix = folder[: len(folder) - len(root)] if folder.endswith(root) else ""
    for e in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if e.type in (fs.FileType.File, fs.FileType.Directory):
            yield prefix + e.path, e.type == fs.FileType.Directory, e.size or 0


def listed(batches):
    for batch in batches:
        held = []
        for folder in batch["path"]:
            for entry in entries(folder):
                held.append(entry)
                if len(held) == LISTED:
                    yield pd.DataFrame(held, columns=["path", "directory", "size"])
                    held = []
        yield pd.DataFrame(held, columns=["path", "directory", "size"])


def files_below(spark: SparkSession, roots: list[str], spread: int | None = None) -> DataFrame:
    """path, size of all files below the roots, at any depth. Roots that aren't there have none.

    The directories of a level are rows, which tasks list and whose own directories are the next level: neither names
    nor counts of files come to the driver, and a level of many directories is spread over all tasks. A job a level.
    """
    spread = spread or 4 * spark.sparkContext.defaultParallelism
    frontier, found = spark.createDataFrame([(r,) for r in roots], "path string"), None
    while True:
        level = frontier.repartition(spread, "path").mapInPandas(listed, ENTRIES).persist()
        files = level.where("not directory").select("path", "size")
        found = files if found is None else found.union(files)
        frontier = level.where("directory").select("path")
        if frontier.isEmpty():
            return found
