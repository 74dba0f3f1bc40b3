"""Directory sweep, file hashing and snapshot comparison."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

MAX_DEPTH = 256
SCHEMA = "path string, size long, mtime double, is_dir boolean, error string"


def walk(root: str, ignores: frozenset[str] = frozenset(), max_depth: int | None = None, follow: bool = False) -> Iterator[tuple]:
    """Every file and directory below ``root``. An ignored directory is left out
    with all below it; depth 0 is the direct children; links are skipped unless
    followed, each real directory once. Errors below the root are rows, as is a
    directory at MAX_DEPTH whose entries the caller had not ruled out."""
    limit = MAX_DEPTH if max_depth is None or max_depth < 0 else min(max_depth, MAX_DEPTH)
    seen = {os.path.realpath(root)}
    todo = [(root, 0)]
    while todo:
        folder, depth = todo.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            if folder == root:
                raise
            yield folder, None, None, None, str(e)
            continue
        for e in entries:
            try:
                if e.is_symlink() and not follow:
                    continue
                is_dir, st = e.is_dir(), e.stat()
            except OSError as err:
                yield e.path, None, None, None, str(err)
                continue
            if is_dir:
                if e.name in ignores:
                    continue
                real = os.path.realpath(e.path)
                if real in seen:
                    yield e.path, None, None, None, "cycle: this directory was already walked"
                    continue
                seen.add(real)
                yield e.path, 0, st.st_mtime, True, None
                if depth < limit:
                    todo.append((e.path, depth + 1))
                elif depth == MAX_DEPTH and (max_depth is None or max_depth < 0 or max_depth > MAX_DEPTH):
                    yield e.path, None, None, None, f"more than {MAX_DEPTH} levels down: its entries were not visited"
            else:
                yield e.path, st.st_size, st.st_mtime, False, None


class WalkSource(DataSource):
    """``spark.read.format("fs_walk").option("root", ...).load()``; options
    ignores (comma-separated names), max_depth and follow."""

    @classmethod
    def name(cls) -> str:
        return "fs_walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> "WalkReader":
        return WalkReader(self.options)


class WalkReader(DataSourceReader):
    """One sweep is one task: what is pruned and seen depends on what came before."""

    def __init__(self, options):
        self.root = options["root"]
        self.ignores = frozenset(x for x in options.get("ignores", "").split(",") if x)
        depth = options.get("max_depth")
        self.depth = int(depth) if depth is not None else None
        self.follow = options.get("follow", "false").lower() == "true"

    def partitions(self):
        return [InputPartition(self.root)]

    def read(self, partition):
        yield from walk(partition.value, self.ignores, self.depth, self.follow)


def fs_walk(spark: SparkSession, root: str, ignores: tuple[str, ...] = (), max_depth: int | None = None, follow: bool = False) -> DataFrame:
    """Entries and error rows (error not null) of one sweep; a root that cannot be
    read is an error of the call."""
    os.scandir(root).close()
    spark.dataSource.register(WalkSource)
    reader = spark.read.format("fs_walk").option("root", root).option("ignores", ",".join(ignores)).option("follow", str(follow))
    if max_depth is not None:
        reader = reader.option("max_depth", max_depth)
    return reader.load()


def hash_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, sha256, error) of every path; one that cannot be read fails alone.
    Paths are those of a file system that all workers mount."""

    def run(frames):
        for pdf in frames:
            rows = []
            for p in pdf["path"]:
                try:
                    with open(p, "rb") as f:
                        rows.append((p, hashlib.file_digest(f, "sha256").hexdigest(), None))
                except OSError as e:
                    rows.append((p, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "sha256", "error"])

    return paths.select(F.col(path).alias("path")).mapInPandas(run, "path string, sha256 string, error string")


def hash_stored(spark: SparkSession, glob: str) -> DataFrame:
    """(path, size, sha256) of files in any store that Spark reads."""
    found = spark.read.format("binaryFile").load(glob)
    return found.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", digest: str = "sha256") -> DataFrame:
    """(key, change): added, removed or changed between two digest snapshots."""
    a = old.select(F.col(key).alias("_k"), F.col(digest).alias("_a"), F.lit(True).alias("_in_a"))
    b = new.select(F.col(key).alias("_l"), F.col(digest).alias("_b"), F.lit(True).alias("_in_b"))
    both = a.join(b, F.col("_k") == F.col("_l"), "full_outer")
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(F.coalesce("_k", "_l").alias(key), change.alias("change")).filter("change is not null")
