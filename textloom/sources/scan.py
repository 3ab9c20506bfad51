"""Directory scan as a Python data source.

``spark.read.format("textloom_files").option("path", root).load()`` lists files
with times in nanoseconds, which ``binaryFile`` cannot, and takes hidden files
but no hidden folders.  Top-level folders are listed by tasks of their own;
excluded subtrees are not entered.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textloom.functions.paths import excluded_prefixes, wanted


@dataclass
class Folder(InputPartition):
    """A folder to list: with all below it, or only its own files."""

    path: str
    deep: bool

    def __init__(self, path: str, deep: bool):
        super().__init__((path, deep))
        self.path, self.deep = path, deep


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "textloom_files"

    def schema(self) -> str:
        return "rel_path string, size_bytes bigint, mtime_ns bigint, readable boolean"

    def reader(self, schema) -> DataSourceReader:
        return FilesReader(self.options)


class FilesReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.skip = [p for p in options.get("skip", "").split("\n") if p]

    def partitions(self) -> list[InputPartition]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"the source is unavailable: {self.root}")
        tops = sorted(e.path for e in os.scandir(self.root) if e.is_dir() and not e.name.startswith("."))
        return [Folder(self.root, False), *(Folder(p, True) for p in tops if not self._skipped(p))]

    def _skipped(self, path: str) -> bool:
        rel = os.path.relpath(path, self.root).replace(os.sep, "/")
        return any(rel == p or rel.startswith(p + "/") for p in self.skip)

    def read(self, partition: Folder) -> Iterator[tuple]:
        for folder, dirs, names in os.walk(partition.path):
            dirs[:] = [] if not partition.deep else [d for d in dirs if not d.startswith(".") and not self._skipped(os.path.join(folder, d))]
            for name in names:
                path = os.path.join(folder, name)
                rel = os.path.relpath(path, self.root).replace(os.sep, "/")
                try:
                    s = os.stat(path)
                    yield rel, s.st_size, s.st_mtime_ns, True
                except OSError:
                    yield rel, None, None, False


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, exts: list[str] | None = None, max_size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(files that are wanted, one row that tells whether all could be read)."""
    from pyspark.sql import functions as F

    spark.dataSource.register(Files)
    every = spark.read.format("textloom_files").option("path", root).option("skip", "\n".join(excluded_prefixes(exclude or []))).load()
    files = every.where("readable").where(wanted(F.col("rel_path"), F.col("size_bytes"), include, exclude, exts, max_size))
    return files.drop("readable"), every.agg(F.coalesce(F.bool_and("readable"), F.lit(True)).alias("scan_complete"))
