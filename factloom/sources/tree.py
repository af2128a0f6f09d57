"""A data source that lists a directory tree, hidden and underscore names included.

Spark's file sources leave out names that begin with ``_`` or ``.``, among them
``__init__.py``; this one walks the tree, prunes ignored directories while it
walks and deals directories to tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from factloom.functions import paths


def pruned(name: str) -> bool:
    """is_ignored_directory of the path functions, for one name."""
    low = name.lower()
    return low in paths.IGNORED_DIRECTORIES or low.startswith((paths.OUTPUT_PREFIX, paths.TRIAL_PREFIX)) or low.endswith(paths.IGNORED_SUFFIXES)


class _Part(InputPartition):
    """Files of one directory, by name, and directories to walk."""

    def __init__(self, above: str, files: list[str], below: list[str]):
        self.above, self.files, self.below = above, files, below


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.skip = os.path.abspath(options["skip"]) if options.get("skip") else None
        self.content = options.get("content", "true").lower() == "true"
        self.parts = int(options.get("parts", "256"))
        self.files = int(options.get("files", "1000"))

    def partitions(self) -> list[InputPartition]:
        """Directories are opened, the uppermost first, until there are enough of them; files of one directory go in bunches."""
        if not os.path.isdir(self.root):
            raise NotADirectoryError(self.root)
        out, waiting = [], [self.root]
        while waiting and len(out) + len(waiting) < self.parts:
            above = waiting.pop(0)
            with os.scandir(above) as entries:
                found = sorted(entries, key=lambda e: e.name)
            files = [e.name for e in found if not e.is_dir(follow_symlinks=False)]
            out += [_Part(above, files[i : i + self.files], []) for i in range(0, len(files), self.files)]
            waiting += [e.path for e in found if e.is_dir(follow_symlinks=False) and not self._left_out(above, e.name)]
        return [*out, *[_Part(x, [], [x]) for x in waiting]] or [_Part(self.root, [], [])]

    def _left_out(self, above: str, name: str) -> bool:
        return pruned(name) or self.skip == os.path.abspath(os.path.join(above, name))

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for f in partition.files:
            yield self._row(os.path.join(partition.above, f))
        for top in partition.below:
            for above, dirs, files in os.walk(top):
                dirs[:] = sorted(d for d in dirs if not self._left_out(above, d))
                for f in sorted(files):
                    yield self._row(os.path.join(above, f))

    def _row(self, path: str) -> tuple:
        data = None
        if self.content:
            with open(path, "rb") as f:
                data = f.read()
        return os.path.relpath(path, self.root).replace(os.sep, "/"), os.path.getsize(path), data


class TreeSource(DataSource):
    """Options: path; skip (a directory to leave out); content (false: names and sizes only); parts (directories are dealt to about as many tasks); files (of one directory, to a task at most)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, size_bytes long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, *, skip: str | None = None, content: bool = True) -> DataFrame:
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("tree").option("content", str(content).lower())
    return (reader.option("skip", skip) if skip else reader).load(root)


def inventory(tree: DataFrame, *, tests: bool = True, fixtures: bool = False, generated: bool = False) -> DataFrame:
    """The tree's files with kinds and roles, without what is to be left out; files that can be parsed are deep, other texts partial."""
    rows = paths.classify(tree.select("path", "size_bytes")).filter(paths.included(tests=tests, fixtures=fixtures, generated=generated))
    depth = F.when(F.col("supports_deep_analysis"), "deep").when(F.col("language") != "unknown", "partial").otherwise("shallow")
    return rows.withColumn("analysis_depth", depth)


def decoded(tree: DataFrame) -> DataFrame:
    """path and text; bytes that aren't UTF-8 are dropped."""
    @F.pandas_udf("string")
    def lossy(content: pd.Series) -> pd.Series:
        return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    return tree.select("path", lossy("content").alias("text"))
