"""Reading a folder of source files as a table.

Spark's own file source leaves out names that begin with a dot or underscore;
this data source keeps them.  Folders that are pruned are never listed.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skein import schema as S
from skein.functions.jslex import extension


class _Subtree(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


#: Subtrees that a scan is cut into, as far as there are folders.
PARTS = 256


class _Reader(DataSourceReader):
    """A partition is one folder's own files or one subtree; folders are opened, shallow ones first, until there are ``PARTS`` of them."""

    def __init__(self, root: str, content: bool):
        self.root, self.content = os.path.abspath(root), content

    def partitions(self) -> list[InputPartition]:
        own: list[str] = []
        waiting = deque([self.root])
        while waiting and len(own) + len(waiting) < PARTS:
            folder = waiting.popleft()
            own.append(folder)
            try:
                with os.scandir(folder) as entries:
                    waiting.extend(e.path for e in sorted(entries, key=lambda e: e.name) if e.is_dir(follow_symlinks=False) and e.name not in S.PRUNED_DIRS)
            except OSError:
                continue
        return [_Subtree(f, False) for f in own] + [_Subtree(f, True) for f in waiting]

    def read(self, partition: _Subtree) -> Iterator[tuple]:
        for folder, folders, names in os.walk(partition.folder):
            folders[:] = sorted(d for d in folders if d not in S.PRUNED_DIRS and not os.path.islink(os.path.join(folder, d))) if partition.deep else []
            for name in sorted(names):
                path = os.path.join(folder, name)
                dot = name.rfind(".")
                ending = name[dot:] if dot > 0 else ""
                if ending not in S.EXTENSIONS or os.path.islink(path) or not os.path.isfile(path):
                    continue
                try:
                    stat = os.stat(path)
                    content = _text(path) if self.content else None
                except OSError:
                    continue
                yield path, os.path.relpath(path, self.root).replace(os.sep, "/"), ending, stat.st_size, stat.st_mtime_ns / 1e6, content


def _text(path: str) -> str:
    with open(path, "rb") as f:
        return f.read().decode("utf-8", "replace")


class SourceFiles(DataSource):
    """``spark.read.format("source_files").load(folder)``; the folder must be one that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "source_files"

    def schema(self) -> str:
        return S.FILES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("content", "true") != "false")


def scan(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """Files that the scan keeps: by ending, pruned folders and denied names; without ``content``, none is opened."""
    from skein.functions.rows import ship
    from skein.functions.text import allowed_file

    ship(spark)
    spark.dataSource.register(SourceFiles)
    return spark.read.format("source_files").option("content", str(content).lower()).load(folder).where(allowed_file("relative_path"))


def with_texts(rows: DataFrame, path: str = "path", into: str = "content") -> DataFrame:
    """Rows with the whole text of the file that each names; null where it cannot be read or the path is null."""
    from skein.functions.rows import ship

    ship(rows.sparkSession)
    schema = rows.drop(into).schema.add(into, "string")

    def read(batches):
        for pdf in batches:
            texts = []
            for p in pdf[path]:
                try:
                    texts.append(_text(p) if p is not None else None)
                except (OSError, ValueError):
                    texts.append(None)
            yield pdf.assign(**{into: pd.Series(texts, dtype=object, index=pdf.index)})[[f.name for f in schema.fields]]

    return rows.drop(into).mapInPandas(read, schema)


def texts_of(results: DataFrame, files: DataFrame) -> DataFrame:
    """Results with ``file_text``, the whole text of the file that their file_path names in a table of files (path, content); null where it is not there."""
    texts = files.groupBy(files["path"].alias("file_path")).agg(F.max("content").alias("file_text"))
    return results.join(texts, "file_path", "left")


def small_files(files: DataFrame, most: int = 50, low: int = 100, high: int = 50_000) -> DataFrame:
    """The first files, by path, of a trial index: .vue and .js between the two sizes."""
    return files.where(files["extension"].isin(".vue", ".js") & (files["size"] > low) & (files["size"] < high)).orderBy("path").limit(most)


__all__ = ["SourceFiles", "extension", "scan", "small_files", "texts_of", "with_texts"]
