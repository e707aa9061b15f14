"""Large trees: listed by tasks, or taken from an inventory, and read where a row lies."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTING_SCHEMA = "path string, modificationTime timestamp, length bigint"


def _located(place: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a folder or file, its path there, and what to put before such paths."""
    system, path = fs.FileSystem.from_uri(place)
    return system, path, place[: len(place) - len(path)] if place.endswith(path) else ""


def _skipped(path: str) -> bool:
    """Names that Spark's own scans pass over."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool) -> None:
        self.path = path
        self.deep = deep


class TreeReader(DataSourceReader):
    def __init__(self, root: str, folders: int) -> None:
        self.root = root.rstrip("/")
        self.folders = folders

    def partitions(self) -> list[Folder]:
        """Folders level by level until there are enough; those opened on the way give their own files only."""
        system, path, _ = _located(self.root)
        opened, level = [], [path]
        while level and len(level) < self.folders:
            opened += level
            inner = (i for p in level for i in system.get_file_info(fs.FileSelector(p, allow_not_found=True)))
            level = [i.path for i in inner if i.type == fs.FileType.Directory and not _skipped(i.path)]
        return [Folder(p, False) for p in opened] + [Folder(p, True) for p in level]

    def read(self, partition: Folder) -> Iterator[tuple[str, datetime, int]]:
        system, _, scheme = _located(self.root)
        waiting = [partition.path]
        while waiting:
            for found in system.get_file_info(fs.FileSelector(waiting.pop(), allow_not_found=True)):
                if _skipped(found.path):
                    continue
                if found.type == fs.FileType.File:
                    # whole milliseconds, as in Spark's own listings
                    changed = found.mtime.replace(microsecond=found.mtime.microsecond // 1000 * 1000)
                    yield scheme + found.path, changed, found.size
                elif found.type == fs.FileType.Directory and partition.deep:
                    waiting.append(found.path)


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return LISTING_SCHEMA

    def reader(self, schema: T.StructType) -> TreeReader:
        return TreeReader(self.options["path"], int(self.options.get("folders", "1000")))


def list_tree(spark: SparkSession, root: str, folders: int = 1000) -> DataFrame:
    """Every file under ``root`` as (path, modificationTime, length), the rows of ``scan_tree`` without their
    contents. The driver opens folders until it has ``folders`` of them; tasks list what lies below."""
    spark.dataSource.register(Tree)
    return spark.read.format("file_tree").option("folders", folders).load(root)


def read_inventory(spark: SparkSession, table: str) -> DataFrame:
    """A listing kept as Parquet, for example a store's own inventory, with the columns of :func:`list_tree`."""
    return spark.read.parquet(table).select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in LISTING_SCHEMA.split(", ")))


def with_content(files: DataFrame) -> DataFrame:
    """Add ``content``, read in the row's own task; null where there is no such file any more."""
    names = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, place in enumerate(batch.column(names.index("path")).to_pylist()):
                content = None
                if place is not None:
                    try:
                        system, path, _ = _located(place)
                        with system.open_input_stream(path) as stream:
                            content = stream.read()
                    except FileNotFoundError:
                        pass
                row = batch.slice(at, 1)  # a file at a time: they may be large
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary())], [*names, "content"])

    return files.mapInArrow(run, T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())]))
