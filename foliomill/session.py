"""Session settings and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
_held: ContextVar[list[DataFrame | Folder] | None] = ContextVar("held", default=None)


def build_session(app: str = "foliomill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    On a cluster, master, memory and ``spark.checkpoint.dir`` come from
    spark-submit; only settings that are right at every size are set here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable on the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="run-"), os.path.basename(package))
        shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package))
        spark.sparkContext.addPyFile(archive + ".zip")
        _shipped.add(app)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster.

    A machine-local folder is made only in local mode: other machines could
    not read it, so on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    root = context.getConf().get(CHECKPOINT_KEY) or context.getCheckpointDir()
    if root:
        return root
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return context.getCheckpointDir()


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Redistribute a scan that has fewer splits than the session has cores.

    Costly expressions on one small file would otherwise run on one core. A
    large scan has splits enough and is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *keys) if scan.rdd.getNumPartitions() < cores else scan


def small_table(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """A table of checked size, computed once and marked for broadcast.

    Meant for tables with a row per class. If there turn out to be more than
    ``limit`` rows, the table is returned as it was and gets joined by shuffle.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage like ``checkpoint()``, survives lost executors, and the
    columnar copy gives later stages column pruning and real size statistics.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_path = path
    if (held := _held.get()) is not None:
        held.append(back)
    return back


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder of the cluster."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"file:/", path):
        path = re.sub(r"^file:/+", "/", path)
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def save_file(folder: str, stem: str, suffix: str, content: bytes) -> str:
    """Write one file under a name of its own and return its path.

    The name is unique and the file appears under it only when complete, so a
    repeated or speculative task never touches what another attempt wrote.
    """
    path = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
    system, place = _located(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(place + ".part", compression=None) as out:
        out.write(content)
    system.move(place + ".part", place)
    return path


def load_file(path: str) -> bytes:
    system, place = _located(path)
    with system.open_input_stream(place, compression=None) as source:
        return source.read()


class Folder:
    """A folder of files that tasks write; it goes as the tables of :func:`written` do."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.sparkSession = spark
        self.path = self._written_path = new_folder(spark, name)
        if (held := _held.get()) is not None:
            held.append(self)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that :func:`written` makes inside are deleted when the block ends, well or not."""
    tables: list[DataFrame | Folder] = []
    token = _held.set(tables)
    try:
        yield
    finally:
        _held.reset(token)
        discard(*tables)


def release_shuffles(spark: SparkSession) -> None:
    """Shuffle files stay on the executors' disks until the driver's JVM has collected the plans that made them, which a
    driver with room to spare does hardly ever: ask for it where work that shuffled much is over."""
    gc.collect()
    spark._jvm.System.gc()


def discard(*tables: DataFrame | Folder) -> None:
    """Delete tables that :func:`written` made, and folders, once nothing reads them any more."""
    for table in tables:
        path = getattr(table, "_written_path", None)
        if path is not None:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
