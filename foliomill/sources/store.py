"""The processed store: Parquet by version, bucketed by path, with a log of committed versions.

Rows lie in buckets by path, so joining them with anything keyed by path moves the other side
only, and aggregating them by path moves nothing. Parquet's columns serve as the index: what
decides about a row (path, version, signature, processing) is read without its texts.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STORE_SCHEMA = (
    "path string, doc_type string, signature string, raw_text string, processed_text string, "
    "features array<double>, processing string"
)
COMMITS_SCHEMA = "version int, replaces array<int>"
LAYOUT_SCHEMA = "buckets int"
CACHE_COMMITS_SCHEMA = "processing string, generation int"
BUCKETS = 16
CACHE_SCHEMA = "text_md5 string, processed_text string"


def next_version(commits: DataFrame, version: str = "version"):
    """One more than the highest version; 1 when there is none."""
    return commits.agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet folder, or no rows where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


class ProcessedStore:
    """Rows of version n are those first processed in run n.

    A version counts once its number is in the commit log, so a run that dies
    half-way leaves nothing visible, and its rerun overwrites what it left.
    ``buckets`` is fixed when a store is made and kept with it: take about one per
    gigabyte expected, as a task joins a whole bucket. Merged versions lie in folders
    with negative numbers; their rows keep the version they had.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark = spark
        plain = root.rstrip("/")
        self.root = plain if "://" in plain or plain.startswith("/") else os.path.abspath(plain)
        self._buckets = buckets
        self._name: str | None = None

    def _read(self, name: str, schema: str) -> DataFrame:
        return read_or_empty(self.spark, f"{self.root}/{name}", schema)

    def _delete(self, folder: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def _size(self, folder: str) -> int:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        system = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return system.getContentSummary(place).getLength() if system.exists(place) else 0

    def _table(self) -> str:
        """The session's name for the rows: Spark knows buckets of catalog tables only, so each session
        enters the folder anew. The store itself is the folder."""
        if self._name is None:
            layout = self._read("layout", LAYOUT_SCHEMA).first()
            if layout is None:
                if not self.commits().isEmpty():
                    raise ValueError(f"{self.root} was made without buckets: process its files into a new store")
                self.spark.range(1).select(F.lit(self._buckets).alias("buckets")).write.parquet(f"{self.root}/layout")
            buckets = self._buckets if layout is None else layout["buckets"]
            name = "store_" + hashlib.md5(self.root.encode()).hexdigest()
            place = self.root.replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # an external table: no file goes
            self.spark.sql(
                f"CREATE TABLE {name} ({STORE_SCHEMA}, first_version int, version int) USING parquet "
                f"PARTITIONED BY (version) CLUSTERED BY (path) INTO {buckets} BUCKETS LOCATION '{place}/rows'"
            )
            self._name = name
        return self._name

    def commits(self) -> DataFrame:
        return self._read("commits", COMMITS_SCHEMA)

    def next_version(self) -> int:
        return next_version(self.commits()).first()["next_version"]

    def folders(self) -> list[int]:
        """Numbers of the folders that hold the rows: committed and not replaced since."""
        log = self.commits().collect()  # a row per run
        return sorted({r["version"] for r in log} - {v for r in log for v in r["replaces"] or ()})

    def _in(self, folders: list[int]) -> DataFrame:
        name = self._table()
        if folders:
            parts = " ".join(f"PARTITION (version={v})" for v in folders)
            self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {parts}")
        self.spark.catalog.refreshTable(name)
        rows = self.spark.table(name).filter(F.col("version").isin(folders))
        return rows.withColumn("version", F.coalesce("first_version", "version")).drop("first_version")

    def read(self, up_to: int | None = None) -> DataFrame:
        """All committed rows, or those of versions up to a number."""
        rows = self._in(self.folders())
        return rows if up_to is None else rows.filter(F.col("version") <= up_to)

    def _put(self, rows: DataFrame, folder: int) -> None:
        self._delete(f"rows/version={folder}")
        rows.withColumn("version", F.lit(folder)).write.insertInto(self._table())

    def _commit(self, version: int, replaces: list[int]) -> None:
        row = self.spark.createDataFrame([(version, replaces)], COMMITS_SCHEMA)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def write(self, rows: DataFrame, version: int) -> None:
        columns = [c.split()[0] for c in STORE_SCHEMA.split(", ")]
        self._put(rows.select(*columns, F.lit(None).cast("int").alias("first_version")), version)
        if self.commits().filter(F.col("version") == version).isEmpty():
            self._commit(version, [])

    def latest(self) -> DataFrame:
        """For every path, its rows of the newest version that has it. No text is shuffled."""
        rows = self.read()
        newest = rows.groupBy(F.col("path").alias("_path")).agg(F.max("version").alias("_newest"))
        # the newest version is the only one that isn't less; as a key, it would part rows from their buckets
        at_newest = (F.col("path") == F.col("_path")) & (F.col("version") >= F.col("_newest"))
        return rows.join(newest.hint("shuffle_hash"), at_newest).drop("_path", "_newest")

    def states(self) -> DataFrame:
        """(path, version, signature, processing) of every path's newest row; reads no text."""
        newest = F.max(F.struct("version", "signature", "processing")).alias("_newest")
        return self.read().groupBy("path").agg(newest).select("path", "_newest.*")

    def stored(self, wanted: DataFrame) -> DataFrame:
        """Texts, features and processing of the wanted paths' newest rows beside the wanted columns, one
        stored row for each time a path is wanted. No text is shuffled."""
        one = self.latest().select("path", "raw_text", "processed_text", "features", "processing").dropDuplicates(["path"])
        return one.join(wanted.hint("shuffle_hash"), "path")

    def compact(self, small_bytes: int = 1 << 30) -> list[int]:
        """Merge the folders of less than ``small_bytes`` into one with a file per bucket; returns
        which were merged. Tasks read a bucket of each folder and write one, without a shuffle.

        The merge counts once it is committed; until then the old folders are read. They are
        deleted by the next call only, as running queries may read them. Every version stays readable.
        """
        live = self.folders()
        known = {r["version"] for r in self.commits().collect()}
        for gone in known - set(live):
            self._delete(f"rows/version={gone}")
        small = [v for v in live if self._size(f"rows/version={v}") < small_bytes]
        if len(small) < 2:
            return []
        rows = self._in(small)
        columns = [c.split()[0] for c in STORE_SCHEMA.split(", ")]
        setting = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, "false")  # a task per bucket, though nothing here asks for it
        try:
            folder = min(known | {0}) - 1
            self._put(rows.select(*columns, F.col("version").alias("first_version")), folder)
        finally:
            self.spark.conf.set(setting, before)
        self._commit(folder, small)
        return small

    def _generation(self, processing: str) -> int:
        log = self._read("text_cache_commits", CACHE_COMMITS_SCHEMA).filter(F.col("processing") == processing)
        return log.agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0]

    def text_cache(self, processing: str) -> DataFrame:
        """Cleaned texts by digest, for one way of processing (a folder of its own)."""
        kept = self._read("text_cache", CACHE_SCHEMA + ", processing string, generation int")
        now = (F.col("processing") == processing) & (F.col("generation") == self._generation(processing))
        return kept.filter(now).drop("processing", "generation")

    def add_to_text_cache(self, entries: DataFrame, processing: str) -> None:
        """Entries appended twice do no harm: readers take one per digest."""
        entries.select("text_md5", "processed_text").write.mode("append").parquet(
            f"{self.root}/text_cache/processing={processing}/generation={self._generation(processing)}"
        )

    def compact_text_cache(self, processing: str) -> None:
        """One entry per digest, in a generation of its own that counts once it is committed. The one
        before is deleted by the next call only. An entry added meanwhile is cleaned again when wanted."""
        now = self._generation(processing)
        if now:
            self._delete(f"text_cache/processing={processing}/generation={now - 1}")
        merged = self.text_cache(processing).dropDuplicates(["text_md5"])
        merged.write.mode("overwrite").parquet(f"{self.root}/text_cache/processing={processing}/generation={now + 1}")
        row = self.spark.createDataFrame([(processing, now + 1)], CACHE_COMMITS_SCHEMA)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/text_cache_commits")
