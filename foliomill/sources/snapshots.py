"""Versions of a table with digests in two levels, compared by reading only what differs."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.operators.compare import file_states, row_differences

BUCKETS = 1024
MAX_BUCKETS = 65_536
HEAD_SCHEMA = "buckets int, schema string"


def _row_hash(names: list[str], salt: int) -> Column:
    """64 bits of a row. Spark's hash passes over nulls, so where they stand is hashed too."""
    return F.xxhash64(F.lit(salt), *names, *(F.col(c).isNull() for c in names))


def _digest(rows: DataFrame, *by: str) -> DataFrame:
    """Number of rows and sums of two hashes: the same in any order, and unlike an xor, repeats count."""
    return rows.groupBy(*by).agg(F.sum("rows").alias("rows"), F.sum("first").alias("first"), F.sum("second").alias("second"))


class Snapshot:
    """A table by buckets of a key, with a digest of each bucket and of each group of buckets.

    Rows of one key share a bucket, and so do equal rows of two snapshots: what lies in buckets of equal
    digests needs no comparing. Digests count rows and sum two 64-bit hashes of each. A snapshot is there once
    its groups are, which are written last.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._known: tuple[T.StructType, int] | None = None

    @classmethod
    def write(cls, rows: DataFrame, folder: str, *key: str, buckets: int = BUCKETS) -> "Snapshot":
        """``buckets`` is a number of folders: take about one per gigabyte. A bucket that one key fills is
        split by adaptive execution, as it need not lie in one file."""
        if not 0 < buckets <= MAX_BUCKETS:
            raise ValueError(f"buckets must be in 1..{MAX_BUCKETS}")
        if {"_bucket", "_group"} & set(rows.columns):
            raise ValueError("columns _bucket and _group are the snapshot's own")
        made = cls(rows.sparkSession, folder)
        made._known = rows.schema, buckets
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        located = rows.withColumn("_bucket", bucket).hint("rebalance", "_bucket")
        located.write.partitionBy("_bucket").parquet(f"{made.folder}/rows")
        hashed = made._rows().select(
            "_bucket",
            F.lit(1).cast("bigint").alias("rows"),
            *(_row_hash(rows.columns, salt).cast("decimal(38,0)").alias(n) for salt, n in ((1, "first"), (2, "second"))),
        )
        group = F.floor(F.col("_bucket") / math.isqrt(buckets)).cast("int")
        by_bucket = _digest(hashed, "_bucket").withColumn("_group", group)
        # One row a bucket: sorted by group, so that reading some groups skips the others.
        by_bucket.coalesce(1).sortWithinPartitions("_group").write.parquet(f"{made.folder}/buckets")
        groups = _digest(made._table("buckets"), "_group")
        head = made.spark.createDataFrame([(buckets, rows.schema.json())], HEAD_SCHEMA)
        # An empty table has no groups, but a head all the same.
        head.join(groups, F.lit(True), "left").coalesce(1).write.parquet(f"{made.folder}/groups")
        return made

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _head(self) -> tuple[T.StructType, int]:
        if self._known is None:
            head = self._table("groups").select("schema", "buckets").first()
            self._known = T.StructType.fromJson(json.loads(head["schema"])), head["buckets"]
        return self._known

    def _rows(self) -> DataFrame:
        schema = T.StructType([*self._head()[0].fields, T.StructField("_bucket", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.folder}/rows")

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; only their folders are read."""
        found = self._rows()
        return (found if buckets is None else found.filter(F.col("_bucket").isin(buckets))).drop("_bucket")

    def differing(self, other: "Snapshot") -> list[int]:
        """Buckets whose rows differ: groups are compared first, then the buckets of those that differ.
        There are at most ``MAX_BUCKETS``, each a number here."""
        sizes = {s._head()[1] for s in (self, other)}
        if len(sizes) > 1:
            raise ValueError(f"snapshots of {' and '.join(map(str, sorted(sizes)))} buckets can't be compared")
        groups = _unlike(*(s._table("groups").filter("_group IS NOT NULL").drop("buckets", "schema") for s in (self, other)), "_group")
        within = F.col("_group").isin(groups)
        mine, theirs = (s._table("buckets").filter(within).drop("_group") for s in (self, other))
        return _unlike(mine, theirs, "_bucket")

    def states(self, newer: "Snapshot", path: str = "path", signature: str = "signature") -> DataFrame:
        """``added``, ``removed`` and ``changed`` paths between this snapshot and a newer one, both by path."""
        buckets = self.differing(newer)
        found = file_states(self.rows(buckets), newer.rows(buckets), path, signature)
        return found.filter(F.col("state") != "same")

    def differences(self, newer: "Snapshot") -> DataFrame:
        """Rows that occur more often on one side, with side and surplus."""
        buckets = self.differing(newer)
        return row_differences(self.rows(buckets), newer.rows(buckets))


def _unlike(left: DataFrame, right: DataFrame, key: str) -> list[int]:
    """Keys that only one side has, or with other digests."""
    stacked = left.unionByName(right).groupBy(*left.columns).agg(F.count("*").alias("_sides")).filter("_sides = 1")
    return sorted(r[key] for r in stacked.select(key).distinct().collect())
