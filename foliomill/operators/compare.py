"""What is new, changed or gone between two versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions.paths import normalize_location


def new_files(candidates: DataFrame, seen: DataFrame, path: str = "path") -> DataFrame:
    """Candidates whose normalised path is not in ``seen``; repeats among them are kept.

    The seen paths are made distinct first (map-side combined). Which side is
    broadcast, and how a hot path is split, is left to adaptive execution,
    which decides on measured sizes.
    """
    keys = seen.select(normalize_location(F.col(path)).alias(path)).distinct()
    # A coalesced key is never null, so no null test that would fold the path again is put below the join.
    located = candidates.withColumn(path, normalize_location(F.col(path)))
    key = F.coalesce(F.col(path), F.lit(""))
    seen_key = F.coalesce(F.col("_seen"), F.lit(""))
    return located.join(keys.withColumnRenamed(path, "_seen").filter(F.col("_seen") != ""), key == seen_key, "left_anti")


def file_states(stored: DataFrame, current: DataFrame, path: str = "path", signature: str = "signature") -> DataFrame:
    """``added`` / ``removed`` / ``changed`` / ``same`` for every path of either side.

    Null signatures equal each other. Both sides are stacked and aggregated by
    path: one shuffle with map-side combining, instead of a full outer join
    that cannot split a hot key.
    """
    stacked = stored.select(path, F.col(signature).alias("_old"), F.lit(None).cast("string").alias("_new"), F.lit(True).alias("_is_old")).unionByName(
        current.select(path, F.lit(None).cast("string").alias("_old"), F.col(signature).alias("_new"), F.lit(False).alias("_is_old"))
    )
    merged = stacked.groupBy(path).agg(
        F.max("_old").alias("_old"),
        F.max("_new").alias("_new"),
        F.bool_or("_is_old").alias("_in_old"),
        F.bool_or(~F.col("_is_old")).alias("_in_new"),
    )
    return merged.select(
        path,
        F.when(~F.col("_in_old"), "added")
        .when(~F.col("_in_new"), "removed")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "same")
        .otherwise("changed")
        .alias("state"),
    )


def is_stale(states: DataFrame) -> bool:
    """Whether anything differs; stops at the first difference found."""
    return not states.filter(F.col("state") != "same").isEmpty()


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stack by column name; missing columns become null, repeats stay."""
    return old.unionByName(new, allowMissingColumns=True)


def row_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that occur more often on one side, with side and surplus.

    One signed count over both tables replaces two multiset differences.
    """
    names = old.columns
    signed = old.select(*names, F.lit(-1).alias("_sign")).unionByName(new.select(*names, F.lit(1).alias("_sign")))
    return (
        signed.groupBy(*names)
        .agg(F.sum("_sign").alias("_surplus"))
        .filter(F.col("_surplus") != 0)
        .select(
            *names,
            F.when(F.col("_surplus") > 0, "new").otherwise("old").alias("side"),
            F.abs("_surplus").alias("surplus"),
        )
    )


def same_rows(old: DataFrame, new: DataFrame) -> bool:
    return set(old.columns) == set(new.columns) and row_differences(old, new).isEmpty()
