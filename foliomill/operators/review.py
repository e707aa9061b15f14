"""Review flag, listing and summary of scored documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_THRESHOLD = 80


def flag_for_review(df: DataFrame, threshold: float | None, confidence: str = "confidence") -> DataFrame:
    """Mark rows whose rounded confidence is below the threshold; no threshold, no column."""
    if threshold is None:
        return df
    return df.withColumn("needs_review", F.col(confidence) < F.lit(threshold))


def review_queue(df: DataFrame, limit: int = 10, order: str = "file_path") -> DataFrame:
    """The least certain flagged documents."""
    return (
        df.filter("needs_review")
        .orderBy("confidence", order)
        .limit(limit)
        .select("file_name", "document_type", "confidence")
    )


def review_summary(df: DataFrame) -> DataFrame:
    """How many documents need review, of how many, in percent to one decimal."""
    return df.agg(F.count_if("needs_review").alias("review_count"), F.count("*").alias("total_count")).withColumn(
        "review_percent",
        F.round(F.try_divide(F.col("review_count") * 100.0, F.col("total_count")), 1),
    )
