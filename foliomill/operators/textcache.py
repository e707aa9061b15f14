"""Clean each distinct text once, reusing stored results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.functions.text import text_hash


def resolve_texts(docs: DataFrame, cache: DataFrame, text: str, process: Callable[[Column], Column]) -> DataFrame:
    """(text_md5, processed_text, hit) for every distinct text of ``docs``.

    Copies collapse map-side, so a text that fills a third of the rows is one
    row here; only misses evaluate ``process``. The cache is first cut to the
    wanted digests: for a small batch that is a broadcast, and a large cache is
    not shuffled. A digest stored twice counts once.
    """
    wanted = (
        docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))
        .select(text_hash(F.col("_text")).alias("text_md5"), "_text")
        .groupBy("text_md5")
        .agg(F.first("_text").alias("_text"))
    )
    stored = (
        cache.join(wanted.select("text_md5"), "text_md5", "left_semi")
        .groupBy("text_md5")
        .agg(F.first("processed_text").alias("_stored"))
    )
    hit = F.col("_stored").isNotNull()
    return wanted.join(stored, "text_md5", "left").select(
        "text_md5",
        F.when(hit, F.col("_stored")).otherwise(process(F.col("_text"))).alias("processed_text"),
        hit.alias("hit"),
    )


def new_entries(resolved: DataFrame) -> DataFrame:
    """Rows to add to the cache."""
    return resolved.filter(~F.col("hit")).select("text_md5", "processed_text")


def with_processed(docs: DataFrame, resolved: DataFrame, text: str) -> DataFrame:
    """Give every document its processed text; a hot text is split by adaptive skew joins."""
    keyed = docs.withColumn("text_md5", text_hash(F.coalesce(F.col(text), F.lit(""))))
    return keyed.join(resolved, "text_md5", "left")
