"""File scans: labelled lists, trees, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions.paths import normalize_location, without_authority

# The column headings of a labelled list.
LABELLED_HEADINGS = ("File Path", "Document types")


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled list from CSV with a header: (path, doc_type), paths normalised.

    Columns are found by heading and read as text; types are never inferred.
    """
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return raw.select(normalize_location(plain_path(F.col(LABELLED_HEADINGS[0]))).alias("path"), F.col(LABELLED_HEADINGS[1]).alias("doc_type"))


def listed_types(listed: DataFrame) -> tuple[str, ...]:
    """The document types of a list that :func:`read_labelled` read, in order of first appearance.

    A file is read whole by one task, so row numbers follow its lines; several files come in Spark's order.
    """
    placed = listed.select("doc_type", F.monotonically_increasing_id().alias("place")).filter(F.col("doc_type").isNotNull())
    found = placed.groupBy("doc_type").agg(F.min("place").alias("place")).collect()  # a row per type
    return tuple(r["doc_type"] for r in sorted(found, key=lambda r: r["place"]))


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every file under ``root``: path, modificationTime, length, content.

    ``content`` is read only by plans that select it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.withColumn("path", named_like(F.col("path"), root))


def named_like(location: Column, root: str) -> Column:
    """Scanned locations in the form the root was given: a root without a scheme gives plain paths."""
    return plain_path(location) if "://" in root else without_authority(location)


def plain_path(uri: Column) -> Column:
    """Drop the ``file:`` scheme of local files; other schemes stay."""
    return F.regexp_replace(uri, F.lit("^file:/+"), F.lit("/"))


def is_target(path: Column, suffix: str) -> Column:
    """Suffix test on the whole lower-cased path."""
    return F.lower(path).endswith(suffix.lower())


def target_files(files: DataFrame, suffix: str, path: str = "path") -> DataFrame:
    return files.filter(is_target(F.col(path), suffix))


def other_files(files: DataFrame, suffix: str, path: str = "path") -> DataFrame:
    """The complement of :func:`target_files`, as one column: ``non_pdf_files`` for ``.pdf``."""
    heading = f"non_{suffix.lstrip('.#')}_files"
    return files.filter(~is_target(F.col(path), suffix)).select(F.col(path).alias(heading))


def signature(path: Column, size: Column, modified: Column, content: Column | None = None) -> Column:
    """``path-size-mtime``; null if any part is null.

    File listings carry milliseconds. Passing the content adds its digest, so
    an edit within one millisecond is still seen, at the price of reading it.
    """
    parts = [path, F.lit("-"), size.cast("string"), F.lit("-"), modified.cast("string")]
    if content is not None:
        parts += [F.lit("-"), F.md5(content)]
    return F.concat(*parts)


def with_signature(files: DataFrame, use_content: bool = False) -> DataFrame:
    content = F.col("content") if use_content else None
    return files.withColumn(
        "signature", signature(F.col("path"), F.col("length"), F.unix_micros("modificationTime"), content)
    )
