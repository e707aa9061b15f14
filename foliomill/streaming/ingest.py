"""Process new files as they arrive, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliomill.operators.compare import new_files
from foliomill.plans.model import ModelSettings
from foliomill.plans.process import process_contents
from foliomill.session import scratch, small_table
from foliomill.sources.files import named_like, target_files, with_signature
from foliomill.sources.store import ProcessedStore

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_tree(spark: SparkSession, root: str, suffix: str, files_per_batch: int = 10_000) -> DataFrame:
    """Files below ``root`` as a stream; a batch takes a bounded number of them."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
    )
    return target_files(files.withColumn("path", named_like(F.col("path"), root)), suffix)


def ingest(
    files: DataFrame, store: ProcessedStore, settings: ModelSettings, checkpoint: str, **how
) -> StreamingQuery:
    """Append unseen files to the store, one version per batch, until the source is drained.

    A repeated batch is harmless: before the version is committed the rerun
    overwrites it, afterwards the anti join finds nothing new.
    """

    def batch(rows: DataFrame, _: int) -> None:
        # The store's paths are read without their texts, in their buckets; a batch's paths are sent if few.
        seen = store.read().select("path").join(small_table(rows.select("path")), "path", "left_semi")
        fresh = new_files(with_signature(rows).select("path", "signature", "content"), seen)
        fresh = fresh.withColumn("doc_type", F.lit(None).cast("string"))
        if not fresh.select("path").isEmpty():
            with scratch():
                store.write(process_contents(fresh, store, settings, **how), store.next_version())

    return (
        files.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
