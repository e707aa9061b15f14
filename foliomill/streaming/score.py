"""Score files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from foliomill.operators.review import DEFAULT_THRESHOLD
from foliomill.plans.classify import score_files
from foliomill.plans.model import DocumentModel


def score_stream(
    files: DataFrame,
    model: DocumentModel,
    root: str,
    out: str,
    checkpoint: str,
    threshold: float | None = DEFAULT_THRESHOLD,
    **how,
) -> StreamingQuery:
    """The batch scoring plan on a stream: stateless, so no watermark and no state store."""
    scored = score_files(files.select("path", "content"), model, root, threshold, **how)
    return (
        scored.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
