"""Result files and the error log."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# Quotes are doubled and empty strings are written as nothing, as most CSV readers expect.
CSV = {"header": "true", "escape": '"', "emptyValue": ""}

# The headings of the error log.
ERROR_LOG_HEADINGS = ("Timestamp", "PDF File Path", "Page Number", "Error Message")


def write_csv(df: DataFrame, path: str | None) -> None:
    """One CSV folder with headers; nothing without a path."""
    if path:
        df.write.mode("overwrite").options(**CSV).csv(path)


def error_log(errors: DataFrame) -> DataFrame:
    """(ts, path, page_no, message) under the log's headings; no page is ``N/A``."""
    stamp, path, page, message = ERROR_LOG_HEADINGS
    return errors.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(stamp),
        F.col("path").alias(path),
        F.coalesce(F.col("page_no").cast("string"), F.lit("N/A")).alias(page),
        F.col("message").alias(message),
    )


def append_error_log(errors: DataFrame, path: str) -> bool:
    """Append to the log; a log that cannot be written never fails the job."""
    try:
        error_log(errors).write.mode("append").options(**CSV).csv(path)
        return True
    except Exception as problem:
        log.warning("could not write error log %s: %s", path, problem)
        return False
