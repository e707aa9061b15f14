"""Score a tree of files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions.paths import path_columns
from foliomill.operators.pages import SPARSE_PAGE_CHARS
from foliomill.operators.review import DEFAULT_THRESHOLD, flag_for_review
from foliomill.plans.model import DocumentModel, prepare
from foliomill.session import written
from foliomill.sources.extract import Extractor, decode_utf8, extract_documents, failures
from foliomill.sources.files import other_files, scan_tree, target_files
from foliomill.sources.sinks import append_error_log, write_csv


def score_files(
    files: DataFrame,
    model: DocumentModel,
    root: str,
    threshold: float | None = DEFAULT_THRESHOLD,
    extractor: Extractor = decode_utf8,
    min_chars: int = SPARSE_PAGE_CHARS,
) -> DataFrame:
    """(path columns, document_type, confidence[, needs_review]) for files (path, content).

    Extraction, cleaning, projection and the forest all work row by row: the
    plan has no shuffle at any size, and the same plan runs on a stream. With a
    lemma table too large to send, :func:`prepare` joins instead.
    """
    return finish(extract_documents(files, extractor, min_chars), model, root, threshold)


def finish(extracted: DataFrame, model: DocumentModel, root: str, threshold: float | None, *kept: str) -> DataFrame:
    """Score extracted files; ``kept`` names further columns to carry along."""
    scored = model.score(prepare(extracted, model.settings, model.lemmas, keep_raw=False))
    return flag_for_review(
        scored.select(*path_columns(F.col("path"), root), "document_type", "confidence", *kept), threshold
    )


@dataclass(frozen=True)
class Classified:
    results: DataFrame
    others: DataFrame
    #: documents, failed and, with a threshold, flagged: counted in the written results.
    counts: dict[str, int]


def classify_tree(
    spark: SparkSession,
    root: str,
    model_path: str,
    suffix: str,
    results_csv: str | None = None,
    others_csv: str | None = None,
    error_log: str | None = None,
    threshold: float | None = None,
    extractor: Extractor = decode_utf8,
    min_chars: int = SPARSE_PAGE_CHARS,
) -> Classified:
    """Scan, extract, clean, score, flag and write. ``root`` is an absolute path or a URI.

    Files are read once: scored rows with their errors are written to the shared folder,
    and the CSV, the error log and what the caller does with the results come from there.
    """
    if not root.startswith("/") and "://" not in root:
        raise ValueError(f"root must be an absolute path or a URI, got {root!r}")
    model = DocumentModel.load(model_path)
    tree = scan_tree(spark, root)
    extracted = extract_documents(target_files(tree, suffix).select("path", "content"), extractor, min_chars)
    errors = ("path", "error_page", "error")
    scored = written(finish(extracted, model, root, threshold, *errors), "classified")
    flagged = [F.count_if("needs_review").alias("flagged")] if threshold is not None else []
    # Over two narrow columns of the written table. Observed metrics would come with the pass itself, but a
    # session that has observed can't send out a forest it fits later: its summary holds the session.
    counts = scored.agg(F.count("*").alias("documents"), F.count("error").alias("failed"), *flagged).first().asDict()
    results = scored.drop(*errors)
    others = other_files(tree, suffix)
    write_csv(results, results_csv)
    write_csv(others, others_csv)
    if error_log and counts["failed"]:
        append_error_log(failures(scored), error_log)
    return Classified(results, others, counts)
