"""Incremental update: process what is new, retrain if anything was."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.operators.compare import new_files
from foliomill.plans.model import DocumentModel, ModelSettings
from foliomill.plans.process import ROW_COLUMNS, process
from foliomill.plans.train import Evaluation, train
from foliomill.session import scratch
from foliomill.sources.counts import TermCounts
from foliomill.sources.store import ProcessedStore


def new_rows(stored: DataFrame, candidates: DataFrame, dedupe: bool = False) -> DataFrame:
    """Candidates not processed yet, under normalised paths; their own repeats stay unless ``dedupe``."""
    fresh = new_files(candidates, stored)
    return fresh.dropDuplicates(["path"]) if dedupe else fresh


def model_path(base: str, version: int) -> str:
    return f"{base}_v{version}"


def previous_model(base: str, version: int) -> str:
    """Path of the newest model before ``version``; the first version has none before it and needs none."""
    for number in range(version - 1, 0, -1):
        if DocumentModel.exists(model_path(base, number)):
            return model_path(base, number)
    raise FileNotFoundError(f"no model before version {version} at {base}")


@dataclass(frozen=True)
class Updated:
    version: int
    rows: DataFrame
    evaluation: Evaluation | None


def update(
    listed: DataFrame,
    files: DataFrame,
    store: ProcessedStore,
    model_base: str,
    settings: ModelSettings = ModelSettings(),
    lemmas: DataFrame | None = None,
    dedupe: bool = False,
    **how,
) -> Updated:
    """Process the listed files the store has no labelled row of, append them, retrain and save.

    A model has the number of the store version it was trained on. Nothing new means
    no new version, and no retraining either, unless the last run died before its model
    was saved. Terms are counted in the documents only that the last update's model didn't have, or had
    and lost. Files that a stream stored without a label count as new once they are listed.
    From the second version on there must be an earlier model.
    """
    stored = store.read().filter(F.col("doc_type").isNotNull())
    fresh = new_rows(stored, listed, dedupe)
    version = store.next_version()
    if not fresh.isEmpty():
        if version > 1:
            previous_model(model_base, version)
        with scratch():
            store.write(process(fresh, files, store, settings, lemmas=lemmas, **how), version)
    else:
        version -= 1
        if version == 0 or DocumentModel.exists(model_path(model_base, version)):
            return Updated(version, store.latest().select(*ROW_COLUMNS), None)
    rows = store.latest().select(*ROW_COLUMNS)
    counts = TermCounts(store.spark, f"{store.root}/term_counts/{settings.processing()}")
    evaluation = train(rows, settings, lemmas, counts, store.read())
    evaluation.model.save(model_path(model_base, version))
    return Updated(version, rows, evaluation)
