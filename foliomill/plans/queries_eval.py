"""Queries over labels, splits and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.functions.numeric import rounded
from foliomill.functions.numeric import confidence_pct as confidence
from foliomill.operators import labels as lb
from foliomill.operators import metrics as mt
from foliomill.operators import review as rv
from foliomill.operators import sampling as sm
from foliomill.plans import tables as tb
from foliomill.plans.registry import query


@query(
    """SELECT lang, CAST(row_number() OVER (ORDER BY first_id, lang) - 1 AS INTEGER) AS label
    FROM (SELECT lang, min(doc_id) AS first_id FROM documents GROUP BY lang)"""
)
def label_map(spark, sf_dir):
    return lb.label_map(tb.table(spark, sf_dir, "documents"), "lang", "doc_id")


@query(
    """WITH known AS (
      SELECT lang, min(d.doc_id) AS first_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id
      WHERE l.toxic = 1 GROUP BY lang
    ),
    mapping AS (SELECT lang, CAST(row_number() OVER (ORDER BY first_id, lang) - 1 AS INTEGER) AS label FROM known)
    SELECT d.doc_id, d.lang, m.label FROM documents d LEFT JOIN mapping m ON m.lang = d.lang"""
)
def encode_labels(spark, sf_dir):
    """The map comes from the toxic documents, so a language unseen there has no number."""
    docs = tb.table(spark, sf_dir, "documents").select("doc_id", "lang")
    toxic = tb.table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    mapping = lb.label_map(docs.join(toxic, "doc_id"), "lang", "doc_id")
    return lb.encode_labels(docs, mapping, "lang").select("doc_id", "lang", "label")


@query(
    """SELECT quality, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 6) AS weight
    FROM labels GROUP BY quality"""
)
def class_weights(spark, sf_dir):
    weights = lb.class_weights(tb.table(spark, sf_dir, "labels"), "quality")
    return weights.withColumn("weight", rounded(F.col("weight")))


_RANKED_SQL = """
ranked AS (
  SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) - 1 AS rank
  FROM labels
)"""


@query(
    f"""WITH {_RANKED_SQL},
    counts AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality),
    shares AS (
      SELECT quality, n * 20 // 100 AS base,
             row_number() OVER (ORDER BY n * 20 % 100 DESC, quality) AS place,
             (sum(n) OVER () * 20 + 99) // 100 - sum(n * 20 // 100) OVER () AS spare
      FROM counts
    )
    SELECT doc_id, r.quality, rank < base + CASE WHEN place <= spare THEN 1 ELSE 0 END AS is_test
    FROM ranked r JOIN shares s ON s.quality = r.quality"""
)
def stratified_split(spark, sf_dir):
    rows = tb.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return sm.stratified_split(rows, "quality", "doc_id")


@query(f"WITH {_RANKED_SQL} SELECT doc_id, quality, CAST(rank % 5 AS INTEGER) AS fold FROM ranked")
def stratified_folds(spark, sf_dir):
    return sm.stratified_folds(tb.table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id")


def _scored(spark, sf_dir):
    return tb.predictions(spark, sf_dir).withColumn("confidence", confidence(F.col("probability")))


@query(f"WITH {tb.PREDICTIONS_SQL} SELECT doc_id, confidence FROM scored")
def confidence_pct(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "confidence")


@query(f"WITH {tb.PREDICTIONS_SQL} SELECT doc_id, confidence, confidence < 80 AS needs_review FROM scored")
def needs_review(spark, sf_dir):
    return rv.flag_for_review(_scored(spark, sf_dir), rv.DEFAULT_THRESHOLD).select("doc_id", "confidence", "needs_review")


@query(
    f"""WITH {tb.PREDICTIONS_SQL}
    SELECT file_name, document_type, confidence FROM scored WHERE confidence < 80
    ORDER BY confidence, file_path LIMIT 10"""
)
def review_queue(spark, sf_dir):
    return rv.review_queue(rv.flag_for_review(_scored(spark, sf_dir), rv.DEFAULT_THRESHOLD))


@query(
    f"""WITH {tb.PREDICTIONS_SQL}
    SELECT count(*) FILTER (confidence < 80) AS review_count, count(*) AS total_count,
           round(count(*) FILTER (confidence < 80) * 100.0::DOUBLE / count(*), 1) AS review_percent
    FROM scored"""
)
def review_summary(spark, sf_dir):
    return rv.review_summary(rv.flag_for_review(_scored(spark, sf_dir), rv.DEFAULT_THRESHOLD))


@query(
    f"""WITH {tb.PREDICTIONS_SQL}
    SELECT count(*) FILTER (label = prediction) AS hits, count(*) AS n,
           round(avg((label = prediction)::INTEGER), 6) AS accuracy
    FROM predictions"""
)
def accuracy(spark, sf_dir):
    return mt.accuracy(tb.predictions(spark, sf_dir)).withColumn("accuracy", rounded(F.col("accuracy")))


_MATRIX_SQL = f"""{tb.PREDICTIONS_SQL},
classes AS (SELECT label AS c FROM predictions UNION SELECT prediction FROM predictions),
matrix AS (
  SELECT a.c AS label, b.c AS prediction, count(p.doc_id) AS n
  FROM classes a CROSS JOIN classes b LEFT JOIN predictions p ON p.label = a.c AND p.prediction = b.c
  GROUP BY a.c, b.c
)"""


@query(f"WITH {_MATRIX_SQL} SELECT label, prediction, n FROM matrix")
def confusion_matrix(spark, sf_dir):
    return mt.confusion_matrix(tb.predictions(spark, sf_dir))


@query(
    f"""WITH {_MATRIX_SQL},
    totals AS (
      SELECT c, sum(n) FILTER (label = c)::DOUBLE AS support, sum(n) FILTER (prediction = c)::DOUBLE AS predicted,
             sum(n) FILTER (label = c AND prediction = c)::DOUBLE AS hits
      FROM matrix CROSS JOIN classes GROUP BY c
    ),
    per_class AS (
      SELECT CAST(c AS VARCHAR) AS class, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS precision,
             CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall,
             CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * hits / (predicted + support) END AS f1, support
      FROM totals
    ),
    report AS (
      SELECT * FROM per_class
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per_class
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
             sum(f1 * support) / sum(support), sum(support) FROM per_class
    )
    SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
           CAST(support AS BIGINT) AS support
    FROM report"""
)
def classification_report(spark, sf_dir):
    report = mt.classification_report(tb.predictions(spark, sf_dir))
    return report.select("class", *[rounded(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    f"""WITH {tb.PREDICTIONS_SQL},
    folds AS (
      SELECT label, prediction,
             (row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) - 1) % 5 AS fold
      FROM predictions
    ),
    scores AS (SELECT fold, avg((label = prediction)::INTEGER) AS accuracy FROM folds GROUP BY fold)
    SELECT count(*) AS folds, round(avg(accuracy), 6) AS mean_accuracy, round(stddev_pop(accuracy), 6) AS std_accuracy
    FROM scores"""
)
def cv_summary(spark, sf_dir):
    folds = sm.stratified_folds(tb.predictions(spark, sf_dir), "label", "doc_id")
    hit = (F.col("label") == F.col("prediction")).cast("double")
    scores = folds.groupBy("fold").agg(F.avg(hit).alias("accuracy"))
    summary = mt.cv_summary(scores)
    return summary.select(
        "folds", *[rounded(F.col(c)).alias(c) for c in ("mean_accuracy", "std_accuracy")]
    )
