"""Queries that fit models.

What SQL can compute of them is registered next to its SQL: who was held out, class
supports, whether the model beats the majority class, and the columns that don't
depend on the trees. The full outputs are functions; tests look at them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.functions.numeric import rounded
from foliomill.functions.text import tokens
from foliomill.operators.lemmas import build_lemma_table, lemmatize
from foliomill.operators.sampling import stratified_folds
from foliomill.operators.svd import fit_svd, project
from foliomill.operators.terms import TermSpace, sparse_rows, vocabulary
from foliomill.plans import tables as tb
from foliomill.plans import train as tr
from foliomill.plans.classify import score_files
from foliomill.plans.model import ModelSettings, prepare
from foliomill.plans.registry import query
from foliomill.session import discard, spread, written
from foliomill.sources.extract import extract_documents

SETTINGS = ModelSettings()


def _contents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("content", F.encode("text", "UTF-8"))


def labelled_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labelled documents as training rows, extracted as scoring does, and their lemma table;
    the language is the document type."""
    docs = _contents(tb.stored_documents(spark, sf_dir)).select(
        "path", F.col("lang").alias("doc_type"), F.col("doc_id").alias("position"), "content"
    )
    # Written, as the lemma table and the rows both read it: every file is extracted and cleaned once.
    columns = ("path", "doc_type", "position", "processed_text", "features")
    extracted = written(prepare(extract_documents(docs), SETTINGS, None).select(*columns), "extracted")
    lemmas = written(build_lemma_table(extracted.select(tokens(F.col("processed_text")).alias("words")), "words"), "lemmas")
    rows = written(lemmatize(extracted, "processed_text", lemmas), "labelled-rows")
    discard(extracted)
    return rows, lemmas


@query()
def svd_project(spark, sf_dir):
    docs = written(tb.cleaned(spark, sf_dir), "cleaned")
    space = TermSpace.collect(vocabulary(docs, "processed_text"))
    rows = written(sparse_rows(docs, "processed_text", space).drop("processed_text"), "svd-rows")
    model = fit_svd(rows, space.size, rows.count())
    return project(rows, model).select("doc_id", F.posexplode("text_features").alias("component", "value")).select(
        "doc_id", "component", rounded(F.col("value")).alias("value")
    )


_LEADING_SQL = f"""WITH RECURSIVE {tb.VOCABULARY_SQL},
raw AS (SELECT doc_id, term, (1 + ln(tf::DOUBLE)) * idf AS w FROM doc_terms JOIN vocab USING (term)),
weights AS MATERIALIZED (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw),
power AS (
  SELECT 0 AS step, term, 1 / sqrt(count(*) OVER ()) AS x, 0::DOUBLE AS size FROM vocab
  UNION ALL
  SELECT step + 1, term, y / sqrt(sum(y * y) OVER ()), sqrt(sum(y * y) OVER ())
  FROM (
    SELECT seen.step, weights.term, sum(weight * seen.along) AS y
    FROM weights JOIN (
      SELECT max(step) AS step, doc_id, sum(weight * x) AS along
      FROM power JOIN weights USING (term) WHERE step < 80 GROUP BY doc_id
    ) seen USING (doc_id)
    GROUP BY ALL
  )
)
SELECT doc_id, round(sum(weight * x), 4) + 0.0::DOUBLE AS along, round(sqrt(max(size)), 4) AS singular_value
FROM weights JOIN power USING (term) WHERE step = 80 GROUP BY doc_id"""


@query(_LEADING_SQL)
def svd_leading(spark, sf_dir):
    """Every document along the leading direction, and its singular value; SQL finds them by power iteration.

    Documents without a term of the vocabulary are left out. Twelve passes leave an error far
    below the four decimals.
    """
    docs = written(tb.cleaned(spark, sf_dir), "cleaned")
    space = TermSpace.collect(vocabulary(docs, "processed_text"))
    rows = written(sparse_rows(docs, "processed_text", space).drop("processed_text"), "svd-rows")
    model = fit_svd(rows, space.size, rows.count(), k=1, passes=12)
    return project(rows.filter(F.size("indices") > 0), model).select(
        "doc_id",
        rounded(F.get("text_features", F.lit(0)), 4).alias("along"),
        F.lit(round(float(model.singular_values[0]), 4)).alias("singular_value"),
    )


_LABELLED_SQL = f"""
listed AS (
  SELECT {tb.DOC_PATH_SQL} AS path, d.lang, d.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || path), path) - 1 AS rank FROM listed
)"""


def forest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole hold-out report."""
    rows, lemmas = labelled_rows(spark, sf_dir)
    return tr.train(rows, SETTINGS, lemmas).report()


@query(
    f"""WITH {_LABELLED_SQL},
    counts AS (SELECT lang, count(*) AS n, min(doc_id) AS first FROM listed GROUP BY lang),
    shares AS (
      SELECT lang, n * 20 // 100 AS base,
             row_number() OVER (ORDER BY n * 20 % 100 DESC, first) AS place,
             (sum(n) OVER () * 20 + 99) // 100 - sum(n * 20 // 100) OVER () AS spare
      FROM counts
    ),
    held_out AS (
      SELECT r.lang, count(*) AS support FROM ranked r JOIN shares s ON s.lang = r.lang
      WHERE rank < base + CASE WHEN place <= spare THEN 1 ELSE 0 END GROUP BY r.lang
    )
    SELECT lang AS "class", support, max(support) OVER () / (sum(support) OVER ())::DOUBLE AS majority, TRUE AS beats_majority
    FROM held_out"""
)
def train_forest(spark, sf_dir):
    """Held-out rows by class, the majority class's share, and whether the accuracy is above it."""
    report = forest_report(spark, sf_dir)
    classes = report.filter(~F.col("class").isin("accuracy", "macro avg", "weighted avg") & (F.col("support") > 0))
    hit = report.filter(F.col("class") == "accuracy").select(F.col("precision").alias("hit")).first()[0]
    every = Window.partitionBy()
    return classes.select(
        "class",
        "support",
        (F.max("support").over(every) / F.sum("support").over(every).cast("double")).alias("majority"),
        (F.lit(hit) > F.max("support").over(every) / F.sum("support").over(every).cast("double")).alias("beats_majority"),
    )


@query(
    f"""WITH {_LABELLED_SQL},
    counts AS (SELECT CAST(rank % 5 AS INTEGER) AS fold, lang, count(*) AS n FROM ranked GROUP BY ALL)
    SELECT fold, CAST(sum(n) AS BIGINT) AS n, max(n) AS majority, TRUE AS beats_majority FROM counts GROUP BY fold"""
)
def cross_validate(spark, sf_dir):
    """Rows of each fold, those of its largest class, and whether the fold's model hits more."""
    rows, lemmas = labelled_rows(spark, sf_dir)
    scores = tr.cross_validate(rows, SETTINGS, lemmas).select("fold", "hits")
    numbered, _ = tr.number_labels(rows)
    folds = stratified_folds(numbered.select("path", "label"), "label", "path", SETTINGS.folds, SETTINGS.seed)
    by_class = folds.groupBy("fold", "label").agg(F.count("*").alias("n"))
    sizes = written(by_class.groupBy("fold").agg(F.sum("n").alias("n"), F.max("n").alias("majority")), "cv-sizes")
    discard(rows)
    return sizes.join(scores, "fold").select("fold", "n", "majority", (F.col("hits") > F.col("majority")).alias("beats_majority"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the labelled documents, then score every document from its bytes."""
    rows, lemmas = labelled_rows(spark, sf_dir)
    model = tr.train(rows, SETTINGS, lemmas).model
    files = _contents(spread(tb.table(spark, sf_dir, "documents"), "doc_id")).select(
        tb.document_path().alias("path"), "content"
    )
    return score_files(files, model, tb.ARCHIVE)


@query(
    """SELECT doc_id || '.txt' AS file_name, '/archive/' || source || '/' || doc_id || '.txt' AS file_path,
       '' AS main_folder, source AS parent_folder, source AS relative_folder,
       source AS component_name, TRUE AS type_is_known, TRUE AS confidence_in_range, TRUE AS flag_follows
    FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, source FROM documents)"""
)
def classify_documents(spark, sf_dir):
    """Every document's path columns, and checks of its type, confidence and review flag."""
    known = tb.table(spark, sf_dir, "documents").select(F.sort_array(F.collect_set("lang"))).first()[0]
    return classified(spark, sf_dir).select(
        "file_name",
        "file_path",
        "main_folder",
        "parent_folder",
        "relative_folder",
        "component_name",
        F.col("document_type").isin(known).alias("type_is_known"),
        F.col("confidence").between(100 / len(known), 100).alias("confidence_in_range"),
        (F.col("needs_review") == (F.col("confidence") < 80)).alias("flag_follows"),
    )
