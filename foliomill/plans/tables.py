"""Input tables of the registered queries, and the SQL that builds the same inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions.numeric import hash_int
from foliomill.functions.stopwords import ENGLISH
from foliomill.functions.text import clean_replace, joined, tokens
from foliomill.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


# --- text -----------------------------------------------------------------

# The patterns and their replacements that cleaning must match, in SQL.
CLEAN_REPLACE_SQL = r"""
lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({text},
  '\b(?:page\s+\d+|section\s+[ivx]+)\b', '', 'gi'),
  '\b\d+-\d+\b', 'PARTNUM', 'g'),
  '\b(?:IEC|ISO|DIN)\s+\d+\b', 'STANDARD', 'g'),
  '[^a-zA-Z\s]', '', 'g'))
"""
CLEAN_DELETE_SQL = r"""
lower(regexp_replace(regexp_replace({text},
  '\b(?:page\s+\d+|section\s+[ivx]+|\d+-\d+|(?:IEC|ISO|DIN)\s+\d+)\b', '', 'gi'),
  '[^a-zA-Z\s]', '', 'g'))
"""
TOKENS_SQL = r"list_filter(string_split_regex({text}, '\s+'), lambda x: x <> '')"
STOPWORDS_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH) + "]"

TOKENIZED_SQL = f"""
tokenized AS (
  SELECT doc_id, {TOKENS_SQL.format(text=CLEAN_REPLACE_SQL.format(text='text'))} AS toks FROM documents
)"""
TERMS_SQL = f"""{TOKENIZED_SQL},
long_tokens AS (SELECT doc_id, list_filter(toks, lambda x: length(x) >= 2) AS t FROM tokenized),
term_lists AS (
  SELECT doc_id, t, t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) AS terms
  FROM long_tokens
),
occurrences AS (SELECT doc_id, unnest(terms) AS term FROM term_lists),
doc_terms AS (SELECT doc_id, term, count(*) AS tf FROM occurrences GROUP BY doc_id, term)"""
VOCABULARY_SQL = f"""{TERMS_SQL},
sized AS (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf,
         (SELECT count(*) FROM documents)::DOUBLE AS n_docs
  FROM doc_terms GROUP BY term
),
vocab AS (
  SELECT term, df, cf, n_docs, ln((1 + n_docs) / (1 + df)) + 1 AS idf
  FROM sized WHERE df >= 3 AND df <= n_docs * 0.9::DOUBLE
  ORDER BY cf DESC, term LIMIT 25000
)"""


def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their cleaned tokens."""
    return documents(spark, sf_dir).select("doc_id", tokens(clean_replace(F.col("text"))).alias("toks"))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with cleaned text, tokens parted by one space."""
    return tokenized(spark, sf_dir).select("doc_id", joined(F.col("toks")).alias("processed_text"))


# --- predictions ------------------------------------------------------------
# Stand-in predictions: a digest of the document id decides right or wrong.

PREDICTIONS_SQL = """
predictions AS (
  SELECT l.doc_id, l.quality AS label,
         CASE WHEN substr(md5('p:' || l.doc_id), 1, 1) IN ('0', '1', '2') THEN 1 - l.quality ELSE l.quality END AS prediction,
         0.5::DOUBLE + ('0x' || substr(md5('p:' || l.doc_id), 1, 8))::BIGINT / 8589934592.0::DOUBLE AS probability,
         d.source || '/' || l.doc_id AS file_path, CAST(l.doc_id AS VARCHAR) AS file_name, d.lang AS document_type
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id
),
scored AS (SELECT *, round_even(probability * 100, 2) AS confidence FROM predictions)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.md5(F.concat(F.lit("p:"), F.col("doc_id").cast("string")))
    wrong = F.substring(digest, 1, 1).isin("0", "1", "2")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return (
        table(spark, sf_dir, "labels")
        .join(docs, "doc_id")
        .select(
            "doc_id",
            F.col("quality").alias("label"),
            F.when(wrong, 1 - F.col("quality")).otherwise(F.col("quality")).alias("prediction"),
            (F.lit(0.5) + hash_int(digest) / F.lit(8589934592.0)).alias("probability"),
            F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"),
            F.col("doc_id").cast("string").alias("file_name"),
            F.col("lang").alias("document_type"),
        )
    )


# --- two versions of the corpus ---------------------------------------------
# Stored: the labelled documents as they are. Current: every document that is
# not marked toxic, with runs of white space collapsed (which edits some).

ARCHIVE = "/archive"
# Rows of a number or two; about 70 bytes each where they are hashed.
LABELS_SENT = 2_000_000
DOC_PATH_SQL = "'/archive/' || d.source || '/' || d.doc_id || '.txt'"
COLLAPSED_SQL = r"trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))"
VERSIONS_SQL = f"""
stored AS (
  SELECT {DOC_PATH_SQL} AS path, d.doc_id, d.lang, d.source, d.text, l.quality
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id
),
current AS (
  SELECT {DOC_PATH_SQL} AS path, d.doc_id, d.lang, d.source, {COLLAPSED_SQL} AS text
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
  WHERE coalesce(l.toxic, 0) = 0
)"""


def document_path(prefix: str = ARCHIVE + "/", glue: str = "/"):
    return F.concat(F.lit(prefix), "source", F.lit(glue), F.col("doc_id").cast("string"), F.lit(".txt"))


def _sent(narrow: DataFrame) -> DataFrame:
    """Marked for broadcast unless it has too many rows: the texts it is joined to then stay where they are."""
    return F.broadcast(narrow) if narrow.count() <= LABELS_SENT else narrow


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _sent(table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return (
        spread(table(spark, sf_dir, "documents"), "doc_id")
        .join(labels, "doc_id")
        .select(document_path().alias("path"), "doc_id", "lang", "source", "text", "quality")
    )


def current_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths are written untidily on purpose; readers normalise them."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    collapsed = F.trim(F.regexp_replace("text", "[ \\t\\r\\n]+", " "))
    return (
        spread(table(spark, sf_dir, "documents"), "doc_id")
        .join(labels, "doc_id", "left")
        .filter(F.coalesce("toxic", F.lit(0)) == 0)
        .select(
            document_path(f"{ARCHIVE}/./old/..//", "/x/../").alias("path"),
            "doc_id",
            "lang",
            "source",
            collapsed.alias("text"),
        )
    )
