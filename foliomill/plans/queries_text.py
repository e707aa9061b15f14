"""Queries over document text."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.functions import text as tx
from foliomill.functions import layout as ly
from foliomill.functions.numeric import rounded
from foliomill.operators import lemmas as lm
from foliomill.operators.pages import assemble_documents, page_text
from foliomill.operators.quantiles import RobustScale
from foliomill.operators import terms as tm
from foliomill.operators.textcache import resolve_texts
from foliomill.plans import tables as tb
from foliomill.plans.registry import query
from foliomill.session import written


def _clean_sql(expression: str) -> str:
    return f"SELECT doc_id, md5(c) AS text_md5, length(c) AS n_chars FROM (SELECT doc_id, {expression} AS c FROM documents)"


def _clean(spark, sf_dir, function):
    cleaned = tb.documents(spark, sf_dir).select("doc_id", function(F.col("text")).alias("c"))
    return cleaned.select("doc_id", F.md5("c").alias("text_md5"), F.length("c").cast("bigint").alias("n_chars"))


@query(_clean_sql(tb.CLEAN_REPLACE_SQL.format(text="text")))
def clean_text_replace(spark, sf_dir):
    return _clean(spark, sf_dir, tx.clean_replace)


@query(_clean_sql(tb.CLEAN_DELETE_SQL.format(text="text")))
def clean_text_delete(spark, sf_dir):
    return _clean(spark, sf_dir, tx.clean_delete)


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def text_hash(spark, sf_dir):
    return tb.table(spark, sf_dir, "documents").select("doc_id", tx.text_hash(F.col("text")).alias("text_md5"))


_TOKENS_OUT_SQL = "SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, md5(array_to_string(toks, ' ')) AS tokens_md5 FROM "


def _tokens_out(df, toks="toks"):
    return df.select(
        "doc_id", F.size(toks).cast("bigint").alias("n_tokens"), F.md5(tx.joined(F.col(toks))).alias("tokens_md5")
    )


@query(f"WITH {tb.TOKENIZED_SQL} {_TOKENS_OUT_SQL} tokenized")
def tokenize_text(spark, sf_dir):
    return _tokens_out(tb.tokenized(spark, sf_dir))


@query(
    f"""WITH {tb.TOKENIZED_SQL},
    kept AS (SELECT doc_id, list_filter(toks, lambda x: NOT list_contains({tb.STOPWORDS_SQL}, x)) AS toks FROM tokenized)
    {_TOKENS_OUT_SQL} kept"""
)
def remove_stopwords(spark, sf_dir):
    return _tokens_out(
        tb.tokenized(spark, sf_dir).withColumn("toks", tx.without_stopwords(F.col("toks")))
    )


_LEMMAS_SQL = f"""{tb.TOKENIZED_SQL},
words AS (SELECT DISTINCT unnest(toks) AS form FROM tokenized),
endings(ending, single) AS (VALUES {", ".join(f"('{e}', '{s}')" for e, s in lm.NOUN_ENDINGS)}),
guesses AS (
  SELECT form, substr(form, 1, length(form) - length(ending)) || single AS lemma
  FROM words JOIN endings ON ends_with(form, ending)
),
ranked AS (
  SELECT form, lemma, row_number() OVER (PARTITION BY form ORDER BY length(lemma), lemma) AS place
  FROM guesses WHERE lemma <> '' AND lemma IN (SELECT form FROM words)
),
lemmas AS (SELECT form, lemma FROM ranked WHERE place = 1)"""


@query(f"WITH {_LEMMAS_SQL} SELECT form, lemma FROM lemmas")
def build_lemma_table(spark, sf_dir):
    return lm.build_lemma_table(tb.tokenized(spark, sf_dir), "toks")


@query(
    f"""WITH {_LEMMAS_SQL},
    placed AS (SELECT doc_id, unnest(toks) AS form, generate_subscripts(toks, 1) AS pos FROM tokenized),
    swapped AS (
      SELECT doc_id, list(coalesce(lemma, p.form) ORDER BY pos) AS toks
      FROM placed p LEFT JOIN lemmas l ON l.form = p.form GROUP BY doc_id
    )
    SELECT t.doc_id, CAST(len(coalesce(s.toks, [])) AS BIGINT) AS n_tokens,
           md5(array_to_string(coalesce(s.toks, []), ' ')) AS tokens_md5
    FROM tokenized t LEFT JOIN swapped s ON s.doc_id = t.doc_id"""
)
def lemmatize_tokens(spark, sf_dir):
    docs = tb.tokenized(spark, sf_dir)
    swapped = lm.lemmatize(tb.cleaned(spark, sf_dir), "processed_text", lm.build_lemma_table(docs, "toks"))
    return _tokens_out(swapped.select("doc_id", tx.tokens(F.col("processed_text")).alias("toks")))


@query(
    f"""WITH {tb.TERMS_SQL}
    SELECT doc_id, CAST(len(t) AS BIGINT) AS n_unigrams, CAST(len(terms) - len(t) AS BIGINT) AS n_bigrams,
           md5(array_to_string(terms, '|')) AS terms_md5
    FROM term_lists"""
)
def ngrams(spark, sf_dir):
    toks = tb.tokenized(spark, sf_dir).select("doc_id", tx.long_tokens(F.col("toks")).alias("t"))
    both = toks.select("doc_id", "t", tx.bigrams(F.col("t")).alias("b"))
    return both.select(
        "doc_id",
        F.size("t").cast("bigint").alias("n_unigrams"),
        F.size("b").cast("bigint").alias("n_bigrams"),
        F.md5(F.array_join(F.concat("t", "b"), "|")).alias("terms_md5"),
    )


def _cleaned(spark, sf_dir):
    """Written, as counting reads the documents several times."""
    return written(tb.cleaned(spark, sf_dir), "cleaned")


def _vocabulary(docs):
    return tm.vocabulary(docs, "processed_text")


@query(
    f"""WITH {tb.TERMS_SQL}
    SELECT doc_id, term, tf FROM doc_terms WHERE NOT contains(term, ' ')"""
)
def term_counts(spark, sf_dir):
    toks = tb.tokenized(spark, sf_dir).select("doc_id", tx.long_tokens(F.col("toks")).alias("terms"))
    return tm.term_counts(toks, "doc_id", "terms")


@query(
    f"""WITH {tb.VOCABULARY_SQL}
    SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, df, cf FROM vocab"""
)
def vocabulary(spark, sf_dir):
    return _vocabulary(_cleaned(spark, sf_dir)).select(
        "term", F.col("term_id").cast("bigint").alias("term_id"), "df", "cf"
    )


@query(f"WITH {tb.VOCABULARY_SQL} SELECT term, round(idf, 6) AS idf FROM vocab")
def idf_weights(spark, sf_dir):
    return _vocabulary(_cleaned(spark, sf_dir)).select("term", rounded(F.col("idf")).alias("idf"))


_TFIDF_SQL = f"""{tb.VOCABULARY_SQL},
raw AS (
  SELECT doc_id, term, (1 + ln(tf::DOUBLE)) * idf AS w FROM doc_terms JOIN vocab USING (term)
),
weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


@query(f"WITH {_TFIDF_SQL} SELECT doc_id, term, round(weight, 6) AS weight FROM weights")
def tfidf_transform(spark, sf_dir):
    docs = _cleaned(spark, sf_dir)
    weights = tm.tfidf(docs, "doc_id", "processed_text", _vocabulary(docs))
    return weights.withColumn("weight", rounded(F.col("weight")))


@query(
    """WITH pages_of AS (
      SELECT a.conv_id, a.turn, a.text AS native, coalesce(b.text, '') AS fallback
      FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
    ),
    page_texts AS (
      SELECT conv_id, turn,
             CASE WHEN length(native) < 100 THEN native || chr(10) || fallback ELSE native END AS text
      FROM pages_of
    )
    SELECT conv_id, turn, length(text) AS n_chars, md5(text) AS text_md5 FROM page_texts"""
)
def page_text_fallback(spark, sf_dir):
    return _page_texts(spark, sf_dir).select(
        "conv_id", "turn", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5")
    )


def _page_texts(spark, sf_dir):
    """Turns as pages; the text of the next turn stands in for recognised text."""
    native = tb.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("native"))
    fallback = native.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("native").alias("fallback"))
    return native.join(fallback, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", page_text(F.col("native"), F.col("fallback")).alias("text")
    )


@query(
    """WITH pages_of AS (
      SELECT a.conv_id, a.turn, a.text AS native, coalesce(b.text, '') AS fallback
      FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
    ),
    joined AS (
      SELECT conv_id, string_agg(
        CASE WHEN length(native) < 100 THEN native || chr(10) || fallback ELSE native END, '' ORDER BY turn) AS text
      FROM pages_of GROUP BY conv_id
    )
    SELECT conv_id, length(text) AS n_chars, md5(text) AS text_md5 FROM joined"""
)
def assemble_document_text(spark, sf_dir):
    whole = assemble_documents(_page_texts(spark, sf_dir), "conv_id", "turn", "text")
    return whole.select("conv_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


@query(
    f"""WITH resolved AS (
      SELECT md5(d.text) AS text_md5, any_value(d.text) AS text FROM documents d
      WHERE d.doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1
    ),
    cache AS (
      SELECT DISTINCT md5(text) AS text_md5 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
    )
    SELECT r.text_md5, c.text_md5 IS NOT NULL AS hit,
           md5({tb.CLEAN_REPLACE_SQL.format(text='r.text')}) AS processed_md5
    FROM resolved r LEFT JOIN cache c ON c.text_md5 = r.text_md5"""
)
def text_cache_lookup(spark, sf_dir):
    """Labelled documents fill the cache; the others are looked up."""
    docs = tb.documents(spark, sf_dir)
    labelled = tb.table(spark, sf_dir, "labels").select("doc_id")
    cache = (
        docs.join(labelled, "doc_id", "left_semi")
        .groupBy(tx.text_hash(F.col("text")).alias("text_md5"))
        .agg(F.first("text").alias("text"))
        .select("text_md5", tx.clean_replace(F.col("text")).alias("processed_text"))
    )
    resolved = resolve_texts(docs.join(labelled, "doc_id", "left_anti"), cache, "text", tx.clean_replace)
    return resolved.select("text_md5", "hit", F.md5("processed_text").alias("processed_md5"))


_LAYOUT_SQL = r"""
layout AS (
  SELECT page_id, [len(regexp_extract_all(html, '<[^>]*>')) / length(html)::DOUBLE,
    len(regexp_extract_all(html, '(?i)<(?:p|div|h[1-6]|li|table|tr|section|article)[\s/>]'))::DOUBLE,
    length(regexp_replace(html, '<[^>]*>', '', 'g')) / length(html)::DOUBLE, length(html)::DOUBLE] AS f
  FROM pages
)"""


def _layout(spark, sf_dir):
    return tb.table(spark, sf_dir, "pages").select("page_id", ly.layout_features(F.col("html")).alias("f"))


@query(
    f"""WITH {_LAYOUT_SQL}
    SELECT page_id, round(f[1], 6) AS tag_density, f[2] AS block_count, round(f[3], 6) AS visible_ratio, f[4] AS size
    FROM layout"""
)
def layout_features(spark, sf_dir):
    f = F.col("f")
    return _layout(spark, sf_dir).select(
        "page_id",
        rounded(f[0]).alias("tag_density"),
        f[1].alias("block_count"),
        rounded(f[2]).alias("visible_ratio"),
        f[3].alias("size"),
    )


@query(
    f"""WITH {_LAYOUT_SQL}
    SELECT page_id, unnest(range(0, 4)) AS position, round(unnest(f), 6) AS value FROM layout"""
)
def features_to_vector(spark, sf_dir):
    """Through the ML vector type and back, one row per component."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vectors = _layout(spark, sf_dir).select("page_id", array_to_vector(ly.checked_width(F.col("f"))).alias("v"))
    return vectors.select("page_id", F.posexplode(vector_to_array("v")).alias("position", "value")).select(
        "page_id", F.col("position").cast("bigint").alias("position"), rounded(F.col("value")).alias("value")
    )


@query(
    f"""WITH {_LAYOUT_SQL},
    long AS (SELECT page_id, unnest(range(0, 4)) AS position, unnest(f) AS v FROM layout),
    q AS (
      SELECT position, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75
      FROM long GROUP BY position
    )
    SELECT page_id, position,
           round((v - q50) / CASE WHEN q75 - q25 = 0 THEN 1 ELSE q75 - q25 END, 6) + 0.0::DOUBLE AS value
    FROM long JOIN q USING (position)"""
)
def robust_scale(spark, sf_dir):
    layout = _layout(spark, sf_dir)
    scaled = RobustScale.fit(layout, "f").column(F.col("f"))
    return layout.select("page_id", F.posexplode(scaled).alias("position", "value")).select(
        "page_id", F.col("position").cast("bigint").alias("position"), rounded(F.col("value")).alias("value")
    )
