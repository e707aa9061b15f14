"""From listed files to processed rows, reusing what the store already holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions.text import tokens
from foliomill.operators.lemmas import build_lemma_table, lemmatize
from foliomill.operators.pages import SPARSE_PAGE_CHARS
from foliomill.operators.textcache import new_entries, resolve_texts, with_processed
from foliomill.plans.model import LEMMA_SCHEMA, ModelSettings, clean_words, processing_tag
from foliomill.session import scratch, small_table, written
from foliomill.sources.extract import Extractor, decode_utf8, extract_documents, failures
from foliomill.sources.files import with_signature
from foliomill.sources.sinks import append_error_log
from foliomill.sources.store import STORE_SCHEMA, ProcessedStore, read_or_empty
from foliomill.sources.tree import with_content

SENT_PATHS = 100_000
ROW_COLUMNS = [c.split()[0] for c in STORE_SCHEMA.split(", ")]


def listed_files(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Listed paths with content and signature; nulls where there is no such file.

    Files without a ``content`` column (an inventory, a listing by tasks) are read after the join,
    where the row is, so no content is shuffled. With one, contents of unlisted files are kept out,
    and contents stay in place while the list has no more than ``SENT_PATHS`` rows.
    """
    signed = with_signature(files)
    if "content" in files.columns:
        found = signed.select("path", "signature", "content").join(small_table(listed, SENT_PATHS), "path")
    else:
        found = with_content(signed.select("path", "signature").join(listed, "path"))
    absent = listed.join(files.select("path").distinct(), "path", "left_anti")
    return found.unionByName(absent, allowMissingColumns=True)


def process(listed: DataFrame, files: DataFrame, store: ProcessedStore, settings: ModelSettings, **how) -> DataFrame:
    """Processed rows of the listed (path, doc_type)."""
    return process_contents(listed_files(listed, files), store, settings, **how)


def process_contents(
    contents: DataFrame,
    store: ProcessedStore,
    settings: ModelSettings,
    lemmas: DataFrame | None = None,
    extractor: Extractor = decode_utf8,
    min_chars: int = SPARSE_PAGE_CHARS,
    error_log: str | None = None,
) -> DataFrame:
    """Extract and clean (path, doc_type, signature, content); texts cleaned before come from the text cache.
    The result is read from tables made here: write it in a ``scratch`` block."""
    extracted = written(extract_documents(contents, extractor, min_chars), "extracted")
    if error_log:
        append_error_log(failures(extracted), error_log)

    resolved = written(
        resolve_texts(extracted, store.text_cache(settings.processing()), "raw_text", lambda t: clean_words(t, settings)),
        "resolved",
    )
    store.add_to_text_cache(new_entries(resolved), settings.processing())
    tag = processing_tag(settings, lemmas, extractor, min_chars)
    rows = with_processed(extracted, resolved, "raw_text").withColumn("processing", F.lit(tag))
    if lemmas is not None:
        rows = lemmatize(rows, "processed_text", lemmas)
    return rows.select(*ROW_COLUMNS)


def derived_lemmas(
    listed: DataFrame,
    files: DataFrame,
    store: ProcessedStore,
    settings: ModelSettings,
    extractor: Extractor = decode_utf8,
    min_chars: int = SPARSE_PAGE_CHARS,
) -> DataFrame:
    """Lemma table of the listed files' own words. It is made once and kept with the store, as stored
    rows depend on it; another profile or other stop words have a table of their own."""
    place = f"{store.root}/lemmas/{settings.processing()}"
    known = read_or_empty(store.spark, place, LEMMA_SCHEMA)
    if known.isEmpty():
        texts = extract_documents(listed_files(listed, files), extractor, min_chars)
        words = texts.select(tokens(clean_words(F.col("raw_text"), settings)).alias("words"))
        build_lemma_table(words, "words").select("form", "lemma").write.mode("overwrite").parquet(place)
    return store.spark.read.schema(LEMMA_SCHEMA).parquet(place)


def load_or_process(
    listed: DataFrame,
    files: DataFrame,
    store: ProcessedStore,
    settings: ModelSettings,
    **how,
) -> DataFrame:
    """Processed rows of every listed path.

    A stored row is reused when its path, file state and processing are
    unchanged; only the others are processed, and stored as a new version. What
    is decided is decided on paths and signatures; texts stay in their buckets.
    """
    tag = processing_tag(
        settings, how.get("lemmas"), how.get("extractor", decode_utf8), how.get("min_chars", SPARSE_PAGE_CHARS)
    )
    now = with_signature(files).select("path", "signature")
    current = listed.join(now, "path", "left")
    states = store.states().filter(F.col("processing") == tag)
    states = states.select("path", F.col("signature").alias("_stored"), F.lit(True).alias("_known"))
    same = F.coalesce("_known", F.lit(False)) & F.col("_stored").eqNullSafe(F.col("signature"))
    matched = current.join(states, "path", "left").withColumn("_same", same)
    todo = matched.filter(~F.col("_same")).select("path", "doc_type")
    reused = store.stored(matched.filter("_same").select("path", "doc_type", "signature")).select(*ROW_COLUMNS)
    if todo.isEmpty():
        return reused
    version = store.next_version()
    with scratch():
        store.write(process(todo, files, store, settings, **how), version)
    fresh = store.read().filter(F.col("version") == version).select(*ROW_COLUMNS)
    return reused.unionByName(fresh)
