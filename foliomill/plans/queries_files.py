"""Queries over files, paths, versions and errors."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from foliomill.functions import paths as ph
from foliomill.functions.text import clean_replace
from foliomill.operators import compare as cp
from foliomill.plans import tables as tb
from foliomill.plans.registry import ORACLES, query
from foliomill.plans.update import new_rows
from foliomill.session import checkpoint_root, spread
from foliomill.sources import extract as ex
from foliomill.sources import files as fl
from foliomill.sources import sinks
from foliomill.sources import store as st
from foliomill.sources.snapshots import Snapshot

TARGET = "#top"


@query(
    f"""SELECT {tb.DOC_PATH_SQL} AS path, d.lang AS doc_type, l.quality, d.n_chars
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""
)
def scan_labelled(spark, sf_dir):
    docs = tb.table(spark, sf_dir, "documents").select(
        "doc_id", tb.document_path().alias("path"), F.col("lang").alias("doc_type"), "n_chars"
    )
    labels = tb.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select("path", "doc_type", "quality", "n_chars")


@query(f"SELECT page_id, url FROM pages WHERE ends_with(lower(url), '{TARGET}')")
def scan_target_files(spark, sf_dir):
    return fl.target_files(tb.table(spark, sf_dir, "pages").select("page_id", "url"), TARGET, "url")


@query(f"SELECT url AS non_top_files FROM pages WHERE NOT ends_with(lower(url), '{TARGET}')")
def non_target_files(spark, sf_dir):
    return fl.other_files(tb.table(spark, sf_dir, "pages").select("url"), TARGET, "url")


@query("SELECT page_id, url || '-' || length(html) || '-' || page_id AS signature FROM pages")
def file_signature(spark, sf_dir):
    pages = tb.table(spark, sf_dir, "pages")
    return pages.select("page_id", fl.signature(F.col("url"), F.length("html"), F.col("page_id")).alias("signature"))


@query(
    """WITH raw AS (
      SELECT page_id, '/root/./x/../' || url AS p FROM pages
      UNION ALL
      SELECT page_id, '../' || split_part(url, '://', 2) || '/../..//./' AS p FROM pages
    ),
    parts AS (
      SELECT page_id, p, starts_with(p, '/') AS rooted,
             list_filter(string_split(p, '/'), lambda x: x NOT IN ('', '.')) AS xs
      FROM raw
    ),
    folded AS (
      SELECT page_id, p, rooted, list_reduce(list_transform(xs, lambda x: [x]), lambda kept, x:
        CASE WHEN x[1] = '..' AND len(kept) > 0 AND kept[len(kept)] <> '..' THEN kept[:len(kept) - 1]
             WHEN x[1] = '..' AND rooted THEN kept ELSE kept || x END, []::VARCHAR[]) AS kept
      FROM parts
    )
    SELECT page_id, p AS raw_path,
           CASE WHEN NOT rooted AND len(kept) = 0 THEN '.'
                ELSE CASE WHEN rooted THEN '/' ELSE '' END || array_to_string(kept, '/') END AS path
    FROM folded"""
)
def normalize_path(spark, sf_dir):
    url = F.col("url")
    pages = tb.table(spark, sf_dir, "pages")
    rooted = pages.select("page_id", F.concat(F.lit("/root/./x/../"), url).alias("raw_path"))
    relative = pages.select(
        "page_id", F.concat(F.lit("../"), F.get(F.split(url, "://"), F.lit(1)), F.lit("/../..//./")).alias("raw_path")
    )
    return rooted.unionByName(relative).withColumn("path", ph.normalize(F.col("raw_path")))


@query(
    r"""WITH paths AS (
      SELECT '/data/' || rtrim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS p FROM pages
    ),
    parts AS (SELECT p, string_split(p, '/') AS xs FROM paths),
    named AS (
      SELECT p, xs, CASE WHEN len(xs) > 3 THEN array_to_string(xs[3:len(xs) - 1], '/') ELSE '.' END AS rel FROM parts
    )
    SELECT p AS file_path, xs[-1] AS file_name, coalesce(xs[5], '') AS main_folder, xs[-2] AS parent_folder,
           rel AS relative_folder, string_split(rel, '/')[1] AS component_name
    FROM named"""
)
def path_columns(spark, sf_dir):
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    paths = tb.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("/data/"), F.regexp_replace(bare, "/+$", "")).alias("p")
    )
    return paths.select(*ph.path_columns(F.col("p"), "/data"))


@query(
    """SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS "Timestamp", 'user/' || user_id AS "PDF File Path",
           CASE WHEN value >= 50 THEN 'N/A' ELSE CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) END AS "Page Number",
           'Error processing: ' || props AS "Error Message"
    FROM events WHERE event_type = 'error'"""
)
def error_log(spark, sf_dir):
    """Error events as failures; a page number from the value column, none from 50 up."""
    errors = tb.table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    return sinks.error_log(
        errors.select(
            "ts",
            F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"),
            F.when(F.col("value") < 50, F.floor("value").cast("int")).alias("page_no"),
            F.concat(F.lit("Error processing: "), "props").alias("message"),
        )
    )


def _json_value(path: str, content: bytes) -> list[str]:
    return [str(json.loads(content)["k"])]


def _extracted(spark, sf_dir):
    """Event properties as file contents; those of error events lost their last character."""
    props = F.col("props")
    cut = F.when(F.col("event_type") == "error", F.substr(props, F.lit(1), F.length(props) - 1)).otherwise(props)
    files = spread(tb.table(spark, sf_dir, "events"), "event_id").select(
        "event_id", F.concat(F.lit("event/"), F.col("event_id").cast("string")).alias("path"), F.encode(cut, "UTF-8").alias("content")
    )
    return ex.extract_documents(files, _json_value, min_chars=0)


_CUT_SQL = """
cut AS (
  SELECT event_id,
         CASE WHEN event_type = 'error' THEN substr(props, 1, length(props) - 1) ELSE props END AS props
  FROM events
),
parsed AS (
  SELECT event_id, json_valid(props) AS ok,
         CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') ELSE '' END AS raw_text
  FROM cut
)"""


@query(
    f"""WITH {_CUT_SQL}
    SELECT event_id, raw_text, NOT ok AS failed, CASE WHEN ok THEN length(raw_text) ELSE 0 END::DOUBLE AS size FROM parsed"""
)
def extract_with_defaults(spark, sf_dir):
    done = _extracted(spark, sf_dir)
    return done.select(
        "event_id", "raw_text", F.col("error").isNotNull().alias("failed"), F.col("features")[3].alias("size")
    )


@query(f"WITH {_CUT_SQL} SELECT event_id, raw_text FROM parsed WHERE ok")
def drop_failed(spark, sf_dir):
    return ex.succeeded(_extracted(spark, sf_dir)).select("event_id", "raw_text")


@query("SELECT conv_id, CAST(max(turn) + 1 AS BIGINT) AS next_version FROM conversations GROUP BY conv_id")
def next_version(spark, sf_dir):
    return st.next_version(tb.table(spark, sf_dir, "conversations").groupBy("conv_id"), "turn")


@query(f"WITH {tb.VERSIONS_SQL} SELECT path, doc_id FROM current WHERE path NOT IN (SELECT path FROM stored)")
def new_files_anti_join(spark, sf_dir):
    return cp.new_files(tb.current_documents(spark, sf_dir), tb.stored_documents(spark, sf_dir)).select("path", "doc_id")


def _signed(df):
    path = ph.normalize(F.col("path"))
    return df.select(path.alias("path"), fl.signature(path, F.length("text"), F.lit(0)).alias("signature"))


@query(
    f"""WITH {tb.VERSIONS_SQL}
    SELECT coalesce(s.path, c.path) AS path,
           CASE WHEN s.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed'
                WHEN length(s.text) = length(c.text) THEN 'same' ELSE 'changed' END AS state
    FROM stored s FULL JOIN current c ON s.path = c.path"""
)
def stale_files(spark, sf_dir):
    return cp.file_states(_signed(tb.stored_documents(spark, sf_dir)), _signed(tb.current_documents(spark, sf_dir)))


_ROWS_SQL = "SELECT lang, source, md5(text) AS text_md5 FROM"


@query(
    f"""WITH {tb.VERSIONS_SQL}, o AS ({_ROWS_SQL} stored), n AS ({_ROWS_SQL} current),
    differing AS (
      SELECT 'old' AS side, * FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n)
      UNION ALL
      SELECT 'new' AS side, * FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o)
    )
    SELECT side, lang, source, text_md5, count(*) AS surplus FROM differing GROUP BY ALL"""
)
def changed_rows(spark, sf_dir):
    def shown(df):
        return df.select("lang", "source", F.md5("text").alias("text_md5"))

    return cp.row_differences(shown(tb.stored_documents(spark, sf_dir)), shown(tb.current_documents(spark, sf_dir)))


@query(
    f"""WITH {tb.VERSIONS_SQL}
    SELECT path, lang, quality FROM stored UNION ALL BY NAME SELECT path, lang FROM current"""
)
def append_processed(spark, sf_dir):
    old = tb.stored_documents(spark, sf_dir).select("path", "lang", "quality")
    new = tb.current_documents(spark, sf_dir).select(ph.normalize(F.col("path")).alias("path"), "lang")
    return cp.append(old, new)


@query(
    f"""WITH {tb.VERSIONS_SQL}
    SELECT path, 1 AS version, md5({tb.CLEAN_REPLACE_SQL.format(text='text')}) AS processed_md5 FROM stored
    UNION ALL
    SELECT path, 2 AS version, md5({tb.CLEAN_REPLACE_SQL.format(text='text')}) AS processed_md5 FROM current
    WHERE path NOT IN (SELECT path FROM stored)"""
)
def incremental_update(spark, sf_dir):
    """Version 1 holds the stored documents; only unseen paths are cleaned and appended."""
    def shown(df, version):
        return df.select("path", F.lit(version).alias("version"), F.md5("processed_text").alias("processed_md5"))

    old = tb.stored_documents(spark, sf_dir).select("path", clean_replace(F.col("text")).alias("processed_text"))
    new = new_rows(old, tb.current_documents(spark, sf_dir).select("path", "text")).select(
        "path", clean_replace(F.col("text")).alias("processed_text")
    )
    return cp.append(shown(old, 1), shown(new, 2))


def _snapshots(old, new, *key):
    """Both tables as snapshots in the shared folder."""
    spark = old.sparkSession
    root = f"{checkpoint_root(spark).rstrip('/')}/snapshots-{uuid.uuid4().hex}"
    return tuple(Snapshot.write(rows, f"{root}/{name}", *key, buckets=64) for name, rows in (("old", old), ("new", new)))


@query(f"SELECT * FROM ({ORACLES['stale_files']}) WHERE state <> 'same'")
def snapshot_states(spark, sf_dir):
    """What differs between two versions, found by their digests; SQL compares all rows."""
    old, new = _snapshots(_signed(tb.stored_documents(spark, sf_dir)), _signed(tb.current_documents(spark, sf_dir)), "path")
    return old.states(new)


@query(ORACLES["changed_rows"])
def snapshot_differences(spark, sf_dir):
    def shown(df):
        return df.select("lang", "source", F.md5("text").alias("text_md5"))

    stored, current = shown(tb.stored_documents(spark, sf_dir)), shown(tb.current_documents(spark, sf_dir))
    old, new = _snapshots(stored, current, "text_md5")
    return old.differences(new).select("side", "lang", "source", "text_md5", "surplus")
