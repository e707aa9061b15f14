"""Quality rules judged by host.

Every document is measured by four rules. Failures are added up by host, and each
host's failure rate is shrunk towards that of all hosts with a beta prior fitted
to the hosts themselves (method of moments), so a host with a few documents isn't
judged by them alone. A host whose shrunk rate is over ``host_limit`` is rejected
with all its documents; elsewhere a document falls by the strict rules only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import slices, words_of
from foliomill.session import written

#: Characters that count as symbols, and white space between words.
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"

MIN_WORDS = 50
HOST_LIMIT = 0.5

FEATURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the list."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    pairs = ids[:-1] * len(numbers) + ids[1:]
    if len(numbers) >= 1 << 20:  # the third factor would leave 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(numbers) + ids[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * 6
    words = words_of(text)
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def features(docs: DataFrame, host: str) -> DataFrame:
    """Per document doc_id, host and the counts of FEATURES; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                counts = np.array([measure(t) for t in rows["text"].to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], rows["host"], *(pa.array(c) for c in counts.T)],
                    ["doc_id", "host", *(c.split()[0] for c in FEATURES.split(", "))],
                )

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text")
    return columns.mapInArrow(run, f"doc_id long, host string, {FEATURES}")


def host_verdicts(judged: DataFrame, host_limit: float) -> DataFrame:
    """One row per host: its documents, failures, shrunk rate and verdict.

    The prior comes from four sums over hosts: with overall rate m, what the
    hosts' rates vary beyond chance gives the prior's weight m(1-m)/variance - 1,
    held between 1 and 10000.
    """
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("f"))
    total = hosts.agg(
        F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum(F.col("f") * F.col("f") / F.col("n")).alias("s"), F.count("*").alias("h")
    ).first()
    mean, weight = 0.0, 1.0
    if total.n:
        mean = total.f / total.n
        spread = total.s / total.n - mean * mean - mean * (1 - mean) * total.h / total.n
        weight = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e4) if spread > 1e-9 else 1e4
    rate = (F.col("f") + mean * weight) / (F.col("n") + weight)
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", rate > host_limit)


def judge(docs: DataFrame, host: str = "source", min_words: int = MIN_WORDS, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Per document its counts, ``base_failed``, ``host_rejected`` and ``kept``.

    Strict rules: under ``min_words`` words, over half of the words in repeated
    windows (these two are the base), over a tenth of the characters symbols. Over
    0.3 of the lines repeated counts as a failure of the host only. Null and empty
    texts have no words and fail; a null host is a host like any other; repeated
    rows count each. Hosts are joined by a shuffle that can split a large host.
    """
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    symbols = 10 * F.col("n_symbols") > F.col("word_chars")
    lines = 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")
    measured = written(features(docs, host), "quality-features")
    judged = measured.withColumns({"base_failed": base, "symbols_failed": symbols, "failed": base | symbols | lines})
    hosts = host_verdicts(judged, host_limit).select(F.col("host").alias("of"), "host_rate", "host_rejected")
    kept = ~(F.col("base_failed") | F.col("symbols_failed") | F.col("host_rejected"))
    return judged.join(hosts, F.col("host").eqNullSafe(F.col("of")), "left").drop("of").withColumn("kept", kept)


def keep_documents(
    docs: DataFrame, host: str = "source", min_words: int = MIN_WORDS, host_limit: float = HOST_LIMIT
) -> DataFrame:
    """The rows of ``docs`` that pass the rules, with all their columns and under any names.

    A rejected host's verdict tightens the rules for its documents instead of dropping those that pass
    every rule: they fall by repeated lines too, which elsewhere count against the host only. Rejected
    hosts are a table of their own that documents are held against; the rules are applied again where
    the row is, so no text is shuffled unless many hosts fall.
    """
    verdict = judge(docs, host, min_words, host_limit)
    bad = written(verdict.filter("host_rejected").select("host").distinct(), "quality-hosts")
    name = "_" + max(docs.columns, key=len)  # none of the documents' own
    if bad.limit(1).count():
        rejected = bad.select(F.col("host").alias(name), F.lit(True).alias(name + "_"))
        left = docs.join(rejected, F.col(host).cast("string").eqNullSafe(F.col(name)), "left").drop(name)
        left = left.withColumn(name + "_", F.coalesce(F.col(name + "_"), F.lit(False)))
    else:
        left = docs.withColumn(name + "_", F.lit(False))
    at, names = docs.columns.index("text"), docs.columns

    def passes(text: str | None, strict: bool) -> bool:
        words, chars, symbols, lines, twice, again = measure(text)
        failed = words < min_words or 100 * again > 50 * words or 10 * symbols > chars
        return not (failed or (strict and 10 * twice > 3 * lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = batch.slice(start, 500)
                pairs = zip(rows.column(at).to_pylist(), rows.column(len(names)).to_pylist(), strict=True)
                yield rows.filter(pa.array([passes(*p) for p in pairs], pa.bool_())).select(names)

    return left.mapInArrow(run, docs.schema)


SQL = r"""
WITH texts AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    row_number() OVER () AS r
  FROM documents
), starts AS (
  SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM texts
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM starts
), covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE c > 1) GROUP BY r
), measured AS (
  SELECT doc_id, host, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(lines) AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM texts LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    10 * n_symbols > word_chars AS symbols_failed
  FROM measured
), hosts AS (
  SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed OR symbols_failed OR 10 * n_dup_lines > 3 * n_lines) AS f
  FROM judged GROUP BY host
), totals AS (
  SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) - m * m - m * (1 - m) * count(*) / sum(n) AS v FROM hosts
), prior AS (
  SELECT m, CASE WHEN v > 1e-9 THEN least(greatest(m * (1 - m) / v - 1, 1.0), 1e4) ELSE 1e4 END AS k FROM totals
), verdicts AS (
  SELECT host, (f + m * k) / (n + k) > 0.5 AS host_rejected FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected,
  NOT (base_failed OR symbols_failed OR host_rejected) AS kept
FROM judged JOIN verdicts ON judged.host IS NOT DISTINCT FROM verdicts.host
"""
