"""Term counts that are carried from version to version instead of being taken anew.

A version holds the difference to the one before: counts of the documents that came in
minus counts of those that went. Totals are sums over versions, so an update reads the
texts of documents that differ and no others. Which documents are counted is kept as
(path, digest of the text, how often), by version as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.functions.text import text_hash
from foliomill.operators.terms import TermLimits, corpus_counts, kept_terms, weighted_counts, with_terms
from foliomill.session import discard, written
from foliomill.sources.store import read_or_empty

DELTA_SCHEMA = "term string, df bigint, cf bigint"
MEMBER_SCHEMA = "path string, digest string, n bigint"
COMMIT_SCHEMA = "version int, documents bigint, counted bigint"


def keyed(docs: DataFrame) -> DataFrame:
    """(path, digest, processed_text)."""
    text = F.coalesce("processed_text", F.lit(""))
    return docs.select("path", text_hash(text).alias("digest"), text.alias("processed_text"))


class TermCounts:
    """A folder of versions; one counts once it is in the commit table, so a run that dies half-way
    changes nothing, and its rerun overwrites what it left."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def commits(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.root}/commits", COMMIT_SCHEMA)

    def _committed(self, name: str, schema: str) -> DataFrame:
        rows = read_or_empty(self.spark, f"{self.root}/{name}", schema + ", version int")
        return rows.join(self.commits().select("version"), "version", "left_semi").drop("version")

    def members(self) -> DataFrame:
        """(path, digest, n) of the counted documents."""
        signed = self._committed("members", MEMBER_SCHEMA)
        return signed.groupBy("path", "digest").agg(F.sum("n").alias("n")).filter("n > 0")

    def totals(self) -> DataFrame:
        """(term, df, cf) over the counted documents."""
        deltas = self._committed("deltas", DELTA_SCHEMA)
        return deltas.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df > 0")

    def documents(self) -> int:
        return self.commits().agg(F.coalesce(F.sum("documents"), F.lit(0))).first()[0]

    def vocabulary(self, limits: TermLimits = TermLimits()) -> DataFrame:
        """The same terms and numbers as the vocabulary of the counted documents themselves."""
        return kept_terms(self.totals(), F.lit(float(self.documents())), limits)

    def advance(self, docs: DataFrame, archive: DataFrame) -> int:
        """Make ``docs`` (path, processed_text) the counted documents; returns how many were read for it.

        What came in is read from ``docs``, what went from ``archive``, any table with the texts
        of earlier versions. A document that is in neither any more means that all are counted anew.
        Repeats count each; a null text has no terms.
        """
        now = keyed(docs)
        counts = now.groupBy("path", "digest").agg(F.count("*").alias("n"))
        before = self.members()
        # Signed numbers of documents that differ: paths and digests only.
        changed = before.select("path", "digest", (-F.col("n")).alias("n")).unionByName(counts)
        changed = written(changed.groupBy("path", "digest").agg(F.sum("n").alias("n")).filter("n <> 0"), "counts-changed")
        sums = changed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.abs("n")), F.lit(0))).first()
        if not sums[0]:
            discard(changed)
            return 0
        gone, come = changed.filter("n < 0"), changed.filter("n > 0")
        old = keyed(archive).join(gone, ["path", "digest"]).dropDuplicates(["path", "digest"])
        new = now.join(come, ["path", "digest"]).dropDuplicates(["path", "digest"])
        differing = written(old.unionByName(new), "counts-differing")
        if differing.count() < sums[0]:
            discard(changed, differing)
            return self._anew(now, counts)
        signed = self._signed(differing)
        read = self._commit(signed, changed, sums[1], sums[2])
        discard(changed, differing)
        return read

    def _signed(self, rows: DataFrame) -> DataFrame:
        """Counts of rows (processed_text, n), each taken n times."""
        return weighted_counts(with_terms(rows.select("processed_text", "n"), "processed_text"), "terms", "n")

    def _anew(self, now: DataFrame, counts: DataFrame) -> int:
        """Replace all versions by one: the difference takes everything back that was there."""
        back = self.totals().select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf"))
        fresh = corpus_counts(with_terms(now, "processed_text"), "terms")
        signed = fresh.unionByName(back).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        members = self.members().select("path", "digest", (-F.col("n")).alias("n")).unionByName(counts)
        members = members.groupBy("path", "digest").agg(F.sum("n").alias("n"))
        total = now.count()
        return self._commit(signed, members, total - self.documents(), total)

    def _commit(self, deltas: DataFrame, members: DataFrame, documents: int, counted: int) -> int:
        version = self.commits().agg(F.coalesce(F.max("version"), F.lit(0)) + 1).first()[0]
        deltas.filter("df <> 0 OR cf <> 0").write.mode("overwrite").parquet(f"{self.root}/deltas/version={version}")
        members.filter("n <> 0").write.mode("overwrite").parquet(f"{self.root}/members/version={version}")
        row = self.spark.range(1).select(F.lit(version).alias("version"), F.lit(documents).cast("long").alias("documents"), F.lit(counted).cast("long").alias("counted"))
        row.write.mode("append").parquet(f"{self.root}/commits")
        return counted
