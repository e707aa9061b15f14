"""Joins, comparisons, labels, splits and metrics."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliomill.functions.layout import checked_width, layout_features
from foliomill.functions.numeric import confidence_pct
from foliomill.operators import compare as cp
from foliomill.operators import labels as lb
from foliomill.operators import metrics as mt
from foliomill.operators import pages as pg
from foliomill.operators import review as rv
from foliomill.operators import sampling as sm
from foliomill.operators import textcache as tc


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sparse_page_takes_the_fallback_strictly_below_the_limit(spark):
    df = spark.createDataFrame([(n, "é" * n, "ocr") for n in (0, 99, 100, 101)] + [(7, None, None)], "n int, t string, f string")
    got = {r.n: r.x for r in df.select("n", pg.page_text(F.col("t"), F.col("f")).alias("x")).collect()}
    assert got == {0: "\nocr", 99: "é" * 99 + "\nocr", 100: "é" * 100, 101: "é" * 101, 7: "\n"}


def test_pages_join_in_page_order(spark):
    df = spark.createDataFrame([("d", i, chr(97 + i)) for i in (3, 0, 2, 1)], "d string, n int, t string").repartition(4)
    assert rows(pg.assemble_documents(df, "d", "n", "t")) == [("d", "abcd")]


def test_layout_features(spark):
    df = spark.createDataFrame([("<p>ab</p>",), ("",), (None,), ("<pre>x</pre>",)], "h string")
    got = [r.f for r in df.select(layout_features(F.col("h")).alias("f")).collect()]
    assert got == [[2 / 9, 1.0, 2 / 9, 9.0], [0.0] * 4, [0.0] * 4, [2 / 12, 0.0, 1 / 12, 12.0]]
    with pytest.raises(Exception, match="expected 4 features"):
        spark.range(1).select(checked_width(F.array(F.lit(1.0)))).collect()


def test_new_files_keep_their_own_repeats(spark):
    new = spark.createDataFrame([("/a//b",), ("/a/c",), ("/a/./c",)], "path string")
    seen = spark.createDataFrame([("/a/x/../b",), ("/a/b",)], "path string")
    assert rows(cp.new_files(new, seen)) == [("/a/c",), ("/a/c",)]
    assert len(rows(cp.new_files(new, seen.limit(0)))) == 3


def test_file_states(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", None), ("e", "1")], "path string, signature string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "1"), ("f", "1")], "path string, signature string")
    states = cp.file_states(old, new)
    assert rows(states) == [("a", "same"), ("b", "changed"), ("c", "same"), ("d", "changed"), ("e", "removed"), ("f", "added")]
    assert cp.is_stale(states) and not cp.is_stale(cp.file_states(old, old))


def test_append_and_row_differences(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "i int, s string")
    b = spark.createDataFrame([(None, 1), ("x", 1)], "s string, i int")
    assert cp.append(a, b.drop("s")).count() == 5
    got = [tuple(r) for r in cp.row_differences(a, b).orderBy("i", "side").collect()]
    assert got == [(1, None, "new", 1), (1, "x", "old", 1), (2, None, "old", 1)]
    assert cp.same_rows(a, a) and not cp.same_rows(a, b)


def test_labels_number_by_first_appearance(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a"), (0, "c"), (9, None)], "i int, t string").repartition(3)
    mapping = lb.label_map(df, "t", "i")
    assert rows(mapping) == [("a", 2), ("b", 1), ("c", 0)]
    got = rows(lb.encode_labels(spark.createDataFrame([("a",), ("z",)], "t string"), mapping, "t"))
    assert got == [("a", 2), ("z", None)]


@pytest.mark.parametrize("sizes", [{"a": 700, "b": 299, "c": 1}, {"a": 3, "b": 2}, {"a": 11, "b": 11, "c": 11}])
def test_split_and_folds(spark, sizes):
    data = [(f"{k}{i}", k) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(data, "id string, k string")
    one, many = (sm.stratified_split(df.repartition(p), "k", "id") for p in (1, 7))
    assert rows(one) == rows(many)
    test = Counter(r.k for r in one.filter("is_test").collect())
    total = sum(sizes.values())
    assert sum(test.values()) == math.ceil(total * 0.2)
    assert all(abs(test[k] - n * 0.2) < 1 for k, n in sizes.items())
    folds = sm.stratified_folds(df.repartition(3), "k", "id")
    assert rows(folds) == rows(sm.stratified_folds(df, "k", "id"))
    for k, n in sizes.items():
        per_fold = Counter(r.fold for r in folds.filter(F.col("k") == k).collect())
        assert sum(per_fold.values()) == n and max(per_fold.values()) - min(per_fold[f] for f in range(5)) <= 1


def test_rows_without_a_label_are_kept_as_a_class(spark):
    data = [(f"{k}{i}", k) for k, n in {"a": 20, None: 10}.items() for i in range(n)]
    df = spark.createDataFrame(data, "id string, k string")
    split = sm.stratified_split(df, "k", "id")
    assert split.count() == 30 and split.filter("k is null and is_test").count() == 2
    folds = sm.stratified_folds(df, "k", "id")
    assert folds.count() == 30 and set(folds.groupBy("fold").count().select("count").toPandas()["count"]) == {6}


def test_report_against_hand_counts(spark):
    df = spark.createDataFrame([(0, 0)] * 3 + [(0, 1)] + [(1, 0)] * 2 + [(2, 2)] * 4, "label int, prediction int")
    assert rows(mt.confusion_matrix(df)) == [(0, 0, 3), (0, 1, 1), (0, 2, 0), (1, 0, 2), (1, 1, 0), (1, 2, 0), (2, 0, 0), (2, 1, 0), (2, 2, 4)]
    report = {r["class"]: r for r in mt.classification_report(df).collect()}
    assert (report["0"].precision, report["0"].recall) == (3 / 5, 3 / 4)
    assert (report["1"].precision, report["1"].recall, report["1"].f1, report["1"].support) == (0, 0, 0, 2)
    assert report["macro avg"].recall == pytest.approx((0.75 + 0 + 1) / 3)
    assert report["weighted avg"].recall == pytest.approx((0.75 * 4 + 4) / 10)
    assert mt.accuracy(df).first().accuracy == 0.7


def test_cv_summary_uses_population_deviation(spark):
    scores = [0.5, 0.75, 0.8, 0.95]
    row = mt.cv_summary(spark.createDataFrame([(s,) for s in scores], "accuracy double")).first()
    mean = sum(scores) / 4
    assert row.mean_accuracy == pytest.approx(mean)
    assert row.std_accuracy == pytest.approx(math.sqrt(sum((s - mean) ** 2 for s in scores) / 4))


def test_review(spark):
    df = spark.createDataFrame([("a", 0.79994, "x"), ("b", 0.79996, "x"), ("c", 0.00125, "y")], "file_path string, p double, document_type string")
    scored = df.withColumn("confidence", confidence_pct(F.col("p"))).withColumn("file_name", F.col("file_path"))
    flagged = rv.flag_for_review(scored, 80)
    assert [(r.confidence, r.needs_review) for r in flagged.orderBy("file_path").collect()] == [(79.99, True), (80.0, False), (0.12, True)]
    assert "needs_review" not in rv.flag_for_review(scored, None).columns
    assert [r.file_name for r in rv.review_queue(flagged, 1).collect()] == ["c"]
    assert tuple(rv.review_summary(flagged).first()) == (2, 3, 66.7)


def test_text_cache_hits_and_misses(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "id int, t string")
    cache = spark.createDataFrame([("9dd4e461268c8034f5c8564e155c67a6", "stored")] * 2 + [("0", "unused")], "text_md5 string, processed_text string")
    resolved = tc.resolve_texts(docs, cache, "t", lambda t: F.concat(t, F.lit("!")))
    got = {r.id: (r.processed_text, r.hit) for r in tc.with_processed(docs, resolved, "t").collect()}
    assert got == {1: ("stored", True), 2: ("stored", True), 3: ("y!", False), 4: ("!", False)}
    assert tc.new_entries(resolved).count() == 2
