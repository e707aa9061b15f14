import itertools
import posixpath

from pyspark.sql import functions as F

from foliomill.functions import paths as ph
from foliomill.sources.files import is_target, named_like, signature


def test_normalize_equals_posixpath(spark):
    pieces = ["", ".", "..", "a", "b.c", "..."]
    paths = ["/".join(p) for n in range(1, 5) for p in itertools.product(pieces, repeat=n)]
    paths += ["///x/..", "//x", "////", "a//b/../../..", "/../../a"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    wrong = [(r.p, r.n) for r in df.select("p", ph.normalize(F.col("p")).alias("n")).collect() if r.n != posixpath.normpath(r.p)]
    assert wrong == []


def test_path_columns(spark):
    rows = [("/srv/in/77.5/report.pdf",), ("/srv/in/top.pdf",), ("/srv/in/a/b/c.pdf",)]
    df = spark.createDataFrame(rows, "path string")
    out = df.select(*ph.path_columns(F.col("path"), "/srv/in")).collect()
    for untidy in ("/srv//in", "/srv/./in/", "//srv/in", "/srv/x/../in"):
        assert df.select(*ph.path_columns(F.col("path"), untidy)).collect() == out
    deep, top, nested = (r.asDict() for r in out)
    assert deep == {
        "file_name": "report.pdf",
        "file_path": "/srv/in/77.5/report.pdf",
        "main_folder": "report.pdf",
        "parent_folder": "77.5",
        "relative_folder": "77.5",
        "component_name": "77.5",
    }
    assert (top["relative_folder"], top["component_name"], top["main_folder"], top["parent_folder"]) == (".", ".", "", "in")
    assert (nested["relative_folder"], nested["component_name"], nested["main_folder"]) == ("a/b", "a", "b")


def test_locations_keep_scheme_and_host(spark):
    cases = {
        "hdfs://nn:8020//a/./b/../c": "hdfs://nn:8020/a/c",
        "s3a://bucket/a//b": "s3a://bucket/a/b",
        "file:/a/./b": "file:/a/b",
        "/a//b": "/a/b",
        "a:b/../c": "c",
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.n for r in df.select("p", ph.normalize_location(F.col("p")).alias("n")).collect()} == cases
    far = spark.createDataFrame([("hdfs://nn:8020/data/x/4711/m.pdf",)], "path string")
    for root in ("hdfs://nn:8020/data", "/data/"):
        row = far.select(*ph.path_columns(F.col("path"), root)).first()
        assert (row.relative_folder, row.component_name, row.main_folder) == ("x/4711", "x", "m.pdf")
    assert far.select(named_like(F.col("path"), "/data")).first()[0] == "/data/x/4711/m.pdf"
    assert far.select(named_like(F.col("path"), "hdfs://nn:8020/data")).first()[0] == "hdfs://nn:8020/data/x/4711/m.pdf"


def test_target_test_looks_at_the_whole_lower_cased_path(spark):
    df = spark.createDataFrame([("/a/X.PDF",), ("/a.pdf/x.txt",)], "p string")
    assert [r[0] for r in df.select(is_target(F.col("p"), ".pdf")).collect()] == [True, False]


def test_signature_is_null_when_a_part_is(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", None, 2)], "p string, s int, m int")
    assert [r[0] for r in df.select(signature(F.col("p"), F.col("s"), F.col("m"))).collect()] == ["a-1-2", None]
