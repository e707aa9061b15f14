"""Snapshots: what differs is found by digests, and only that is read."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliomill.operators.compare import file_states, row_differences
from foliomill.sources.snapshots import Snapshot

SCHEMA = "path string, signature string, n int"


def rows(changed=()):
    made = [(f"/a/{i}", f"s{i}", i) for i in range(400)] + [("/a/7", "s7", 7)] * 3 + [(None, "x", None), ("/b", None, 1)]
    return [r for r in made if r[2] not in changed] + [(f"/a/{i}", "new", i) for i in changed if i % 2]


def multiset(df):
    return Counter(tuple(r) for r in df.collect())


def test_only_differing_buckets_are_read(spark, tmp_path):
    old, new = (spark.createDataFrame(r, SCHEMA) for r in (rows(), rows((11, 12)) + [("/c", "s", 2)]))
    one = Snapshot.write(old, f"{tmp_path}/1", "path", buckets=64)
    two = Snapshot.write(new.repartition(5).sortWithinPartitions(F.desc("n")), f"{tmp_path}/2", "path", buckets=64)
    one, two = Snapshot(spark, f"{tmp_path}/1"), Snapshot(spark, f"{tmp_path}/2")
    buckets = one.differing(two)
    assert 1 <= len(buckets) <= 3
    plan = one.rows(buckets)._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]  # other folders are not opened
    want = file_states(old, new).filter("state <> 'same'")
    assert multiset(one.states(two)) == multiset(want) and want.count() == 3
    assert multiset(one.differences(two)) == multiset(row_differences(old, new))
    assert multiset(one.rows()) == multiset(old)


def test_repeats_nulls_and_order(spark, tmp_path):
    def at(name, made):
        return Snapshot.write(spark.createDataFrame(made, SCHEMA), f"{tmp_path}/{name}", "path", buckets=16)

    base = at("base", rows())
    assert base.differing(at("same", rows()[::-1])) == []
    fewer = at("fewer", rows()[:-4] + rows()[-2:])  # two copies less: an xor would not see it
    assert [(r.path, r.side, r.surplus) for r in base.differences(fewer).collect()] == [("/a/7", "old", 2)]
    here, there = at("here", [("/x", None, 1), ("/y", "a", None)]), at("there", [("/x", "a", 1), ("/y", None, None)])
    assert {(r.path, r.state) for r in here.states(there).collect()} == {("/x", "changed"), ("/y", "changed")}


def test_empty_tables_and_wrong_numbers(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(rows()[:5], SCHEMA)
    none = Snapshot.write(empty, f"{tmp_path}/none", "path", buckets=8)
    none, five = Snapshot(spark, none.folder), Snapshot.write(some, f"{tmp_path}/five", "path", buckets=8)
    assert none.rows().columns == some.columns and none.rows().count() == 0
    assert none.differing(Snapshot.write(empty, f"{tmp_path}/none2", "path", buckets=8)) == []
    assert none.states(five).filter("state = 'added'").count() == 5
    assert five.states(none).filter("state = 'removed'").count() == 5
    with pytest.raises(ValueError):
        five.differing(Snapshot.write(some, f"{tmp_path}/other", "path", buckets=9))
    with pytest.raises(ValueError):
        Snapshot.write(some.withColumn("_group", F.lit(1)), f"{tmp_path}/bad", "path")
    with pytest.raises(ValueError):
        Snapshot.write(some, f"{tmp_path}/bad", "path", buckets=0)
