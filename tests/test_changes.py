"""New and changed files from listings, with state by path."""

import glob
import os

import pytest

from foliomill.plans.model import ModelSettings
from foliomill.sources.store import ProcessedStore
from foliomill.sources.tree import list_tree
from foliomill.streaming.changes import ingest_changes, stream_inventory

SETTINGS = ModelSettings()


def take_back(state):
    """Undo the last batch's commit, as if the stream had died just before it."""
    last = max(int(os.path.basename(p)) for p in glob.glob(f"{state}/commits/[0-9]*"))
    for name in (f"{last}", f".{last}.crc"):
        os.rename(f"{state}/commits/{name}", f"{state}/taken-back{name}")


@pytest.fixture
def shop(spark, tmp_path):
    root, inbox = str(tmp_path / "files"), str(tmp_path / "inbox")
    os.makedirs(f"{root}/a")
    store = ProcessedStore(spark, str(tmp_path / "store"), buckets=2)

    def put(name, text, at):
        with open(f"{root}/{name}", "w") as f:
            f.write(text)
        os.utime(f"{root}/{name}", (at, at))

    def post(rows=None):
        listing = list_tree(spark, root) if rows is None else rows
        listing.coalesce(1).write.mode("append").parquet(inbox)
        return listing

    def run(**how):
        query = ingest_changes(stream_inventory(spark, inbox), store, SETTINGS, str(tmp_path / "state"), **how)
        query.awaitTermination()

    def texts():
        return {r.path.rsplit("/", 1)[1]: r.raw_text.strip() for r in store.latest().collect()}

    return put, post, run, texts, store, tmp_path


def test_new_and_changed_files_are_taken_once(spark, shop):
    put, post, run, texts, store, tmp_path = shop
    put("one.txt", "valve pump", 1_000)
    put("a/two.txt", "gasket", 1_000)
    first = spark.createDataFrame(post().collect(), "path string, modificationTime timestamp, length bigint")
    post(spark.createDataFrame([(None, None, 3), ("/nowhere.txt", None, 1)], first.schema))  # listings that tell nothing
    run()
    assert texts() == {"one.txt": "valve pump", "two.txt": "gasket"} and store.folders() == [1]

    put("one.txt", "valve bolt", 2_000)
    put("three.txt", "flange", 2_000)
    post()
    run()
    assert texts() == {"one.txt": "valve bolt", "two.txt": "gasket", "three.txt": "flange"}
    assert store.folders() == [1, 2]
    assert sorted(r.path.rsplit("/", 1)[1] for r in store.read().filter("version = 2").collect()) == ["one.txt", "three.txt"]

    # The same listing again, an older one that comes late, and a batch that is run again: nothing new.
    post()
    post(first)
    run()
    assert store.folders() == [1, 2]
    take_back(f"{tmp_path}/state")
    run()
    assert store.folders() == [1, 2]


def test_a_batch_stored_before_the_stream_died_is_not_stored_again(spark, shop):
    put, post, run, texts, store, tmp_path = shop
    put("one.txt", "valve", 1_000)
    post()
    run()
    take_back(f"{tmp_path}/state")
    put("two.txt", "pump", 1_000)
    post()
    run()
    assert store.folders() == [1, 2] and texts() == {"one.txt": "valve", "two.txt": "pump"}
    assert store.read().count() == 2


def test_a_new_checkpoint_knows_what_the_store_holds(spark, shop):
    put, post, run, texts, store, tmp_path = shop
    put("one.txt", "valve", 1_000)
    post()
    run(keep_days=30)
    os.rename(f"{tmp_path}/state", f"{tmp_path}/lost-state")
    put("two.txt", "pump", 1_000)
    post()
    run(keep_days=30)
    assert store.folders() == [1, 2] and store.read().count() == 2
