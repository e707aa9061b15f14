"""Files in, scored documents out."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomill.operators import terms
from foliomill.operators.terms import TermLimits
from foliomill.plans import classify, process, queries_model, train, update
from foliomill.plans.model import DocumentModel, ModelSettings, prepare
from foliomill.sources import extract as ex
from foliomill.sources import files as fl
from foliomill.sources import sinks
from foliomill.sources.counts import TermCounts
from foliomill.sources.store import ProcessedStore
from foliomill.streaming.ingest import ingest, stream_tree
from foliomill.streaming.score import score_stream

SETTINGS = ModelSettings(limits=TermLimits(500, 2, 0.95), components=6, trees=10, depth=4)
WORDS = {
    "Manual": "install operate maintain lubricate inspect clean safety instruction",
    "Drawing": "scale sheet dimension tolerance projection section view revision",
    "Certificate": "certify inspector material grade heat tested approved stamp",
}


def write_files(root, kinds, start=0):
    """Text files of each kind below component folders; returns their labelled list."""
    rng = np.random.default_rng(start)
    listed = []
    for kind, count in kinds.items():
        for i in range(start, start + count):
            folder = os.path.join(root, f"unit-{i % 3}")
            os.makedirs(folder, exist_ok=True)
            path = os.path.join(folder, f"{kind}{i}.TXT")
            body = " ".join(rng.choice(WORDS[kind].split(), 30)) + f" page {i} shared words {i}-1"
            with open(path, "w") as f:
                f.write(body)
            listed.append((path, kind))
    return listed


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("files"))
    listed = write_files(root, {"Manual": 16, "Drawing": 10, "Certificate": 6})
    with open(os.path.join(root, "bad.txt"), "wb") as f:
        f.write(b"\xff\xfe\xff not text")
    with open(os.path.join(root, "notes.doc"), "w") as f:
        f.write("other")
    base = str(tmp_path_factory.mktemp("models"))
    store = ProcessedStore(spark, os.path.join(base, "store"))
    files = fl.target_files(fl.scan_tree(spark, root), ".txt")
    frame = spark.createDataFrame(listed, "path string, doc_type string")
    rows = process.load_or_process(frame, files, store, SETTINGS)
    evaluation = train.train(rows, SETTINGS)
    evaluation.model.save(update.model_path(f"{base}/m", 1))
    return {"root": root, "base": base, "store": store, "frame": frame, "rows": rows, "evaluation": evaluation, "n": len(listed)}


def test_labelled_list(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text('Note,Document types,File Path\nx,Manual,/a//b.pdf\n,Drawing,"/a/./c, ""d"".pdf"\n')
    listed = fl.read_labelled(spark, str(path))
    assert [tuple(r) for r in listed.collect()] == [("/a/b.pdf", "Manual"), ('/a/c, "d".pdf', "Drawing")]
    path.write_text("File Path,Document types\n" + "".join(f"/z{i:02},{t}\n" for i, t in enumerate("CABCA")))
    order = fl.listed_types(fl.read_labelled(spark, str(path)))
    assert order == ("C", "A", "B")
    docs = spark.createDataFrame([("/a", "B"), ("/b", "A"), ("/c", "new"), ("/d", "C"), ("/e", "B")], "path string, doc_type string")
    numbered, labels = train.number_labels(docs, order)
    assert labels == ("C", "A", "B", "new") and {r.doc_type: r.label for r in numbered.collect()} == {"C": 0, "A": 1, "B": 2, "new": 3}


def test_tree_scan_leaves_contents_alone_and_signs_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    file = tmp_path / "x" / "test.pdf"
    file.write_text("Test content")
    tree = fl.scan_tree(spark, str(tmp_path))
    plan = tree.select("path")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan
    one = fl.with_signature(tree).first()["signature"]
    assert str(file) in one
    file.write_text("Test content, modified content")
    os.utime(file, (2_000_000_000, 2_000_000_000))
    assert fl.with_signature(fl.scan_tree(spark, str(tmp_path))).first()["signature"] != one
    assert fl.with_signature(tree, use_content=True).first()["signature"].startswith(str(file))
    assert [r[0] for r in fl.other_files(tree, ".pdf").collect()] == []


def test_failed_files_keep_defaults_and_are_logged_twice(spark, tmp_path):
    def picky(path, content):
        yield "first page"
        if b"bad" in content:
            raise ValueError("Test error message")
        yield ("Hi", "recognised")

    files = spark.createDataFrame([("good.pdf", bytearray(b"ok")), ("test.pdf", bytearray(b"bad")), ("gone.pdf", None)], "path string, content binary")
    done = {r.path: r for r in ex.extract_documents(files, picky, min_chars=5).collect()}
    assert done["good.pdf"].raw_text == "first pageHi\nrecognised" and done["good.pdf"].features[3] == 10.0
    assert (done["test.pdf"].raw_text, done["test.pdf"].features, done["test.pdf"].error_page) == ("", [0.0] * 4, 2)
    assert done["gone.pdf"].raw_text == "" and done["gone.pdf"].error_page is None
    extracted = ex.extract_documents(files, picky)
    assert ex.succeeded(extracted).count() == 1
    log = str(tmp_path / "log")
    for _ in range(2):
        assert sinks.append_error_log(ex.failures(extracted), log)
    back = spark.read.option("header", True).csv(log)
    assert tuple(back.columns) == sinks.ERROR_LOG_HEADINGS
    assert sorted({(r[1], r[2]) for r in back.collect()}) == [("gone.pdf", "N/A"), ("test.pdf", "2")]
    assert back.count() == 4 and back.filter(F.col("Error Message").contains("Test error message")).count() == 2
    assert not sinks.append_error_log(ex.failures(extracted), "/proc/nowhere/log")


def test_store_shows_only_committed_versions(spark, tmp_path):
    store = ProcessedStore(spark, str(tmp_path))
    assert store.next_version() == 1 and store.read().count() == 0
    rows = spark.createDataFrame(
        [("a", "t", "s", "raw", "p", [0.0] * 4, "x")],
        "path string, doc_type string, signature string, raw_text string, processed_text string, features array<double>, processing string",
    )
    store.write(rows, 1)
    store.write(rows.withColumn("path", F.lit("b")), 2)
    rows.write.parquet(f"{tmp_path}/rows/version=3")  # a run that died before its commit
    assert store.next_version() == 3
    assert sorted(r.path for r in store.read().collect()) == ["a", "b"]
    assert [r.path for r in store.read(up_to=1).collect()] == ["a"]
    store.write(rows, 5)
    assert store.next_version() == 6
    assert store.latest().filter("path = 'a'").first()["version"] == 5


def test_unchanged_files_are_not_processed_again(spark, world, monkeypatch):
    files = fl.target_files(fl.scan_tree(spark, world["root"]), ".txt")
    before = world["store"].next_version()

    def never(*args, **kwargs):
        raise AssertionError("processed again")

    monkeypatch.setattr(process, "process", never)
    again = process.load_or_process(world["frame"], files, world["store"], SETTINGS)
    assert again.count() == world["n"] and world["store"].next_version() == before
    other = ModelSettings(profile="delete", limits=SETTINGS.limits)
    with pytest.raises(AssertionError):
        process.load_or_process(world["frame"], files, world["store"], other)


def test_training_learns_and_reports_names(world):
    evaluation = world["evaluation"]
    assert evaluation.accuracy() >= 0.8
    assert {r["class"] for r in evaluation.report().collect()} == set(WORDS) | {"macro avg", "weighted avg", "accuracy"}
    assert {r["label"] for r in evaluation.confusion_matrix().collect()} == set(WORDS)
    assert evaluation.unlabelled == 0
    assert world["rows"].count() == world["n"]
    assert world["rows"].filter("processed_text like '%partnum%'").count() == world["n"]


def test_model_survives_saving(spark, world):
    model = world["evaluation"].model
    back = DocumentModel.load(update.model_path(f"{world['base']}/m", 1))
    one, two = (
        sorted((r.path, r.document_type, r.confidence) for r in m.score(world["rows"]).collect()) for m in (model, back)
    )
    assert one == two and back.settings == SETTINGS
    with pytest.raises(FileNotFoundError):
        update.previous_model(f"{world['base']}/none", 5)
    assert update.previous_model(f"{world['base']}/m", 4) == update.model_path(f"{world['base']}/m", 1)


def test_fit_refuses_an_empty_vocabulary(spark):
    docs = spark.createDataFrame([("a", 0, "x y", [0.0] * 4)], "path string, label int, processed_text string, features array<double>")
    from foliomill.plans.model import fit_model

    with pytest.raises(ValueError, match="no term"):
        fit_model(docs, ["only"], SETTINGS)


def test_cross_validation_covers_every_row_once(world):
    scores = train.cross_validate(world["rows"], SETTINGS).collect()
    assert sorted(r.fold for r in scores) == [0, 1, 2, 3, 4] and sum(r.n for r in scores) == world["n"]


def test_classify_tree_writes_results(spark, world, tmp_path):
    done = classify.classify_tree(
        spark, world["root"], update.model_path(f"{world['base']}/m", 1), ".txt",
        str(tmp_path / "r"), str(tmp_path / "o"), str(tmp_path / "e"), 80,
    )
    rows = spark.read.option("header", True).csv(str(tmp_path / "r"))
    assert rows.columns == [
        "file_name", "file_path", "main_folder", "parent_folder", "relative_folder", "component_name",
        "document_type", "confidence", "needs_review",
    ]
    # The unreadable file is scored too, and logged.
    assert rows.count() == world["n"] + 1 and rows.filter("file_name = 'bad.txt'").count() == 1
    assert [r[0] for r in spark.read.option("header", True).csv(str(tmp_path / "o")).collect()] == [f"{world['root']}/notes.doc"]
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).count() == 1
    right = done.results.filter(F.col("file_name").startswith(F.col("document_type"))).count()
    assert right >= 0.8 * world["n"]
    plan = done.results._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    unflagged = classify.score_files(fl.scan_tree(spark, world["root"]), world["evaluation"].model, world["root"], None)
    assert "needs_review" not in unflagged.columns


def test_update_processes_only_new_files(spark, world, tmp_path):
    root = str(tmp_path / "files")
    old = write_files(root, {"Manual": 8, "Drawing": 8})
    store = ProcessedStore(spark, str(tmp_path / "store"))
    schema = "path string, doc_type string"
    tree = fl.scan_tree(spark, root)
    first = update.update(spark.createDataFrame(old, schema), tree, store, str(tmp_path / "m"), SETTINGS)
    assert first.version == 1 and first.rows.count() == 16 and first.evaluation is not None
    same = update.update(spark.createDataFrame(old, schema), tree, store, str(tmp_path / "m"), SETTINGS)
    assert same.evaluation is None and same.version == 1
    new = write_files(root, {"Certificate": 8}, start=100)
    mixed = [(p.replace("/unit", "/./unit"), t) for p, t in old + new]
    second = update.update(spark.createDataFrame(mixed, schema), fl.scan_tree(spark, root), store, str(tmp_path / "m"), SETTINGS)
    assert second.version == 2 and second.rows.count() == 24
    assert store.read().filter("version = 2").count() == 8
    assert set(DocumentModel.load(update.previous_model(str(tmp_path / "m"), 3)).labels) == set(WORDS)
    third = spark.createDataFrame(write_files(root, {"Drawing": 1}, start=200), schema)
    with pytest.raises(FileNotFoundError):
        update.update(third, fl.scan_tree(spark, root), store, str(tmp_path / "elsewhere"), SETTINGS)
    assert store.next_version() == 3


def test_a_run_that_died_before_its_model_is_made_good(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "files")
    listed = spark.createDataFrame(write_files(root, {"Manual": 8, "Drawing": 8}), "path string, doc_type string")
    store, base = ProcessedStore(spark, str(tmp_path / "store")), str(tmp_path / "m")

    def dies(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(update, "train", dies)
        with pytest.raises(RuntimeError):
            update.update(listed, fl.scan_tree(spark, root), store, base, SETTINGS)
    assert store.next_version() == 2 and not DocumentModel.exists(f"{base}_v1")
    again = update.update(listed, fl.scan_tree(spark, root), store, base, SETTINGS)
    assert again.version == 1 and again.evaluation is not None and DocumentModel.exists(f"{base}_v1")


def test_streamed_files_can_be_labelled_later(spark, tmp_path):
    root = str(tmp_path / "files")
    listed = spark.createDataFrame(write_files(root, {"Manual": 8, "Drawing": 8}), "path string, doc_type string")
    store = ProcessedStore(spark, str(tmp_path / "store"))
    ingest(stream_tree(spark, root, ".txt"), store, SETTINGS, str(tmp_path / "c")).awaitTermination()
    assert store.latest().filter("doc_type is not null").count() == 0
    unlabelled = store.latest().unionByName(store.latest().withColumn("doc_type", F.lit("Manual")).limit(12))
    rows, _ = train.training_rows(unlabelled)
    assert rows.count() == 12
    train.train(store.latest().withColumn("doc_type", F.when(F.col("path").contains("Manual"), "Manual").otherwise("Drawing")), SETTINGS).model.save(f"{tmp_path}/m_v1")
    done = update.update(listed, fl.scan_tree(spark, root), store, str(tmp_path / "m"), SETTINGS)
    assert done.version == 2 and done.rows.count() == 16 and done.evaluation.unlabelled == 0
    assert store.latest().filter("doc_type is null").count() == 0


def test_tag_follows_all_that_shapes_rows(spark):
    from foliomill.plans.model import processing_tag

    one = spark.createDataFrame([("pumps", "pump")], "form string, lemma string")
    two = spark.createDataFrame([("pumps", "pomp")], "form string, lemma string")
    tags = {
        processing_tag(SETTINGS, None, ex.decode_utf8, 100),
        processing_tag(SETTINGS, one, ex.decode_utf8, 100),
        processing_tag(SETTINGS, two, ex.decode_utf8, 100),
        processing_tag(SETTINGS, None, write_files, 100),
        processing_tag(SETTINGS, None, ex.decode_utf8, 101),
        processing_tag(ModelSettings(version="2"), None, ex.decode_utf8, 100),
    }
    assert len(tags) == 6


def test_a_tree_is_read_once(spark, world, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counting(path, content):
        seen.add(1)
        return ex.decode_utf8(path, content)

    done = classify.classify_tree(
        spark, world["root"], update.model_path(f"{world['base']}/m", 1), ".txt",
        str(tmp_path / "r"), str(tmp_path / "o"), str(tmp_path / "e"), 80, counting,
    )
    assert done.results.count() == world["n"] + 1 and seen.value == world["n"] + 1
    flagged = done.results.filter("needs_review").count()
    assert done.counts == {"documents": world["n"] + 1, "failed": 1, "flagged": flagged}


def test_scratch_tables_go_when_training_ends(spark, world):
    from urllib.parse import urlparse

    from foliomill.session import checkpoint_root

    folder = urlparse(checkpoint_root(spark)).path
    before = set(os.listdir(folder))
    train.train(world["rows"], SETTINGS)
    assert {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before} <= {"train-scored"}


def test_command_line_takes_an_extractor(spark, world, tmp_path, monkeypatch, capsys):
    from foliomill import __main__ as cli

    monkeypatch.setattr(cli, "build_session", lambda: spark)
    cli.main([
        "classify", "--root", world["root"], "--suffix", ".txt", "--model", update.model_path(f"{world['base']}/m", 1),
        "--out", str(tmp_path / "r"), "--extractor", "foliomill.sources.extract:decode_utf8",
    ])
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == world["n"] + 1


def test_list_with_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text('File Path,Note,Document types\n/a.pdf,"two\nlines",Manual\n')
    assert [tuple(r) for r in fl.read_labelled(spark, str(path)).collect()] == [("/a.pdf", "Manual")]


def test_streams_equal_batches(spark, world, tmp_path):
    root = str(tmp_path / "files")
    write_files(root, {"Manual": 3, "Drawing": 3})
    store = ProcessedStore(spark, str(tmp_path / "store"))

    def drain():
        ingest(stream_tree(spark, root, ".txt"), store, SETTINGS, str(tmp_path / "ci")).awaitTermination()
        return store.read().count()

    assert drain() == 6
    assert drain() == 6
    write_files(root, {"Certificate": 1}, start=50)
    assert drain() == 7 and store.next_version() == 3

    model = world["evaluation"].model
    out = str(tmp_path / "scored")
    score_stream(stream_tree(spark, root, ".txt"), model, root, out, str(tmp_path / "cs")).awaitTermination()
    batch = classify.score_files(fl.scan_tree(spark, root), model, root)
    streamed = spark.read.parquet(out).select(*batch.columns)
    assert sorted(tuple(r) for r in streamed.collect()) == sorted(tuple(r) for r in batch.collect())


def test_prepare_uses_lemmas(spark):
    docs = spark.createDataFrame([("a", "The pumps and boxes")], "path string, raw_text string")
    lemmas = spark.createDataFrame([("pumps", "pump")], "form string, lemma string")
    assert prepare(docs, SETTINGS, lemmas).first()["processed_text"] == "pump boxes"
    assert prepare(docs, SETTINGS, None).first()["processed_text"] == "pumps boxes"


def _vocabulary(df):
    return sorted((r.term, r.term_id, r.df, r.cf, round(r.idf, 12)) for r in df.collect())


def test_fold_vocabularies_are_totals_minus_the_fold(spark, world, monkeypatch):
    rows, _ = train.training_rows(world["rows"])
    folded = train.stratified_folds(rows, "label", "path", 5, 42).cache()
    counts = terms.fold_counts(terms.with_terms(folded, "processed_text"), "terms", "fold", 5)
    for fold in range(5):
        others = folded.filter(F.col("fold") != fold)
        want = terms.vocabulary(terms.with_terms(others, "processed_text"), "terms", SETTINGS.limits)
        got = terms.kept_terms(terms.without_fold(counts, fold), F.lit(float(others.count())), SETTINGS.limits)
        assert _vocabulary(got) == _vocabulary(want) != []
    folded.unpersist()
    passes = []
    scan = terms._occurrences
    monkeypatch.setattr(terms, "_occurrences", lambda *a: passes.append(a) or scan(*a))
    assert train.cross_validate(world["rows"], SETTINGS).count() == 5
    assert len(passes) == 1  # one pass over the terms for five models


def test_carried_counts_equal_a_recount(spark, tmp_path, monkeypatch):
    counts = TermCounts(spark, str(tmp_path))

    def table(rows):
        return spark.createDataFrame(rows, "path string, processed_text string")

    def recount(df):
        return terms.vocabulary(terms.with_terms(df, "processed_text"), "terms", terms.TermLimits(50, 1, 1.0))

    first = table([("a", "red green blue"), ("b", "red red"), ("c", None), ("d", "blue sky"), ("d", "blue sky")])
    second = table([("a", "red green violet"), ("b", "red red"), ("e", "new words here"), ("d", "blue sky"), ("b", "red red")])
    assert counts.advance(first, first) == 5
    assert _vocabulary(counts.vocabulary(terms.TermLimits(50, 1, 1.0))) == _vocabulary(recount(first))
    read = []
    scan = terms._occurrences
    monkeypatch.setattr(terms, "_occurrences", lambda docs, *a: read.append(docs.count()) or scan(docs, *a))
    # a changed, b once more, c and one d gone, e new: six documents, a row each
    assert counts.advance(second, first) == 6 and read == [6]
    monkeypatch.undo()
    assert _vocabulary(counts.vocabulary(terms.TermLimits(50, 1, 1.0))) == _vocabulary(recount(second))
    assert counts.documents() == 5 and counts.advance(second, first) == 0
    # a version that was never committed shows nowhere
    table([("x", "lost run")]).selectExpr("'lost' AS term", "9L AS df", "9L AS cf").write.parquet(f"{tmp_path}/deltas/version=9")
    assert counts.totals().filter("term = 'lost'").count() == 0
    # texts that nobody has any more: all are counted anew
    assert counts.advance(first, second.limit(0)) == 5
    assert _vocabulary(counts.vocabulary(terms.TermLimits(50, 1, 1.0))) == _vocabulary(recount(first))
    assert counts.documents() == 5
    empty = first.limit(0)
    assert counts.advance(empty, first) == 5 and counts.totals().count() == 0 == counts.documents()


def test_labelled_rows_are_extracted_once(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)

    def counting(path, content):
        calls.add(1)
        return [content.decode("utf-8")]

    monkeypatch.setattr(queries_model, "extract_documents", lambda docs: ex.extract_documents(docs, counting))
    rows, _ = queries_model.labelled_rows(spark, "/root/testdata/sf0.001")
    train.train(rows, SETTINGS)
    assert calls.value == rows.count() == 87


def shuffled_columns(frame):
    """Names of all columns that some exchange of the plan carries."""
    import re

    text = frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    found = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\n]*)\]", text)
    return {c.split("#")[0].strip() for line in found for c in line.split(",")}


STORED = "path string, doc_type string, signature string, raw_text string, processed_text string, features array<double>, processing string"


def stored_rows(spark, paths, text="raw"):
    return spark.createDataFrame([(p, "t", "s", text, "p", [0.0] * 4, "x") for p in paths], STORED)


def test_store_shuffles_no_text(spark, tmp_path):
    store = ProcessedStore(spark, str(tmp_path))
    store.write(stored_rows(spark, [f"/a/{i}" for i in range(200)]), 1)
    store.write(stored_rows(spark, [f"/a/{i}" for i in range(0, 200, 3)], "new"), 2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        latest = store.latest()
        assert not shuffled_columns(latest) & {"raw_text", "processed_text"}
        assert {(r.path, r.raw_text) for r in latest.collect()} == {(f"/a/{i}", "raw" if i % 3 else "new") for i in range(200)}
        assert not shuffled_columns(store.states())
        wanted = spark.createDataFrame([("/a/0", "u"), ("/a/1", "v"), ("/a/1", "w"), ("/none", "x")], "path string, doc_type string")
        found = store.stored(wanted)
        assert not shuffled_columns(found) & {"raw_text", "processed_text"}
        assert sorted((r.path, r.doc_type, r.raw_text) for r in found.collect()) == [("/a/0", "u", "new"), ("/a/1", "v", "raw"), ("/a/1", "w", "raw")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_compaction_keeps_every_version(spark, tmp_path, monkeypatch):
    store = ProcessedStore(spark, str(tmp_path), buckets=4)
    for version in (1, 2, 3):
        store.write(stored_rows(spark, [f"/a/{i}" for i in range(0, 60, version)], f"v{version}"), version)
    key = lambda rows: sorted((r.path, r.version, r.raw_text) for r in rows.collect())
    before, early, newest = key(store.read()), key(store.read(up_to=2)), key(store.latest())

    def dies(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", dies)
        with pytest.raises(RuntimeError):
            store.compact()
    assert store.folders() == [1, 2, 3] and key(store.read()) == before
    assert store.compact() == [1, 2, 3] and store.folders() == [-1]
    data = [f for f in os.listdir(tmp_path / "rows" / "version=-1") if f.endswith(".parquet")]
    assert len(data) == 4
    again = ProcessedStore(spark, str(tmp_path))
    for one in (store, again):
        assert key(one.read()) == before and key(one.read(up_to=2)) == early and key(one.latest()) == newest
    assert store.next_version() == 4 and os.path.exists(tmp_path / "rows" / "version=1")
    store.write(stored_rows(spark, ["/a/1"], "v4"), 4)
    assert store.compact() == [-1, 4] and not os.path.exists(tmp_path / "rows" / "version=1")
    assert key(store.read()) == sorted([*before, ("/a/1", 4, "v4")]) and store.compact() == []


def test_store_without_buckets_is_refused(spark, tmp_path):
    spark.range(1).selectExpr("1 AS version").write.parquet(str(tmp_path / "commits"))
    with pytest.raises(ValueError, match="without buckets"):
        ProcessedStore(spark, str(tmp_path)).read()


def test_text_cache_compaction(spark, tmp_path):
    store = ProcessedStore(spark, str(tmp_path))
    entries = spark.createDataFrame([("d1", "a"), ("d2", "b")], "text_md5 string, processed_text string")
    for _ in range(3):
        store.add_to_text_cache(entries, "x")
    store.add_to_text_cache(entries, "y")
    for _ in range(2):
        store.compact_text_cache("x")
        assert sorted(tuple(r) for r in store.text_cache("x").collect()) == [("d1", "a"), ("d2", "b")]
    store.add_to_text_cache(entries.withColumn("text_md5", F.lit("d3")).limit(1), "x")
    assert store.text_cache("x").count() == 3 and store.text_cache("y").count() == 2
    assert sorted(os.listdir(tmp_path / "text_cache" / "processing=x"))[-2:] == ["generation=1", "generation=2"]


def test_tree_listed_by_tasks_equals_the_scan(spark, world, tmp_path):
    from foliomill.sources import tree

    scanned = sorted(tuple(r) for r in fl.scan_tree(spark, world["root"]).drop("content").collect())
    for folders in (1, 3, 1000):
        assert sorted(tuple(r) for r in tree.list_tree(spark, world["root"], folders).collect()) == scanned
    tree.list_tree(spark, world["root"]).write.parquet(str(tmp_path / "inventory"))
    listing = tree.read_inventory(spark, str(tmp_path / "inventory"))
    contents = process.listed_files(world["frame"], listing)
    assert "content" not in shuffled_columns(contents)
    want = process.listed_files(world["frame"], fl.scan_tree(spark, world["root"]))
    key = lambda rows: sorted((r.path, r.signature, bytes(r.content)) for r in rows.collect())
    assert key(contents) == key(want)
    gone = listing.limit(1).withColumn("path", F.lit("/nowhere/at.all"))
    assert tree.with_content(gone).first()["content"] is None


def test_processing_leaves_no_tables_behind(spark, tmp_path):
    from urllib.parse import urlparse

    from foliomill.session import checkpoint_root, scratch, written

    root = str(tmp_path / "files")
    listed = spark.createDataFrame(write_files(root, {"Manual": 2}), "path string, doc_type string")
    folder = urlparse(checkpoint_root(spark)).path
    before = set(os.listdir(folder))
    rows = process.load_or_process(listed, fl.scan_tree(spark, root), ProcessedStore(spark, str(tmp_path / "s")), SETTINGS)
    assert rows.count() == 2 and set(os.listdir(folder)) == before
    with pytest.raises(RuntimeError), scratch():
        written(spark.range(3).toDF("n"), "lost")
        raise RuntimeError
    assert set(os.listdir(folder)) == before


def test_command_line_trains_from_an_inventory_with_derived_lemmas(spark, tmp_path, monkeypatch, capsys):
    from foliomill import __main__ as cli
    from foliomill.sources import tree

    monkeypatch.setattr(cli, "build_session", lambda: spark)
    monkeypatch.setattr(cli, "ModelSettings", lambda **how: ModelSettings(limits=SETTINGS.limits, components=6, trees=10, depth=4, **how))
    root = str(tmp_path / "files")
    listed = write_files(root, {"Manual": 10, "Drawing": 10})
    with open(listed[0][0], "a") as f:
        f.write(" pumps pump valves valve")
    (tmp_path / "l.csv").write_text("File Path,Document types\n" + "".join(f"{p},{t}\n" for p, t in listed))
    tree.list_tree(spark, root).write.parquet(str(tmp_path / "inventory"))
    places = ["--labelled", str(tmp_path / "l.csv"), "--root", root, "--store", str(tmp_path / "s"), "--model", str(tmp_path / "m")]
    cli.main(["train", *places, "--suffix", ".txt", "--inventory", str(tmp_path / "inventory"), "--lemmas", "derive", "--buckets", "3"])
    assert "accuracy" in capsys.readouterr().out and DocumentModel.exists(f"{tmp_path}/m_v1")
    store = ProcessedStore(spark, str(tmp_path / "s"))
    first = store.latest().filter(F.col("path") == listed[0][0]).first()["processed_text"]
    assert first.endswith("pump pump valve valve")
    write_files(root, {"Manual": 1}, start=70)
    cli.main(["compact", "--store", str(tmp_path / "s")])
    assert store.latest().count() == 20


def test_rows_and_vectors_go_before_the_forest_is_fitted(spark, world, monkeypatch):
    from urllib.parse import urlparse

    from foliomill.plans import model
    from foliomill.session import checkpoint_root

    folder = urlparse(checkpoint_root(spark)).path
    before, seen = set(os.listdir(folder)), []
    forest = model.RandomForestClassifier
    monkeypatch.setattr(model, "RandomForestClassifier", lambda **how: seen.append(set(os.listdir(folder)) - before) or forest(**how))
    train.train(world["rows"], SETTINGS)
    assert {n.rsplit("-", 1)[0] for n in seen[0]} == {"train-split", "fit-docs", "fit-balanced", "knn-points"}


def test_scoring_sends_no_raw_text_to_the_lemmas(spark):
    docs = spark.createDataFrame([("a", "The pumps and boxes")], "path string, raw_text string")
    lemmas = spark.createDataFrame([("pumps", "pump")], "form string, lemma string")
    ready = prepare(docs, SETTINGS, lemmas, keep_raw=False)
    assert ready.columns == ["path", "processed_text"] and ready.first()["processed_text"] == "pump boxes"
