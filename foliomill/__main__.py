"""Command line: ``python -m foliomill train|update|classify|compact``."""

from __future__ import annotations

import argparse
import importlib

from foliomill.operators.metrics import cv_summary
from foliomill.operators.review import DEFAULT_THRESHOLD, review_queue, review_summary
from foliomill.plans.classify import classify_tree
from foliomill.plans.model import ModelSettings
from foliomill.plans.process import derived_lemmas, load_or_process
from foliomill.plans.train import cross_validate, train
from foliomill.plans.update import model_path, update
from foliomill.session import build_session
from foliomill.sources.extract import Extractor, decode_utf8
from foliomill.sources.files import listed_types, read_labelled, scan_tree, target_files
from foliomill.sources.store import BUCKETS, ProcessedStore
from foliomill.sources.tree import list_tree, read_inventory


def imported(name: str) -> Extractor:
    """``module:function``."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="foliomill")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("train", "update"):
        one = commands.add_parser(name)
        one.add_argument("--labelled", required=True, help="CSV with columns 'File Path' and 'Document types'")
        one.add_argument("--root", required=True, help="folder of the files")
        one.add_argument("--suffix", default=".pdf")
        one.add_argument("--store", required=True, help="processed store")
        one.add_argument("--model", required=True, help="model base path; '_v<n>' is added")
        one.add_argument("--error-log")
        one.add_argument("--lemmas", help="Parquet folder with columns form and lemma; 'derive' makes one from the listed files")
        one.add_argument("--buckets", type=int, default=BUCKETS, help="of a new store, about one per gigabyte expected")
        one.add_argument("--inventory", help="Parquet listing of the files (path, modificationTime, length) instead of a scan")
        one.add_argument("--list-by-tasks", action="store_true", help="list the folder in the cluster, for very large trees")
        one.add_argument("--processing-version", default="1", help="raise it to process stored files again")
        one.add_argument("--profile", choices=("replace", "delete"), default="replace", help="how texts are cleaned")
        one.add_argument("--extractor", type=imported, default=decode_utf8, help="module:function for the file format")
    one = commands.add_parser("compact", help="merge small versions and the text cache of a store")
    one.add_argument("--store", required=True)
    one.add_argument("--profile", choices=("replace", "delete"), default="replace")
    one = commands.add_parser("classify")
    one.add_argument("--root", required=True)
    one.add_argument("--suffix", default=".pdf")
    one.add_argument("--model", required=True, help="path of one model version")
    one.add_argument("--out", help="result CSV folder")
    one.add_argument("--others", help="CSV folder for the files of other types")
    one.add_argument("--error-log")
    one.add_argument("--threshold", type=float, default=DEFAULT_THRESHOLD)
    one.add_argument("--extractor", type=imported, default=decode_utf8, help="module:function for the file format")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session()
    if args.command == "classify":
        done = classify_tree(
            spark, args.root, args.model, args.suffix, args.out, args.others, args.error_log, args.threshold,
            args.extractor,
        )
        done.results.orderBy("file_path").show(5, truncate=False)
        print(", ".join(f"{n} {what}" for what, n in done.counts.items()))
        review_summary(done.results).show()
        review_queue(done.results).show(truncate=False)
        return

    if args.command == "compact":
        store = ProcessedStore(spark, args.store)
        print("merged versions:", *store.compact())
        store.compact_text_cache(ModelSettings(profile=args.profile).processing())
        return

    listed = read_labelled(spark, args.labelled)
    if args.inventory:
        tree = read_inventory(spark, args.inventory)
    else:
        tree = (list_tree if args.list_by_tasks else scan_tree)(spark, args.root)
    files = target_files(tree, args.suffix)
    store = ProcessedStore(spark, args.store, args.buckets)
    settings = ModelSettings(profile=args.profile, version=args.processing_version)
    lemmas = None
    if args.lemmas == "derive":
        lemmas = derived_lemmas(listed, files, store, settings, args.extractor)
    elif args.lemmas:
        lemmas = spark.read.parquet(args.lemmas).select("form", "lemma")
    how = {"error_log": args.error_log, "extractor": args.extractor, "lemmas": lemmas}
    if args.command == "train":
        rows = load_or_process(listed, files, store, settings, **how)
        evaluation = train(rows, settings, lemmas, known=listed_types(listed))
        evaluation.model.save(model_path(args.model, store.next_version() - 1))
    else:
        done = update(listed, files, store, args.model, settings, **how)
        if done.evaluation is None:
            print("nothing new")
            return
        evaluation, rows = done.evaluation, done.rows
    print(f"accuracy: {evaluation.accuracy():.2%}")
    evaluation.report().show(truncate=False)
    evaluation.confusion_matrix().show()
    cv_summary(cross_validate(rows, settings, lemmas)).show()


if __name__ == "__main__":
    main()
