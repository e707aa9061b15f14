"""Time the headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from foliomill.plans import all_queries
from foliomill.session import build_session

HEADLINE = """
clean_text_replace tokenize_text remove_stopwords lemmatize_tokens term_counts vocabulary tfidf_transform
text_cache_lookup assemble_document_text layout_features extract_with_defaults new_files_anti_join stale_files
changed_rows stratified_split stratified_folds classification_report feature_quantiles robust_scale
knn_within_class oversample svd_project train_forest cross_validate classify_documents
""".split()

REPEAT_SECONDS = 240
LONG = {"svd_project", "train_forest", "cross_validate", "classify_documents"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # Start the Python workers and the code generator before timing.
    spark.range(1000).repartition(int(cpus)).mapInPandas(lambda batches: batches, "id bigint").count()
    seconds: dict[str, float] = {}
    began = time.perf_counter()
    for name in wanted:
        # One untimed run compiles the plan; then the median of three. Queries that fit models take
        # minutes and compile little in comparison, so they run once.
        times: list[float] = []
        for _ in range(1 if name in LONG else 4):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            if len(times) > 1 and start - began > REPEAT_SECONDS:
                break  # the whole run stays within a few minutes on a slow machine
        seconds[name] = round(statistics.median(times[1:] or times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
