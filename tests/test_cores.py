"""The same model whatever the number of cores: two sessions of their own."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys, tempfile
from foliomill.operators.terms import TermLimits
from foliomill.plans import train
from foliomill.plans.model import ModelSettings
from foliomill.plans.queries_model import labelled_rows
from foliomill.session import build_session

cores, splits = sys.argv[1], int(sys.argv[2])
spark = build_session(master=f"local[{cores}]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-")})
spark.sparkContext.setLogLevel("ERROR")
settings = ModelSettings(limits=TermLimits(300, 3, 0.9), components=8, trees=20, depth=5)
rows, lemmas = labelled_rows(spark, "/root/testdata/sf0.001")
model = train.train(rows.repartition(splits), settings, lemmas).model
for r in sorted(model.score(rows).select("path", "document_type", "confidence").collect()):
    print("ROW", *r)
"""


def scores(cores, splits):
    env = os.environ | {"PYTHONPATH": ROOT}
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(cores), str(splits)], capture_output=True, text=True, env=env, timeout=900)
    rows = [line for line in run.stdout.splitlines() if line.startswith("ROW")]
    assert rows, run.stderr[-2000:]
    return rows


def test_scores_do_not_depend_on_cores_or_splits():
    assert scores(2, 3) == scores(4, 7)
