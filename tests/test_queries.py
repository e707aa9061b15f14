"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()
QUERIES = contract.queries()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    want = rows_of([d[0] for d in result.description], result.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
    assert want[1]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_scores_every_document(spark):
    df = contract.entry(spark)
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert df.columns[-3:] == ["document_type", "confidence", "needs_review"]
