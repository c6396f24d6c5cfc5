"""Every query with SQL against DuckDB on the same tables."""

import os
from collections import Counter

import duckdb
import pytest

from corvina import contract_queries as queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    want = db.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_reachable_at_any_distance(spark, tmp_path):
    chain = [(k, k - 1, 50.0) for k in range(499, 469, -1)] + [(499, 300, 1.0), (400, 399, 50.0)]
    rows = spark.createDataFrame(chain, "l_partkey long, l_suppkey long, l_quantity double")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(r["node"] for r in queries.QUERIES["reachable"](spark, str(tmp_path)).collect()) == list(range(469, 500))
