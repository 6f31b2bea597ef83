"""Every query with an oracle gives DuckDB's rows at the smallest scale; no plan holds Python, but for those of the similarity join."""

import os

import duckdb
import pytest

import __spark_entry__
from retrofit_spark.plans import catalogue

SF = "/root/testdata/sf0.001"
#: Queries whose tasks compare blocks of vectors.
IN_BATCHES = {"nearest_non_adopters", "similar_areas"}
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, con, tmp_path, name):
    df = catalogue.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoop"))
    assert name in IN_BATCHES or not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    df.write.parquet(str(tmp_path / "mine"))
    con.execute(f"CREATE OR REPLACE TEMP TABLE o AS {catalogue.ORACLES[name]}")
    con.execute(f"CREATE OR REPLACE TEMP TABLE m AS SELECT * FROM '{tmp_path}/mine/*.parquet'")
    columns = [sorted(r[:2] for r in con.execute(f"DESCRIBE {t}").fetchall()) for t in "om"]
    assert columns[0] == columns[1]
    names = ", ".join(f'"{c[0]}"' for c in columns[0])
    for a, b in ("om", "mo"):
        assert con.execute(f"SELECT {names} FROM {a} EXCEPT ALL SELECT {names} FROM {b} LIMIT 3").fetchall() == []


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
