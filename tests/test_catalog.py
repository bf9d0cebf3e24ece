"""Every registered query against its SQL twin on the smallest sample."""

import importlib.util
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("check_oracle", ROOT / "tools" / "check_oracle.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)
entry_point = sys.modules["__spark_entry__"]

QUERIES = {name: query for name, query in entry_point.queries().items() if any(name in m.QUERIES for m in entry_point.MODULES)}
ORACLES = {name: text for name, text in entry_point.oracle_sql().items() if name in QUERIES}
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="sample tables are missing")


def test_twins_belong_to_queries():
    assert set(ORACLES) == set(QUERIES)


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for table in check.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_twin(spark, con, name):
    text, _, fine = check.compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert fine, text


@needs_data
def test_known_answers(spark):
    episodes = entry_point.entry(spark)
    assert episodes.count() == 1105
    assert episodes.where("LOS_7 = 1").count() == 779


@needs_data
def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["feat_drug"](spark, SF)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    read = [line for line in plan.splitlines() if line.startswith("ReadSchema") and "l_orderkey" in line]
    assert read == [
        "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_returnflag:string,l_shipdate:timestamp_ntz>"
    ]
    assert "EqualTo(l_returnflag,A)" in plan
    assert "CartesianProduct" not in plan
