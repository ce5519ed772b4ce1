import importlib.util
import os

import duckdb
import pytest

from conftest import ROOT, TESTDATA
from inkfold.workload.catalog import QUERIES

spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
spark_entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(spark_entry)


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        view = name.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {view} AS SELECT * FROM '{sf_dir}/{name}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) <= set(spark_entry.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, duck, sf_dir, name):
    frame = spark_entry.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    relation = duck.sql(spark_entry.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    listed = ", ".join(f'"{column}"' for column in columns)
    expected = duck.sql(f"SELECT {listed} FROM ({spark_entry.oracle_sql()[name]})").fetchall()
    got = [tuple(row) for row in frame.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert got


def test_entry(spark):
    if TESTDATA != "/root/testdata/sf0.001":
        pytest.skip("the entry query reads its own folder")
    frame = spark_entry.entry(spark)
    assert "is_filled" in frame.columns and frame.count() > 0
