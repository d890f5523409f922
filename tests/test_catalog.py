"""Every registered query against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from glossmill.plans import catalog, catalog_flows  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equal_to_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).to_numpy().tolist()))
    assert order(got) == order(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_units_round_trip(spark):
    rows = catalog.units_round_trip(spark, SF)
    assert rows.where("NOT same").count() == 0


def test_equal_for_any_partitioning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from glossmill.operators.packing import pack_batches
    from pyspark.sql import functions as F

    results = set()
    for n in (1, 7, 64):
        rows = pack_batches(catalog.lines_of(docs.repartition(n)), "doc_id", "pos", F.length("line"), 2000)
        results.add(frozenset(map(tuple, rows.collect())))
    assert len(results) == 1
