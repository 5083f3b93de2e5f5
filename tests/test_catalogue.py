"""Every query of the catalogue against its DuckDB SQL."""

import glob
import math
import os

import duckdb
import pytest

from quire.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def against_sql(spark, query, sql, folder=SF):
    db = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df, other = query(spark, folder), db.sql(sql)
    assert sorted(df.columns) == sorted(other.columns)
    assert rows(df.columns, df.collect()) == rows(other.columns, other.fetchall())


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    against_sql(spark, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_large_tables_are_scanned_by_column(spark):
    plan = catalogue.last_stamp(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "partial_max_by" in plan


@pytest.mark.parametrize("name", ["hit_test", "nearest_page", "hit_on_page"])
def test_places_meet_by_keys(spark, name):
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
