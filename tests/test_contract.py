"""Every registered query of the engine's own operators equals its SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from wirelake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def cells(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    shown = [["∅" if x is None or x is pd.NA or x is pd.NaT or x != x else f"{x:.9g}" if isinstance(x, float) else str(x) for x in df[c].tolist()] for c in df.columns]
    shown = [[s.removesuffix(".0") for s in column] for column in shown]
    return sorted(zip(*shown, strict=True)) if shown else []


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert cells(got) == cells(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
