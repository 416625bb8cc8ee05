"""Every query with an SQL equivalent gives what DuckDB gives; the others run and keep their row laws."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tamarisk import queries as own


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value.isoformat()[:19] if hasattr(value, "isoformat") else value


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_same_as_sql(spark, sf, duck, name):
    df = own.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = duck.sql(own.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_every_offer_has_one_outcome(spark, sf):
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert sum(r.n for r in own.queries()["missing_accounting"](spark, sf).collect()) == n
    assert own.queries()["resolved_offers"](spark, sf).count() == own.queries()["closed_loop"](spark, sf).count() == n
    assert own.queries()["challenged_offers"](spark, sf).count() == n
    priced = own.queries()["matched_pricing"](spark, sf).toPandas()
    assert len(priced) == priced.our_id.nunique() == 200 and (priced.route == "matched").any()


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())
