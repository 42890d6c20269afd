"""Every query against its SQL twin, and the driver's contract."""

import glob
import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry
from bidweave.plans import catalog


def rows(df):
    df = df[sorted(df.columns)]

    def plain(x):
        if str(x) in ("None", "nan", "<NA>", "NaT"):
            return None
        if isinstance(x, bool) or str(x) in ("True", "False"):
            return str(bool(x))
        try:
            return round(float(x), 6)
        except (TypeError, ValueError):
            return str(x)

    return sorted(map(str, (tuple(plain(x) for x in r) for r in df.itertuples(index=False))))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_twin(spark, small, duck, name):
    ours = catalog.QUERIES[name](spark, small).toPandas()
    theirs = duck.execute(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).toPandas() is not None


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_core_does_not_need_the_subpackage():
    root = os.path.dirname(importlib.util.find_spec("bidweave").origin)
    for path in glob.glob(f"{root}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert "bidweave.llm" not in open(path).read(), path
