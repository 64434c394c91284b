"""Every registered query against its SQL on the small tables; those without SQL must run and keep their schema."""

import os

import duckdb
import pandas as pd
import pytest

from folioflow.plans import book_queries, catalog_queries, content_queries, editing_queries, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return ""
    if hasattr(x, "tolist") or isinstance(x, list):
        return str([cell(y) for y in x])
    try:
        return repr(round(float(x), 6)) if not isinstance(x, (str, bool)) else str(x)
    except (TypeError, ValueError):
        return str(x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name in registry.ORACLE_SQL:
        want = duck.execute(registry.ORACLE_SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        cols = sorted(got.columns)
        norm = lambda d: sorted(tuple(map(cell, r)) for r in d[cols].astype(object).itertuples(index=False))
        assert norm(got) == norm(want)
