"""Every catalogue query against its SQL, on the smallest tables (SF_DIR to change)."""

import math
import os

import duckdb
import pytest

from terradelta import catalog, catalog_detail, catalog_places, catalog_streams  # noqa: F401  (the others add to the first)

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12) or math.isnan(a) and math.isnan(b)
    return a == b


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, con, name):
    got = catalog.FOUND[name](spark, SF)
    want = con.execute(catalog.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    key = lambda r: tuple((x is None, str(type(x)), round(x, 4) if isinstance(x, float) else x) for x in r)
    a, b = sorted(map(tuple, got.select(*columns).collect()), key=key), sorted(want.fetchall(), key=key)
    assert len(a) == len(b)
    assert [(x, y) for x, y in zip(a, b) if not all(map(same, x, y))][:3] == []
    assert name == "region_filter_none" or a
