"""Every query of the registry against its DuckDB text on the smallest tables."""

import math
import os

import duckdb
import pytest

from locusframe.plans import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    fix = lambda x: 0.0 if isinstance(x, float) and x == 0 else x
    return sorted((tuple(map(fix, r)) for r in rows), key=lambda r: tuple((x is None, str(type(x)) if x is None else "", x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(map(tuple, df.select(*[f"`{c}`" for c in columns]).collect()))
    if name not in registry.oracle_sql():
        assert got
        return
    found = duck.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == columns
    want = plain(found.select(*[f'"{c}"' for c in columns]).fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and math.isclose(x, float(y), rel_tol=1e-6, abs_tol=2e-6)), (a, b)
