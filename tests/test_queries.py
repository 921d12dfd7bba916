"""Every query that has SQL gives what DuckDB gives, on the smallest tables."""

import math

import duckdb
import pytest

from lectern.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    made = con.execute(ORACLE[name])
    at = [[c[0] for c in made.description].index(c) for c in got.columns]
    a, b = sorted(map(tuple, got.collect()), key=repr), sorted((tuple(r[i] for i in at) for r in made.fetchall()), key=repr)
    assert len(a) == len(b)
    assert all(same(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True))


def test_the_rest_run(spark):
    assert QUERIES["chunk_pages"](spark, SF).count() > 200
