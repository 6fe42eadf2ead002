"""Every query with an oracle against DuckDB on the smallest tables; the others must run and return rows."""

import math
import os

import duckdb
import pytest

from cohortry.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    plain = [tuple(str(r[k]) if hasattr(r[k], "isoformat") else r[k] for k in order) for r in data]
    return sorted(plain, key=lambda r: tuple((x is None, f"{x:.3f}" if isinstance(x, float) else str(x)) for x in r))


def same(x, y):
    if isinstance(x, float) and isinstance(y, float | int) or isinstance(y, float) and isinstance(x, int):
        return math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)
    return x == y


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    found = rows(got.columns, got.collect())
    if name not in ORACLES:
        assert found
        return
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    expected = rows(columns, want.fetchall())
    assert len(found) == len(expected)
    assert all(same(x, y) for r, q in zip(found, expected) for x, y in zip(r, q))


@pytest.mark.parametrize("name", ["network_clusters", "linkage_clusters"])
def test_clusterings_hold_every_image(spark, name):
    images = spark.read.parquet(f"{FOLDER}/embeddings.parquet").count()
    assert QUERIES[name](spark, FOLDER).select("image").distinct().count() == images
