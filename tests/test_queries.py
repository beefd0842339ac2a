"""Every registered query of the page store against its DuckDB oracle on the smallest tables."""

import math
import os

import pytest

from snapstore.plans import store_queries  # noqa: F401  registers its queries
from snapstore.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def norm(rows):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    d = QUERIES[name](spark, SF)
    columns = sorted(d.columns)
    want = db.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLE[name]})").fetchall()
    assert norm(map(tuple, d.select(columns).collect())) == norm(want)
