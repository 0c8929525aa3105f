"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from strandline.queries import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, duck, name):
    f, sql = REGISTRY[name]
    df = f(spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(shown, r)) for r in df.select(cols).collect())
    assert len(set(cols)) == len(cols)
    if sql:
        r = duck.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        assert got == sorted(tuple(shown(row[names.index(c)]) for c in cols) for row in r.fetchall())
