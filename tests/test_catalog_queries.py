"""Every query of the asset engine against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from amberlode.plans import catalog_queries as Q
from amberlode.plans.flow_queries import SLOW_SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(given, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted(tuple(repr(plain(r[i])) for i in order) for r in given)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    said = duck.execute((Q.ORACLES | SLOW_SQL)[name])
    names = [x[0] for x in said.description]
    assert sorted(names) == sorted(df.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(said.fetchall(), names)
