"""Every query against its SQL, as multisets of rows."""

import math
import os
from collections import Counter

import duckdb
import pytest

from wordloom import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return x


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(path := f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = core.queries()[name](spark, sf_dir)
    want = duck.sql(core.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    a = Counter(tuple(map(plain, r)) for r in got.collect())
    b = Counter(tuple(plain(r[k]) for k in order) for r in want.fetchall())
    assert a == b, (list((a - b).items())[:5], list((b - a).items())[:5])
    assert a, "no rows: the query shows nothing"


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert core.queries()[name](spark, sf_dir).count() > 0
