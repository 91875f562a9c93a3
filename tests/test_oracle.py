"""Every registered query over the plain tables against its DuckDB SQL."""

from __future__ import annotations

import math

import duckdb
import pytest

from cueframe.queries import ORACLE_SQL, QUERIES

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, list) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    found = QUERIES[name](spark, SMALL)
    columns = sorted(found.columns)
    mine = sorted((tuple(map(plain, r)) for r in found.select(*columns).collect()), key=repr)
    if name not in ORACLE_SQL:
        assert mine
        return
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert mine == theirs
