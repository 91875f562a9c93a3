"""Registered queries that SQL can express, against DuckDB."""

from __future__ import annotations

import pytest

from cueframe.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import SMALL
from ..test_oracle import duck, plain  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):  # noqa: F811
    found = QUERIES[name](spark, SMALL)
    columns = sorted(found.columns)
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in found.select(*columns).collect()), key=repr) == theirs


def test_queries_over_whole_tables(spark):
    """Each registered query gives a row for each row of its table."""
    for name, table in (("op1_bpe", "documents"), ("op4_token_counts", "documents"), ("op6_token_records", "documents"), ("op7_warc_fixity", "pages"), ("op2_html_text", "pages"), ("op8_quality", "documents"), ("op9_decontamination", "documents")):
        assert QUERIES[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count(), name
