"""Queries of the subpackage against their SQL on a whole table."""

import duckdb
import pytest

from seqloom.llm import queries


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_is_its_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, sf), c.execute(queries.ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
