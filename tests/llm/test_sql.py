"""Queries with SQL give the other engine's rows."""

import duckdb
import pytest

from lodestone.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    asked = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in asked.description]
    found = queries.QUERIES[name](spark, sf_dir)
    assert sorted(names) == sorted(found.columns)
    place = [names.index(c) for c in found.columns]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr(tuple(r[i] for i in place)) for r in asked.fetchall())
