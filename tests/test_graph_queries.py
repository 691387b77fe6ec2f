"""Every query with SQL against DuckDB on the same files; the others by invariants (test_operators.py) or by running."""

import math
import os

import duckdb
import pytest

from gridweave.queries.vector_queries import ORACLE_SQL, QUERIES


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{sf_dir}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in res.fetchall()), key=repr)


#: With all edges no vertex is isolated or dominated by its weight: DuckDB's answer is empty too.
EMPTY = ("drop_isolated_whole", "drop_l2_dominant_whole")


@pytest.mark.parametrize("name", EMPTY)
def test_empty_against_sql(name, spark, sf_dir, duck):
    sql = ORACLE_SQL[name.removesuffix("_whole")]
    assert "FROM edges0 WHERE w >= 2" in sql
    want = duck.execute(sql.replace("FROM edges0 WHERE w >= 2", "FROM edges0")).fetchall()
    assert sorted(map(tuple, QUERIES[name](spark, sf_dir).collect())) == sorted(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - set(EMPTY)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0
