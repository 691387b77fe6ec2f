"""Queries on the whole co-purchase graph: DuckDB on the same files with all edges, or the edges themselves."""

import os

import duckdb
import pytest

from gridweave.queries.graph_queries import ORACLE_SQL, QUERIES, edges_of
from tests.test_graph_queries import norm


@pytest.mark.parametrize("name", ["soc_geom", "strong_edges", "lap_matrix"])
def test_all_edges(name, spark, sf_dir):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{sf_dir}/{t}'")
    df = QUERIES[f"{name}_whole"](spark, sf_dir)
    res = con.execute(ORACLE_SQL[name].replace("FROM edges0 WHERE w >= 2", "FROM edges0"))
    at = [[x[0] for x in res.description].index(c) for c in df.columns]
    want = sorted(tuple(norm(r[i]) for i in at) for r in res.fetchall())
    assert sorted(tuple(map(norm, r)) for r in df.collect()) == want
    assert len(want) > QUERIES[name](spark, sf_dir).count()


def test_clusters_hold_every_vertex(spark, sf_dir):
    e = edges_of(spark, sf_dir, 1).select("src", "dst").collect()
    got = {r.f for r in QUERIES["spw_clusters"](spark, sf_dir).collect()}
    assert got == {r.src for r in e} | {r.dst for r in e}
