"""Operators by rounds end with a whole result or an error."""

import pytest

from gridweave.operators import cluster
from gridweave.plans import smooth
from gridweave.queries.graph_queries import QUERIES, edges_of
from gridweave.sources import graphs


def test_running_out_of_rounds_is_an_error(spark):
    g = graphs.grid(spark, 6)
    with pytest.raises(RuntimeError):
        cluster.luby(g.vertices, g.edges, rounds=1)
    with pytest.raises(RuntimeError):
        smooth.color(graphs.laplacian(g.edges, 1.0), rounds=1)
    line = spark.createDataFrame([(k, [0.0, 0.0, float(k)]) for k in range(20)], "vid long, pos array<double>")
    links = spark.createDataFrame([(k, k + 1) for k in range(19)], "src long, dst long")
    with pytest.raises(RuntimeError):
        cluster.plate_test(line, links, rounds=1)
    assert {r.c for r in cluster.plate_test(line, links).collect()} == {0}


def test_set_of_the_whole_graph_is_maximal(spark, sf_dir):
    e = {(r.src, r.dst) for r in edges_of(spark, sf_dir, 1).collect()}
    chosen = {r.vid for r in QUERIES["luby_mis_whole"](spark, sf_dir).collect()}
    assert not any(a in chosen and b in chosen for a, b in e)
    covered = chosen | {b for a, b in e if a in chosen} | {a for a, b in e if b in chosen}
    assert covered == {x for p in e for x in p}
