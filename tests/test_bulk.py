"""F4 to F8: hierarchies by blocks of rows are those by joins, with all blocks on the driver and with all in jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.operators import packed
from gridweave.options import Options, PerLevel
from gridweave.plans import bulk, solve, vectorial
from gridweave.plans import hierarchy as hier
from gridweave.queries.graph_queries import edges_of, matrix_of, vector_of
from gridweave.session import staged
from gridweave.sources import graphs


@pytest.fixture(params=["driver", "jobs"])
def where(request, monkeypatch):
    if request.param == "jobs":
        monkeypatch.setattr(packed, "LOCAL", 0)
        monkeypatch.setattr(packed, "BLOCK", 3000)
        monkeypatch.setattr(packed, "AT_ONCE", 1000)
    return request.param


def entries(df, *keys):
    return {tuple(r[k] for k in keys): r["v"] for r in df.collect()}


def same(got, want):
    assert isinstance(got.levels[0], bulk.HeldLevel) and not isinstance(want.levels[0], bulk.HeldLevel)
    assert [(x.nv, x.ne, x.nnz) for x in got.levels] == [(x.nv, x.ne, x.nnz) for x in want.levels] and len(got.levels) > 1
    assert got.block > 1 or [x.goal for x in got.levels] == [x.goal for x in want.levels]
    for a, b in zip(got.levels, want.levels, strict=True):
        for x, y in [(a.matrix, b.matrix)] + ([(a.p, b.p)] if a.p is not None else []):
            x, y = entries(x, "i", "j"), entries(y, "i", "j")
            assert x.keys() == y.keys() and np.allclose([x[k] for k in x], [y[k] for k in x], rtol=1e-9, atol=1e-9)
        if a.vmap is not None:
            assert {(r.f, r.c) for r in a.vmap.collect()} == {(r.f, r.c) for r in b.vmap.collect()}


@pytest.fixture(scope="module")
def matrix(spark, sf_dir):
    return staged(matrix_of(edges_of(spark, sf_dir, 1)), "a")


def test_levels(where, matrix):
    o = {"max_coarse_size": 10, "max_levels": 3, "sp_omega": 0.8}
    same(hier.build(matrix, Options.of(**o)), hier.build(matrix, Options.of(held_vertices=0, **o)))


def test_grid_with_lone_vertices(where, spark):
    """Vertices without edges are dropped; classic rows are met on a grid."""
    g = graphs.grid(spark, 12, jump=10.0)
    lone = spark.createDataFrame([(k, k, 1.0) for k in (200, 205)], "i long, j long, v double")
    a = staged(graphs.laplacian(g.edges, 1.0).unionByName(lone), "a")
    o = {"max_coarse_size": 5, "max_levels": 3, "prol_type": "aux_smoothed" if where == "jobs" else "semi_aux_smoothed", "sp_omega": PerLevel(0.7)}
    same(hier.build(a, Options.of(**o)), hier.build(a, Options.of(held_vertices=0, **o)))


def test_kernel(where, spark, sf_dir):
    a = staged(graphs.laplacian(edges_of(spark, sf_dir, 1), 0.0), "a")
    h, plain = (hier.build(a, Options.of(max_coarse_size=10, max_levels=2, prol_type="piecewise", held_vertices=n)) for n in (1000, 0))
    x = h.vector(0).select("i", (F.col("i") % 3).cast("double").alias("x"))
    got, want = ([r.err for r in k.kernel_errors(x).collect()] for k in (h, plain))
    assert np.allclose(got, want, atol=1e-9) and max(got) > 0.1


def test_components(where, spark):
    a = staged(vectorial.repeated(graphs.laplacian(graphs.grid(spark, 10, jump=10.0).edges, 1.0), 2), "a")
    o = {"max_coarse_size": 5, "max_levels": 2}
    same(hier.build_hierarchy(a, "h1_2d", options=Options.of(**o)), hier.build_hierarchy(a, "h1_2d", options=Options.of(held_vertices=0, **o)))


def test_cg(where, spark):
    a = staged(graphs.laplacian(graphs.grid(spark, 10, jump=10.0).edges, 1.0), "a")
    got, want = (solve.cg_cycles(hier.build(a, Options.of(max_coarse_size=5, max_levels=3, held_vertices=n)), vector_of(a), 1e-6, 2) for n in (1000, 0))
    assert len(got) == 3 and np.allclose(got, want, rtol=1e-9)
