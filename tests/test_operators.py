"""Invariants of hierarchies, prolongations, smoothers and solvers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.operators import cluster, linalg, loops, prolong
from gridweave.options import Options, PerLevel
from gridweave.plans import hierarchy, smooth, solve
from gridweave.sources import graphs


def dense(df, n):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r.i, r.j] = r.v
    return out


@pytest.fixture(scope="module")
def grid(spark):
    return graphs.grid(spark, 12)


@pytest.fixture(scope="module")
def matrix(grid):
    return graphs.laplacian(grid.edges, 0.01).cache()


@pytest.mark.parametrize("alg", ["spw", "mis"])
def test_hierarchy(spark, matrix, alg):
    h = hierarchy.build(matrix, Options.of(crs_alg=alg, max_coarse_size=10))
    assert len(h.levels) >= 2 and [x.nv for x in h.levels] == sorted((x.nv for x in h.levels), reverse=True)
    a, p = dense(h.levels[0].matrix, 144), h.levels[0].p.toPandas()
    # clusters partition the vertices
    vmap = h.levels[0].vmap.toPandas()
    assert sorted(vmap.f) == list(range(144)) and vmap.c.notna().all()
    # coarse matrices are symmetric and Galerkin
    full = np.zeros((144, h.levels[1].nv))
    full[p.i, p.j] = p.v
    assert np.allclose(full.T @ a @ full, dense(h.levels[1].matrix, h.levels[1].nv))
    # P 1 is 1 where the auxiliary rows are, and rows are short
    assert p.groupby("i").size().max() <= 5
    total = h.levels[0].graph.edges.agg(F.sum("w")).first()[0]
    assert h.levels[1].graph.edges.agg(F.sum("w")).first()[0] <= total
    local = solve.Local(h)
    _, errors, steps = local.cg(np.ones(144), 1e-6)
    assert len(errors) - 1 < 40 and errors[-1] <= 1e-6 * errors[0]
    lo, hi, ratio = solve.eigenvalue_bounds(steps)
    assert 0 < lo <= hi < 1.2 and ratio < 30


@pytest.mark.parametrize(("jump", "kind"), [(1e1, "fibres"), (1e2, "inclusions"), (1e4, "fibres"), (1e6, "inclusions")])
def test_convergence_with_jumps(spark, jump, kind):
    a = graphs.laplacian(graphs.grid(spark, 12, jump=jump, kind=kind).edges, 0.01)
    h = hierarchy.build(a, Options(max_coarse_size=20))
    _, errors, _ = solve.Local(h).cg(np.ones(144), 1e-6)
    assert len(errors) - 1 < 40


def test_prolongations(spark, grid, matrix):
    vmap = grid.vertices.select(F.col("vid").alias("f"), F.floor(F.col("vid") / 2).alias("c"))
    edges = grid.edges
    aux = prolong.aux_smoothed(edges, vmap).toPandas()
    assert np.allclose(aux.groupby("i").v.sum(), 1) and aux.groupby("i").size().max() <= 3
    classic = prolong.classic(matrix, vmap).toPandas().groupby("i").v.sum()
    a = dense(matrix, 144)
    assert np.allclose(classic.sort_index(), 1 - a.sum(axis=1) / np.diag(a))
    p = prolong.improve(matrix, prolong.aux_smoothed(edges, vmap), vmap)
    assert p.count() <= len(aux)


def test_smoothers_reduce_the_error_and_keep_the_residual(spark, matrix):
    ids = matrix.where("i = j").select("i")
    b = ids.select("i", F.lit(1.0).alias("x"))
    colors = smooth.color(matrix)
    clash = matrix.where("i <> j").join(colors, "i").join(colors.select(F.col("i").alias("j"), F.col("color").alias("other")), "j").where("color = other")
    assert clash.count() == 0
    count = colors.agg(F.max("color")).first()[0] + 1
    part = ids.select("i", F.floor(F.col("i") / 36).alias("p"))
    blocks = ids.select(F.floor(F.col("i") / 4).alias("block_id"), "i")
    a = dense(matrix, 144)
    start = np.ones(144) @ np.linalg.solve(a, np.ones(144))  # energy of the error of zero
    for s in (smooth.Jacobi(matrix, 0.6), smooth.ColoredGaussSeidel(matrix, colors, count), smooth.BlockGaussSeidel(matrix, blocks), smooth.HybridGaussSeidel(matrix, part), smooth.HybridJacobi(matrix, part, 0.6), smooth.Proxy(smooth.Jacobi(matrix, 0.6), 2, True)):
        x, res = s.smooth(solve.zero_like(b), b, x_zero=True)
        exact = smooth.residual(matrix, x, b)
        assert solve.norm(linalg.axpy(-1.0, exact, res)) < 1e-9
        error = x.toPandas().sort_values("i").x.to_numpy() - np.linalg.solve(a, np.ones(144))
        assert error @ a @ error < start


def test_gauss_seidel_equals_the_sequential_one(spark, matrix):
    """In the order of colours."""
    colors = smooth.color(matrix)
    got = smooth.ColoredGaussSeidel(matrix, colors, colors.agg(F.max("color")).first()[0] + 1)
    b = matrix.where("i = j").select("i", F.lit(1.0).alias("x"))
    x = got.smooth(solve.zero_like(b), b, x_zero=True)[0].toPandas().sort_values("i").x.to_numpy()
    a, want = dense(matrix, 144), np.zeros(144)
    for i in [r.i for r in colors.orderBy("color", "i").collect()]:
        want[i] += (1 - a[i] @ want) / a[i, i]
    assert np.allclose(x, want)


@pytest.mark.parametrize("kind", ["V", "W", "BS"])
def test_cycles_converge(spark, kind):
    a = graphs.laplacian(graphs.grid(spark, 8).edges, 0.05)
    h = hierarchy.build(a, Options(max_coarse_size=6, mg_cycle=kind))
    b = h.levels[0].matrix.where("i = j").select("i", F.lit(1.0).alias("x"))
    c = solve.Cycle.of(h)
    s = solve.LinearSolver(h.levels[0].matrix, c.smooth, 1e-2, 6)
    s.solve(b)
    assert s.errors[-1] < 0.5 * s.errors[0] and s.history(spark).count() == s.needed_steps + 1


def test_hiptmair_with_a_potential(spark):
    edges, cells = graphs.grid(spark, 4).edges.withColumn("eid", F.col("src") * 100 + F.col("dst")), None
    e = {(r.src, r.dst): k for k, r in enumerate(sorted(edges.collect()))}
    eid = spark.createDataFrame([(k, a, b) for (a, b), k in e.items()], "eid long, src long, dst long")
    around = []
    for n, (x, y) in enumerate((x, y) for y in range(3) for x in range(3)):
        v = x + 4 * y
        around += [(n, 0, e[v, v + 1], 1), (n, 1, e[v + 1, v + 5], 1), (n, 2, e[v + 4, v + 5], -1), (n, 3, e[v, v + 4], -1)]
    d = loops.curl(spark.createDataFrame(around, "loop_id long, pos int, eid long, sign int"))
    div = loops.divergence(eid)
    assert linalg.compress(linalg.spgemm(div, d), 1e-12).count() == 0
    a = linalg.add(1.0, linalg.identity(eid.select(F.col("eid").alias("i"))), 1.0, linalg.spgemm(linalg.transpose(div), div))
    pot = linalg.rap(a, d)
    s = smooth.Hiptmair(a, d, smooth.Jacobi(pot, 0.5), smooth.Jacobi(a, 0.3))
    b = eid.select(F.col("eid").alias("i"), F.lit(1.0).alias("x"))
    x, res = s.smooth(solve.zero_like(b), b)
    assert solve.norm(res) < solve.norm(b) and cells is None


def test_loops(spark):
    chain = [(7, 0, 1, 1), (7, 1, 2, 1), (7, 2, 3, -1), (7, 3, 3, 1), (8, 0, 2, -1), (8, 1, 1, -1), (9, 0, 5, 1), (9, 1, 5, -1)]
    emap = spark.createDataFrame([(1, 11, 1), (2, 12, 1), (3, 13, 1), (5, 15, -1)], "eid long, ceid long, csign int")
    got = loops.map_loops(spark.createDataFrame(chain, "loop_id long, pos int, eid long, sign int"), emap).collect()
    assert {r.loop_id for r in got} == {7} and sorted(r.eid for r in got) == [11, 12]
    facets = spark.createDataFrame([(0, 0, 1), (1, 1, 2), (2, 2, 0)], "eid long, src long, dst long")
    ring = loops.facet_loops(facets, facets.select(F.lit(5).cast("long").alias("node"), "eid")).orderBy("pos").collect()
    assert [(r.eid, r.sign) for r in ring] == [(0, 1), (1, 1), (2, 1)]
    v, e = loops.dual_graph(spark.createDataFrame([(0, 0, 1, None), (1, 1, None, 3), (2, 1, None, None)], "eid long, a long, b long, boundary int"), spark.createDataFrame([(0, 2.0), (1, 3.0)], "vid long, vol double"))
    assert sorted(r.vid for r in v.collect()) == [-1000000, -4, 0, 1] and e.count() == 3
    off = loops.edge_offsets(spark.createDataFrame([(1, 2), (2, 3), (5, 1)], "eid long, ndof long")).orderBy("eid").collect()
    assert [r.first for r in off] == [0, 2, 5]


def test_clusters(spark, grid):
    data = grid.vertices.select("vid", F.lit(4.0).alias("d"), F.lit(1.0).alias("max_od"), F.lit(1.0).alias("cnt"))
    got = cluster.spw(grid.vertices.select("vid"), grid.edges, data).toPandas()
    assert sorted(got.f) == list(range(144)) and 2 <= len(got) / got.c.nunique() <= 16
    again = cluster.spw(grid.vertices.select("vid").repartition(7), grid.edges.repartition(5), data).toPandas()
    assert dict(zip(got.f, got.c)) == dict(zip(again.f, again.c))
    seeds = {r.vid for r in cluster.luby(grid.vertices, grid.edges).collect()}
    pairs = {(r.src, r.dst) for r in grid.edges.collect()}
    assert not any(a in seeds and b in seeds for a, b in pairs)
    assert all(v in seeds or any((min(v, s), max(v, s)) in pairs for s in seeds) for v in range(144))


@pytest.mark.parametrize("kind", ["geom", "harm", "min", "alg", "max", "hharm"])
def test_local_clusters_equal_the_distributed_ones(spark, sf_dir, kind):
    from gridweave.operators import weights
    from gridweave.plans import local

    edges = graphs.copurchase(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), 1).cache()
    data = weights.aux_diagonal(graphs.Graph(graphs.vertices_of(edges), edges)).cache()
    live = data.where("vid % 11 <> 0").select("vid")
    want = cluster.spw(live, edges, data, 2, 2, kind).toPandas()
    got = local.spw(live, edges, data, 2, 2, kind, 0.025, True).toPandas()
    assert dict(zip(got.f, got.c)) == dict(zip(want.f, want.c)) and want.c.nunique() < len(want)


def test_options():
    o = Options.of(sp_omega_spec=[0.5, 0.7], max_levels=3)
    assert (o.sp_omega.at(0), o.sp_omega.at(1), o.sp_omega.at(2), o.max_levels) == (0.5, 0.7, 1.0, 3)
    assert PerLevel(1, {2: 5}).at(2) == 5
    with pytest.raises(ValueError):
        Options.of(nothing=1)
    with pytest.raises(ValueError):
        hierarchy.build_hierarchy(None, "unknown")
