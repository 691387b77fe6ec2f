"""Vector-valued hierarchies, composed operators, contraction, coarsening control and two-level bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.functions.dense import rigid
from gridweave.operators import contract, elastic, linalg, weights
from gridweave.operators.expressions import Embedding, Matrix, Projection
from gridweave.options import Options
from gridweave.plans import hierarchy as hier
from gridweave.plans import smooth, solve, vectorial
from gridweave.session import staged
from gridweave.sources import graphs


def dense(df, rows, cols=None):
    out = np.zeros((rows, cols or rows))
    for r in df.collect():
        out[r.i, r.j] += r.v
    return out


@pytest.mark.parametrize("omega, most", [(0.6, 50), (0.0, 50)])
def test_beam_converges(spark, omega, most):
    """A clamped beam of 10 by 1: fewer than 50 steps of conjugate gradients to 1e-6."""
    a, pos = vectorial.beam(spark, 60, 6)
    h = hier.build_hierarchy(a, "elast_2d", positions=pos, omega=omega)
    assert len(h.levels) >= 3 and h.levels[-1].nv <= 20 and h.block == 3
    _, errors, _ = solve.Local(h).cg(np.ones(2 * 60 * 7), 1e-6)
    assert len(errors) - 1 < most


def test_rigid_motions_pass_all_levels(spark):
    """Unsmoothed prolongations carry the rigid motions of the coarsest level to those of the finest."""
    a, pos = vectorial.beam(spark, 24, 4, clamped=False)
    h = hier.build_hierarchy(a, "elast_2d", positions=pos, omega=0.0)
    coarse = h.levels[-1]
    last = len(h.levels) - 1
    assert last >= 1
    # the turn about the origin, from the centres of the coarsest clusters
    at = pos
    for lev in h.levels[:-1]:
        at = elastic.coarse_positions(at, lev.vmap, 2)
    rows = [(3 * r.vid + k, float(v)) for r in at.collect() for k, v in enumerate((-r.pos[1], r.pos[0], 1.0))]
    x = {r.i: r.x for r in h.transfer(last, 0, spark.createDataFrame(rows, "i long, x double")).collect()}
    for r in pos.collect():
        assert abs(x[2 * r.vid] + r.pos[1]) < 1e-9 and abs(x[2 * r.vid + 1] - r.pos[0]) < 1e-9
    assert coarse.nv <= 20 or len(h.levels) == 10


def test_turns_in_three_dimensions(spark):
    rng = np.random.default_rng(0)
    p, c = rng.normal(size=(4, 3)), rng.normal(size=3)
    fine = spark.createDataFrame([(i, p[i].tolist()) for i in range(4)], "vid long, pos array<double>")
    coarse = spark.createDataFrame([(0, c.tolist())], "vid long, pos array<double>")
    vmap = spark.createDataFrame([(i, 0) for i in range(4)], "f long, c long")
    for turns, rows in ((True, 6), (False, 3)):
        got = dense(vectorial.rigid_prolongation(vmap, fine, coarse, 3, turns), 4 * rows, 6)
        for i in range(4):
            assert np.allclose(got[rows * i : rows * (i + 1)], rigid(3, p[i] - c)[:rows])


def test_components_share_prolongations(spark):
    a = graphs.laplacian(graphs.grid(spark, 10).edges, 0.01)
    h = hier.build_hierarchy(vectorial.repeated(a, 2), "h1_2d", options=Options(max_coarse_size=10))
    one = hier.build(a, Options(max_coarse_size=10))
    n = h.levels[1].nv
    p = dense(h.levels[0].p, 200, 2 * n)
    assert n == one.levels[1].nv and not p[0::2, 1::2].any() and not p[1::2, 0::2].any() and np.array_equal(p[0::2, 0::2], p[1::2, 1::2])
    _, errors, _ = solve.Local(h).cg(np.ones(200), 1e-12)
    assert len(errors) - 1 < 30
    assert {"h1_scal", "h1_2d", "h1_3d", "elast_2d", "elast_3d"} <= set(hier.REGISTRY)
    assert h.sizes(0) == {"block": 2, "vertices": 100, "unknowns": 200, "edges": 180, "entries": h.levels[0].nnz} and h.sizes(1)["unknowns"] == 2 * n


def test_smoothed_prolongation(spark):
    a, pos = vectorial.beam(spark, 6, 2)
    vmap = pos.select(F.col("vid").alias("f"), F.floor(F.col("vid") / 3).alias("c"))
    p = vectorial.rigid_prolongation(vmap, pos, elastic.coarse_positions(pos, vmap, 2), 2, False)
    n, m = 42, 21
    full, tent = dense(a, n), dense(p, n, m)
    d = np.zeros((n, n))
    for k in range(0, n, 2):
        d[k : k + 2, k : k + 2] = np.linalg.pinv(full[k : k + 2, k : k + 2])
    assert np.allclose(dense(vectorial.smoothed(a, p, 2, 0.6), n, m), tent - 0.6 * d @ full @ tent)


def test_steps_and_goals():
    o = Options()
    assert hier.accepted(100, 89, o) and not hier.accepted(100, 90, o) and not hier.accepted(100, 0, o) and not hier.accepted(100, 100, o)
    assert hier.accepted(100, 95, Options(redistribute=False))
    # met goal: as many tasks as the size takes, but no faster than the factor; missed goal or slow step: fewer by the factor
    assert hier.partitions_of(10_000_000, 1_000_000, 1_000_000, 64, o, 64) == 16
    assert hier.partitions_of(40_000_000, 10_000_000, 10_000_000, 64, o, 64) == 40
    assert hier.partitions_of(40_000_000, 10_000_001, 10_000_000, 64, o, 64) == 16
    assert hier.partitions_of(5000, 900, 500, 64, o, 64) == 1 and hier.partitions_of(5000, 2000, 500, 8, Options(redistribute=False), 64) == 8


def test_goals_decide_tasks(spark):
    a = graphs.laplacian(graphs.grid(spark, 12).edges, 0.01)
    of = lambda **k: [(r.goal, r.reached, r.parts) for r in hier.build(a, Options.of(max_coarse_size=10, seq_vertices=5, vertices_per_task=5, **k)).steps(spark).orderBy("level").collect()]
    low, high = of(first_aaf=0.05, aaf=0.05), of(first_aaf=0.5, aaf=0.5)
    assert [g for g, _, _ in low] != [g for g, _, _ in high] and not low[0][1] and high[0][1] and low[1][2] < high[1][2]


def test_kernel_and_two_level_bounds(spark):
    g = graphs.grid(spark, 12).edges
    h = hier.build(graphs.laplacian(g, 0.0), Options.of(max_coarse_size=10, prol_type="piecewise"))
    assert all(r.err < 1e-9 for r in h.kernel_errors(h.vector(0, 1.0)).collect())
    assert any(r.err > 0.1 for r in h.kernel_errors(h.vector(0).select("i", (F.col("i") % 3).cast("double").alias("x"))).collect())
    h = hier.build(graphs.laplacian(g, 0.01), Options(max_coarse_size=10))
    lo, hi, ratio = solve.two_level_bounds(h)
    assert 0 < lo <= hi < 1.3 and ratio < 30
    assert sorted(r.i for r in h.sub(1).vector(0).collect()) == list(range(h.levels[1].nv)) and h.step(0) is h.levels[0].p


def test_distributed_cycle_meets_the_ceilings(spark):
    """Conjugate gradients with the V-cycle on DataFrames: jumps of 1e4, fewer than 40 steps to 1e-6."""
    a = graphs.laplacian(graphs.grid(spark, 8, jump=1e4, kind="inclusions").edges, 0.01)
    h = hier.build(a, Options(max_coarse_size=25))
    m = h.levels[0].matrix
    b = staged(m.where("i = j").select("i", F.lit(1.0).alias("x")), "b")
    x, errors, _ = solve.cg(m, b, solve.Cycle.of(h).apply, 1e-6, 40)
    assert len(errors) - 1 < 40 and errors[-1] <= 1e-6 * errors[0]
    assert solve.norm(smooth.residual(m, x, b)) < 1e-3


def test_regularized(spark):
    a = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 0.0)], "i long, j long, v double")
    h = hier.Hierarchy([hier.Level(a, None, 2, 1, 4)], Options())
    assert dense(h.regularized(0), 2).tolist() == [[2.0, 1.0], [1.0, 1.0]]


def test_dynamic_blocks_and_free_rows(spark):
    rng = np.random.default_rng(2)
    base = np.kron(np.diag([4.0, 5.0, 6.0]) - 0.5, np.ones((2, 2))) + 2 * np.eye(6)
    base[:2, 4:] = base[4:, :2] = 0
    a = spark.createDataFrame([(i, j, float(base[i, j])) for i in range(6) for j in range(6) if base[i, j]], "i long, j long, v double")
    b = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.normal(size=6))], "i long, x double")
    rhs = np.array([r.x for r in b.orderBy("i").collect()])
    for free in (None, [0, 1, 4, 5]):
        s = smooth.DynamicBlockGaussSeidel(a, None if free is None else spark.createDataFrame([(i,) for i in free], "i long"))
        x, res = s.smooth(solve.zero_like(b), b, x_zero=True)
        got = np.array([r.x for r in x.orderBy("i").collect()]) if free is None else None
        blocks = {tuple(r.ids) for r in smooth.block_inverses(a, linalg.row_blocks(a).select(F.col("block").alias("block_id"), "i")).collect()}
        assert blocks == {(0, 1), (2, 3), (4, 5)}
        if got is not None:
            assert np.allclose(base @ got + np.array([r.x for r in res.orderBy("i").collect()]), rhs)
        else:
            assert {r.i for r in x.where("x <> 0").collect()} <= set(free)
    # a step never makes the energy of the error larger
    exact = np.linalg.solve(base, rhs)
    x, _ = smooth.DynamicBlockGaussSeidel(a).smooth(solve.zero_like(b), b, x_zero=True)
    e = np.array([r.x for r in x.orderBy("i").collect()]) - exact
    assert e @ base @ e < exact @ base @ exact


def test_parts_are_bounded(spark, monkeypatch):
    a = graphs.laplacian(graphs.grid(spark, 6).edges, 1.0)
    part = a.where("i = j").select("i", F.lit(0).cast("long").alias("p"))
    monkeypatch.setattr(smooth.HybridDirect, "MOST", 35)
    with pytest.raises(ValueError, match="36 rows"):
        smooth.HybridDirect(a, part)
    b = a.where("i = j").select("i", (F.col("i") % 3 + 1.0).alias("x"))
    full = dense(a, 36)
    rhs = np.array([i % 3 + 1.0 for i in range(36)])
    for back, triangle in ((False, np.tril(full)), (True, np.triu(full))):
        x, _ = smooth.HybridGaussSeidel(a, part, backward=back).smooth(solve.zero_like(b), b, x_zero=True)
        assert np.allclose([r.x for r in x.orderBy("i").collect()], np.linalg.solve(triangle, rhs))


def test_operators_against_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.integers(-3, 4, (5, 5)).astype(float)
    a = Matrix(spark.createDataFrame([(i, j, float(m[i, j])) for i in range(5) for j in range(5) if m[i, j]], "i long, j long, v double"))
    ids = spark.range(5).select(F.col("id").alias("i"))
    keep = np.diag([1.0, 0, 1, 0, 0])
    op = Embedding(ids, 3) @ (0.5 * (a + a.T) @ Projection(ids.where("i in (0, 2)")))
    want = np.vstack([np.zeros((3, 5)), 0.5 * (m + m.T) @ keep])
    assert np.allclose(dense(op.to_matrix(), 8, 5), want)
    x = rng.normal(size=5)
    got = np.zeros(8)
    for r in op.apply(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double")).collect():
        got[r.i] = r.x
    assert np.allclose(got, want @ x) and np.allclose(dense(op.T.to_matrix(), 5, 8), want.T)


def test_contraction_keeps_what_operators_do(spark):
    """Shares of a matrix times a vector, then put together, is the contracted matrix times the contracted vector."""
    rng = np.random.default_rng(3)
    nodes = spark.createDataFrame([(p, v, g) for p, ids in enumerate(([0, 1, 2], [2, 3, 4], [4, 5, 0])) for v, g in enumerate(ids)], "p long, v long, g long")
    groups = spark.createDataFrame([(0, 7), (1, 7), (2, 9)], "p long, q long")
    m = staged(contract.contract_nodes(nodes, groups), "m")
    a = spark.createDataFrame([(p, i, j, float(rng.integers(1, 9))) for p in range(3) for i in range(3) for j in range(3)], "p long, i long, j long, v double")
    x = rng.integers(1, 9, 6).astype(float)
    copies = contract.scatter(spark.createDataFrame([(g, float(v)) for g, v in enumerate(x)], "g long, x double"), nodes)
    y = a.withColumnRenamed("v", "w").join(copies.select("p", F.col("v").alias("j"), "x"), ["p", "j"]).groupBy("p", F.col("i").alias("v")).agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    left = {(r.q, r.u): r.x for r in contract.contract_vector(y, m).collect()}
    cx = contract.contract_vector(copies, m, distributed=False)
    right = contract.contract_matrix(a, m).join(cx.select("q", F.col("u").alias("j"), "x"), ["q", "j"]).groupBy("q", "i").agg(F.sum(F.col("v") * F.col("x")).alias("x"))
    assert left == {(r.q, r.i): r.x for r in right.collect()} and len(left) == 8
    # gathered over all parts both give the same global vector
    assert {r.g: r.x for r in contract.gather(y, nodes).collect()} == {r.g: r.x for r in m.select("q", "u", "g").distinct().join(contract.contract_vector(y, m), ["q", "u"]).groupBy("g").agg(F.sum("x").alias("x")).collect()}


def test_trace_weights(spark):
    a = graphs.laplacian(graphs.grid(spark, 4).edges, 0.5)
    two = {(r.src, r.dst): r.w for r in vectorial.vertex_graph(vectorial.repeated(a, 2), 2).edges.collect()}
    one = {(r.src, r.dst): r.w for r in weights.algebraic(a).edges.collect()}
    assert two == {k: 2 * v for k, v in one.items()}
