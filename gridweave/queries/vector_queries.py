"""Queries on contraction, composed operators, smoothers by blocks and parts, and vector-valued problems."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.operators import contract, elastic, linalg, loops
from gridweave.operators.expressions import Matrix, Projection
from gridweave.options import Options
from gridweave.plans import hierarchy as hier
from gridweave.plans import smooth, solve, vectorial
from gridweave.queries.graph_queries import ORACLE_SQL, QUERIES, grid_sql, query, vector_of, whole_laplacian
from gridweave.queries.mesh_queries import DUAL, FACETS, LOOPS, K, _dual, _loops
from gridweave.session import staged
from gridweave.sources import graphs

# --- contraction: four parts of 64 vertices, each with copies of the 8 before its own; parts 0 and 1, 2 and 3 are put together
NODES = "nodes AS (SELECT p, g - p * 64 + 8 AS v, g FROM range(4) a(p), range(256) b(g) WHERE g >= p * 64 - 8 AND g < p * 64 + 64)"
MAPPED = f"{NODES}, moved AS (SELECT p, v, g, p // 2 AS q FROM nodes), mapping AS (SELECT p, v, g, q, dense_rank() OVER (PARTITION BY q ORDER BY g) - 1 AS u FROM moved)"


def _nodes(spark) -> DataFrame:
    p = spark.range(4).select(F.col("id").alias("p"))
    return p.select("p", F.explode(F.sequence(F.col("p") * 64 - 8, F.col("p") * 64 + 63)).alias("g")).where("g >= 0").select("p", (F.col("g") - F.col("p") * 64 + 8).alias("v"), "g")


def _mapping(spark) -> DataFrame:
    return contract.contract_nodes(_nodes(spark), spark.range(4).select(F.col("id").alias("p"), F.floor(F.col("id") / 2).alias("q")))


def _shares(spark) -> DataFrame:
    return _nodes(spark).select("p", "v", (F.col("g") % 5 + F.col("p")).cast("double").alias("x"))


@query(f"WITH {NODES} SELECT p, v, CAST(g % 5 AS DOUBLE) AS x FROM nodes")
def scatter_copies(spark, d):
    return contract.scatter(spark.range(256).select(F.col("id").alias("g"), (F.col("id") % 5).cast("double").alias("x")), _nodes(spark))


@query(f"WITH {NODES} SELECT g, sum(CAST(g % 5 + p AS DOUBLE)) AS shares, CAST(g % 5 + min(p) AS DOUBLE) AS owner FROM nodes GROUP BY g")
def gather_copies(spark, d):
    a, b = (contract.gather(_shares(spark), _nodes(spark), s).withColumnRenamed("x", n) for s, n in ((True, "shares"), (False, "owner")))
    return a.join(b, "g")


@query(f"WITH {MAPPED} SELECT p, v, g, q, u FROM mapping")
def contract_nodes(spark, d):
    return _mapping(spark)


@query(f"WITH {MAPPED} SELECT q, u, sum(CAST(g % 5 + p AS DOUBLE)) AS shares, arg_min(CAST(g % 5 + p AS DOUBLE), p) AS whole FROM mapping GROUP BY q, u")
def contract_data(spark, d):
    m = _mapping(spark)
    a, b = (contract.contract_data(_shares(spark), m, s).withColumnRenamed("x", n) for s, n in ((True, "shares"), (False, "whole")))
    return a.join(b, ["q", "u"])


@query(f"""WITH {MAPPED}, e AS (SELECT p, v AS src, v + 1 AS dst, 1 + v % 3 + 0.0::DOUBLE AS w FROM nodes WHERE (p, v + 1) IN (SELECT p, v FROM nodes))
SELECT a.q, least(a.u, b.u) AS src, greatest(a.u, b.u) AS dst, sum(w) AS w FROM e JOIN mapping a ON a.p = e.p AND a.v = e.src JOIN mapping b ON b.p = e.p AND b.v = e.dst GROUP BY 1, 2, 3""")
def contract_edges(spark, d):
    n = _nodes(spark)
    e = n.select("p", F.col("v").alias("src"), (F.col("v") + 1).alias("dst"), (1.0 + F.col("v") % 3).alias("w")).join(n.select("p", F.col("v").alias("dst")), ["p", "dst"], "left_semi")
    return contract.contract_edges(e, _mapping(spark))


@query(f"""WITH {MAPPED}, a AS (SELECT p, v AS i, v AS j, 2.0::DOUBLE AS v FROM nodes UNION ALL SELECT p, v, v + 1, -1.0 FROM nodes WHERE v < 71)
SELECT r.q, r.u AS i, c.u AS j, sum(a.v) AS v FROM a JOIN mapping r ON r.p = a.p AND r.v = a.i JOIN mapping c ON c.p = a.p AND c.v = a.j GROUP BY 1, 2, 3""")
def contract_matrix(spark, d):
    n = _nodes(spark)
    a = n.select("p", F.col("v").alias("i"), F.col("v").alias("j"), F.lit(2.0).alias("v")).unionByName(n.where("v < 71").select("p", F.col("v").alias("i"), (F.col("v") + 1).alias("j"), F.lit(-1.0).alias("v")))
    return contract.contract_matrix(a, _mapping(spark))


@query(f"""WITH {MAPPED}, y AS (SELECT q, u, sum(CAST(g % 5 + p AS DOUBLE)) AS x FROM mapping GROUP BY q, u) SELECT p, v, x FROM mapping JOIN y USING (q, u)""")
def contract_there_and_back(spark, d):
    """A vector of shares on the new parts, and from there at all old copies."""
    m = staged(_mapping(spark), "mapping")
    return contract.expand_vector(contract.contract_vector(_shares(spark), m), m)


@query(f"""WITH {MAPPED}, cn AS (SELECT DISTINCT p, v // 2 AS v, g // 2 AS g FROM nodes), cm AS (SELECT p, v, g, p // 2 AS q, dense_rank() OVER (PARTITION BY p // 2 ORDER BY g) - 1 AS u FROM cn)
SELECT f.q, f.u AS i, c.u AS j, CAST(1 + max(f.g) % 3 AS DOUBLE) AS v FROM mapping f JOIN cm c ON c.p = f.p AND c.v = f.v // 2 GROUP BY 1, 2, 3""")
def pull_prolongation(spark, d):
    n = _nodes(spark)
    coarse = n.select("p", F.floor(F.col("v") / 2).alias("v"), F.floor(F.col("g") / 2).alias("g")).distinct()
    groups = spark.range(4).select(F.col("id").alias("p"), F.floor(F.col("id") / 2).alias("q"))
    p = n.select("p", F.col("v").alias("i"), F.floor(F.col("v") / 2).alias("j"), (1.0 + F.col("g") % 3).alias("v"))
    return contract.pull_prolongation(p, _mapping(spark), contract.contract_nodes(coarse, groups))


@query(f"""WITH {FACETS}, {LOOPS}, held AS (SELECT eid % 3 AS p, loop_id, pos, eid, sign FROM lp),
moved AS (SELECT p // 2 AS q, loop_id, pos, eid, CASE WHEN eid % 5 = 0 THEN -sign ELSE sign END AS sign FROM held)
SELECT q, loop_id, CAST(row_number() OVER (PARTITION BY q, loop_id ORDER BY pos, eid) - 1 AS INTEGER) AS pos, eid, CAST(sign AS INTEGER) AS sign FROM moved""")
def contract_loops(spark, d):
    held = _loops(spark).select((F.col("eid") % 3).alias("p"), "loop_id", "pos", "eid", "sign")
    m = _dual(spark)[1].select((F.col("eid") % 3).alias("p"), "eid", F.floor(F.col("eid") % 3 / 2).alias("q"), F.col("eid").alias("ceid"), F.when(F.col("eid") % 5 == 0, -1).otherwise(1).alias("csign"))
    return contract.contract_loops(held, m)


@query(f"""WITH {DUAL}, {LOOPS}, e AS (SELECT loop_id, src AS v, sign AS s FROM lp JOIN dual USING (eid) UNION ALL SELECT loop_id, dst, -sign FROM lp JOIN dual USING (eid)),
z AS (SELECT loop_id, v, sum(s) AS s FROM e GROUP BY 1, 2) SELECT loop_id, (SELECT count(*) FROM lp WHERE lp.loop_id = z.loop_id) AS length, max(abs(s)) = 0 AS closed FROM z GROUP BY loop_id""")
def loop_table(spark, d):
    return loops.loop_table(_loops(spark), _dual(spark)[1])


@query(f"WITH {DUAL} SELECT eid AS i, CAST(dst % {K} - src % {K} AS DOUBLE) AS x FROM dual WHERE dst >= 0")
def preserved_flow(spark, d):
    pos = spark.range(K * K).select(F.col("id").alias("vid"), F.array((F.col("id") % K).cast("double"), F.floor(F.col("id") / K).cast("double")).alias("pos"))
    return loops.preserved(_dual(spark)[1], pos, 0)


# --- composed operators and smoothers on the grid of 16 by 16
SIDE = 16
GRID = f"{grid_sql(SIDE)}, adj AS (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges), A AS (SELECT src AS i, dst AS j, -w AS v FROM adj UNION ALL SELECT src, src, sum(w) + 1 FROM adj GROUP BY src)"


def _grid(spark) -> DataFrame:
    return graphs.laplacian(graphs.grid(spark, SIDE).edges, 1.0)


def _chess(i):
    return ((i % SIDE + F.floor(i / SIDE)) % 2).cast("int")


def _composed(spark):
    a = staged(_grid(spark), "a")
    even = a.where("i = j and i % 2 = 0").select("i")
    return (2.0 * Matrix(a) + Projection(even)) @ Matrix(a).T, a


@query(f"""WITH {GRID}, S AS (SELECT i, j, 2 * v AS v FROM A UNION ALL SELECT i, i, 1.0 FROM A WHERE i = j AND i % 2 = 0)
SELECT S.i, A.i AS j, sum(S.v * A.v) AS v FROM S JOIN A ON A.j = S.j GROUP BY 1, 2""")
def operator_matrix(spark, d):
    return _composed(spark)[0].to_matrix()


@query(f"""WITH {GRID}, X AS (SELECT i, CAST(i % 7 + 1 AS DOUBLE) AS x FROM A WHERE i = j), Y AS (SELECT A.j AS i, sum(A.v * x) AS x FROM A JOIN X ON X.i = A.i GROUP BY 1),
Z AS (SELECT A.i, sum(2 * A.v * x) AS x FROM A JOIN Y ON Y.i = A.j GROUP BY 1) SELECT Z.i, Z.x + CASE WHEN Z.i % 2 = 0 THEN Y.x ELSE 0 END AS x FROM Z JOIN Y USING (i)""")
def operator_apply(spark, d):
    op, a = _composed(spark)
    return op.apply(vector_of(a))


@query(f"""WITH {GRID}, B AS (SELECT i, CAST(i % 7 + 1 AS DOUBLE) AS b, v AS d, (i % {SIDE} + i // {SIDE}) % 2 AS c FROM A WHERE i = j),
x0 AS (SELECT i, b / d AS x FROM B WHERE c = 0), x1 AS (SELECT B.i, (any_value(b) - sum(A.v * x0.x)) / any_value(d) AS x FROM B JOIN A ON A.i = B.i JOIN x0 ON x0.i = A.j WHERE c = 1 GROUP BY B.i)
SELECT i, round(x, 6) AS x FROM x0 UNION ALL SELECT i, round(x, 6) FROM x1""")
def chess_gs(spark, d):
    """Gauss-Seidel by the two colours of a chess board, from zero."""
    a = staged(_grid(spark), "a")
    colors = a.where("i = j").select("i", _chess(F.col("i")).alias("color"))
    b = vector_of(a)
    return smooth.ColoredGaussSeidel(a, colors, 2).smooth(solve.zero_like(b), b, x_zero=True)[0].select("i", F.round("x", 6).alias("x"))


@query(f"""WITH {GRID}, V AS (SELECT i AS n, v AS d, (i % {SIDE} + i // {SIDE}) % 2 AS c FROM A WHERE i = j),
B AS (SELECT n, d, c, CAST(2 * n % 7 + 1 AS DOUBLE) AS b0, CAST((2 * n + 1) % 7 + 1 AS DOUBLE) AS b1 FROM V),
x0 AS (SELECT n, (2 * b0 - b1) / (3 * d) AS y0, (2 * b1 - b0) / (3 * d) AS y1 FROM B WHERE c = 0),
r1 AS (SELECT B.n, any_value(d) AS d, any_value(b0) - sum(A.v * (2 * y0 + y1)) AS b0, any_value(b1) - sum(A.v * (y0 + 2 * y1)) AS b1 FROM B JOIN A ON A.i = B.n JOIN x0 ON x0.n = A.j WHERE c = 1 GROUP BY B.n),
x AS (SELECT n, y0, y1 FROM x0 UNION ALL SELECT n, (2 * b0 - b1) / (3 * d), (2 * b1 - b0) / (3 * d) FROM r1)
SELECT 2 * n AS i, round(y0, 6) AS x FROM x UNION ALL SELECT 2 * n + 1, round(y1, 6) FROM x""")
def dyn_block_gs(spark, d):
    """Two components at each vertex, coupled by [[2, 1], [1, 2]]: the matrix's own blocks are the vertices."""
    pair = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(w).alias("w")) for r, c, w in ((0, 0, 2.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 2.0))])).alias("e")
    a = _grid(spark).select("i", "j", "v", pair).select((F.col("i") * 2 + F.col("e.r")).alias("i"), (F.col("j") * 2 + F.col("e.c")).alias("j"), (F.col("v") * F.col("e.w")).alias("v"))
    a = staged(a, "a")
    colors = a.where("i = j and i % 2 = 0").select(F.col("i").alias("block_id"), _chess(F.floor(F.col("i") / 2)).alias("color"))
    b = vector_of(a)
    return smooth.DynamicBlockGaussSeidel(a, colors=colors).smooth(solve.zero_like(b), b, x_zero=True)[0].select("i", F.round("x", 6).alias("x"))


@query(f"""WITH {GRID}, D AS (SELECT i, v AS d FROM A WHERE i = j), G AS (SELECT A.i, sum(abs(v) / sqrt(p.d * q.d)) AS s FROM A JOIN D p ON p.i = A.i JOIN D q ON q.i = A.j WHERE A.i // 2 <> A.j // 2 GROUP BY 1),
M AS (SELECT D.i, d * greatest(1.0, 0.51 * (1 + coalesce(s, 0))) AS d, CAST(D.i % 7 + 1 AS DOUBLE) AS b FROM D LEFT JOIN G USING (i)),
P AS (SELECT x.i AS i, y.i AS k, x.d AS dx, y.d AS dy, x.b AS fx, y.b AS fy, -1.0::DOUBLE AS o FROM M x JOIN M y ON x.i // 2 = y.i // 2 AND x.i <> y.i)
SELECT i, round((dy * fx - o * fy) / (dx * dy - o * o), 6) AS x FROM P""")
def hybrid_direct(spark, d):
    """The inverse of each pair of neighbours, with the larger diagonal."""
    a = staged(_grid(spark), "a")
    b = vector_of(a)
    s = smooth.HybridDirect(a, a.where("i = j").select("i", F.floor(F.col("i") / 2).alias("p")))
    return s.smooth(solve.zero_like(b), b, x_zero=True)[0].select("i", F.round("x", 6).alias("x"))


@query(f"""WITH {GRID}, D AS (SELECT i, v AS d FROM A WHERE i = j), G AS (SELECT A.i, sum(abs(v) / sqrt(p.d * q.d)) AS s FROM A JOIN D p ON p.i = A.i JOIN D q ON q.i = A.j WHERE A.i // 2 <> A.j // 2 GROUP BY 1),
M AS (SELECT D.i, d * greatest(1.0, 0.51 * (1 + coalesce(s, 0))) AS d, CAST(D.i % 7 + 1 AS DOUBLE) AS b FROM D LEFT JOIN G USING (i))
SELECT x.i, round(CASE WHEN x.i % 2 = 0 THEN x.b / x.d ELSE (x.b + y.b / y.d) / x.d END, 6) AS x FROM M x JOIN M y ON x.i // 2 = y.i // 2 AND x.i <> y.i""")
def hybrid_pairs(spark, d):
    """Gauss-Seidel inside pairs of neighbours, with the larger diagonal."""
    a = staged(_grid(spark), "a")
    b = vector_of(a)
    s = smooth.HybridGaussSeidel(a, a.where("i = j").select("i", F.floor(F.col("i") / 2).alias("p")))
    return s.smooth(solve.zero_like(b), b, x_zero=True)[0].select("i", F.round("x", 6).alias("x"))


# --- vector-valued problems
@query("""WITH f AS (SELECT range AS f, range // 3 AS c, CAST(range % 4 AS DOUBLE) AS x, CAST(range // 4 AS DOUBLE) AS y FROM range(24)), m AS (SELECT c, avg(x) AS x, avg(y) AS y FROM f GROUP BY c),
e AS (SELECT f.f, f.c, f.x - m.x AS dx, f.y - m.y AS dy FROM f JOIN m USING (c)), p AS (
SELECT 2 * f AS i, 3 * c AS j, 1.0::DOUBLE AS v FROM e UNION ALL SELECT 2 * f + 1, 3 * c + 1, 1.0 FROM e UNION ALL SELECT 2 * f, 3 * c + 2, -dy FROM e UNION ALL SELECT 2 * f + 1, 3 * c + 2, dx FROM e)
SELECT i, j, round(v, 6) AS v FROM p WHERE v <> 0""")
def rigid_prolongation(spark, d):
    """Displacements from the rigid motions of clusters of three."""
    pos = spark.range(24).select(F.col("id").alias("vid"), F.array((F.col("id") % 4).cast("double"), F.floor(F.col("id") / 4).cast("double")).alias("pos"))
    vmap = spark.range(24).select(F.col("id").alias("f"), F.floor(F.col("id") / 3).alias("c"))
    return vectorial.rigid_prolongation(vmap, pos, elastic.coarse_positions(pos, vmap, 2), 2, False).select("i", "j", F.round("v", 6).alias("v"))


@query("SELECT i, round(0.0::DOUBLE, 6) AS x FROM (SELECT range AS i FROM range(2 * 21 * 5))")
def beam_rigid(spark, d):
    """A free beam's matrix times a rigid motion: zero."""
    a, pos = vectorial.beam(spark, 20, 4, clamped=False)
    x, y = F.get("pos", F.lit(0)), F.get("pos", F.lit(1))
    r = pos.select("vid", F.explode(F.array(F.struct(F.lit(0).alias("k"), (1.0 - 0.5 * y).alias("x")), F.struct(F.lit(1).alias("k"), (2.0 + 0.5 * x).alias("x")))).alias("e")).select((F.col("vid") * 2 + F.col("e.k")).alias("i"), "e.x")
    return linalg.spmv(a, r).select("i", (F.round("x", 6) + F.lit(0.0)).alias("x"))


@query()
def elast_2d_summary(spark, d):
    a, pos = vectorial.beam(spark, 40, 4)
    return hier.build_hierarchy(a, "elast_2d", positions=pos).summary(spark)


@query()
def h1_2d_summary(spark, d):
    """Two components on the whole co-purchase graph."""
    o = Options(max_coarse_size=100)
    return hier.build_hierarchy(whole_laplacian(spark, d, o, copies=2), "h1_2d", options=o).summary(spark)


@query()
def level_steps(spark, d):
    """The goals of the steps on the whole co-purchase graph, and the tasks of the levels."""
    o = Options(max_coarse_size=100)
    return hier.build(whole_laplacian(spark, d, o), o).steps(spark)


@query()
def kernel_errors(spark, d):
    """Constants are in the kernel of a Laplacian, on every level of piecewise prolongations."""
    o = Options.of(max_coarse_size=100, prol_type="piecewise", max_levels=3)
    h = hier.build(whole_laplacian(spark, d, o, 0.0), o)
    return h.kernel_errors(h.vector(0, 1.0)).select("level", F.round("err", 6).alias("err"))


@query()
def two_level(spark, d):
    a = graphs.laplacian(graphs.grid(spark, SIDE).edges, 0.01)
    lo, hi, ratio = solve.two_level_bounds(hier.build(a, Options(max_coarse_size=20)))
    return spark.createDataFrame([(round(lo, 4), round(hi, 4), round(ratio, 4))], "lo double, hi double, ratio double")


__all__ = ["ORACLE_SQL", "QUERIES"]
