"""Queries on small meshes of squares: dual graphs, loops, potential matrices, elastic block data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.operators import elastic, linalg, loops
from gridweave.plans import hierarchy as hier
from gridweave.queries.graph_queries import ORACLE_SQL, QUERIES, graph_of, grid_sql, held_edges, query
from gridweave.session import staged
from gridweave.sources import graphs

K = 20
#: Cells are numbered by rows; the facet to the right of cell c is 2c, the one above it 2c + 1.
FACETS = f"""ids AS (SELECT range AS c FROM range({K * K})), facets AS (
SELECT 2 * c AS eid, c AS a, CASE WHEN c % {K} < {K - 1} THEN c + 1 END AS b, CASE WHEN c % {K} = {K - 1} THEN 1 END AS boundary FROM ids UNION ALL
SELECT 2 * c + 1, c, CASE WHEN c // {K} < {K - 1} THEN c + {K} END, CASE WHEN c // {K} = {K - 1} THEN 2 END FROM ids)"""
DUAL = f"{FACETS}, dual AS (SELECT eid, a AS src, coalesce(b, -1 - boundary) AS dst FROM facets)"
#: Around the node above and to the right of cell c: right of c, above c + 1, right of c + K (backwards), above c (backwards).
LOOPS = f"""lp AS (SELECT c AS loop_id, pos, CASE pos WHEN 0 THEN 2 * c WHEN 1 THEN 2 * (c + 1) + 1 WHEN 2 THEN 2 * (c + {K}) ELSE 2 * c + 1 END AS eid,
CASE WHEN pos < 2 THEN 1 ELSE -1 END AS sign FROM ids, range(4) t(pos) WHERE c % {K} < {K - 1} AND c // {K} < {K - 1})"""


def _facets(spark) -> DataFrame:
    c = F.col("id")
    ids = spark.range(K * K)
    right = ids.select((2 * c).alias("eid"), c.alias("a"), F.when(c % K < K - 1, c + 1).alias("b"), F.when(c % K == K - 1, 1).alias("boundary"))
    above = ids.select((2 * c + 1).alias("eid"), c.alias("a"), F.when(c < K * (K - 1), c + K).alias("b"), F.when(c >= K * (K - 1), 2).alias("boundary"))
    return right.unionByName(above)


def _dual(spark) -> tuple[DataFrame, DataFrame]:
    return loops.dual_graph(_facets(spark), spark.range(K * K).select(F.col("id").alias("vid"), F.lit(1.0).alias("vol")))


def _loops(spark) -> DataFrame:
    c = F.col("id")
    steps = F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), e.cast("long").alias("eid"), F.lit(s).alias("sign")) for p, (e, s) in enumerate(((2 * c, 1), (2 * (c + 1) + 1, 1), (2 * (c + K), -1), (2 * c + 1, -1)))])).alias("s")
    return spark.range(K * K).where((c % K < K - 1) & (c < K * (K - 1))).select(c.alias("loop_id"), steps).select("loop_id", "s.pos", "s.eid", "s.sign")


@query(f"WITH {DUAL} SELECT c AS vid, 1.0::DOUBLE AS vol, 'real' AS kind FROM ids UNION ALL SELECT DISTINCT dst, dst::DOUBLE, 'fictitious' FROM dual WHERE dst < 0")
def dual_vertices(spark, d):
    return _dual(spark)[0]


@query(f"WITH {DUAL} SELECT eid, src, dst FROM dual")
def dual_edges(spark, d):
    return _dual(spark)[1]


@query(f"WITH {FACETS}, {LOOPS} SELECT eid AS i, loop_id AS j, sum(sign)::DOUBLE AS v FROM lp GROUP BY 1, 2")
def loops_curl(spark, d):
    return loops.curl(_loops(spark))


@query(f"WITH {DUAL} SELECT src AS i, eid AS j, 1.0::DOUBLE AS v FROM dual WHERE src >= 0 UNION ALL SELECT dst, eid, -1.0::DOUBLE FROM dual WHERE dst >= 0")
def divergence_matrix(spark, d):
    return loops.divergence(_dual(spark)[1])


@query(f"WITH {FACETS}, {LOOPS}, c AS (SELECT eid AS i, loop_id AS j, sum(sign)::DOUBLE AS v FROM lp GROUP BY 1, 2) SELECT a.j AS i, b.j, sum(a.v * b.v * (1 + a.i % 3)) AS v FROM c a JOIN c b ON a.i = b.i GROUP BY 1, 2")
def potential_matrix(spark, d):
    """curl' A curl with a diagonal A."""
    a = _facets(spark).select(F.col("eid").alias("i"), F.col("eid").alias("j"), (1 + F.col("eid") % 3).cast("double").alias("v"))
    return linalg.rap(a, staged(loops.curl(_loops(spark)), "curl"))


@query(f"WITH {FACETS}, n AS (SELECT eid, 1 + eid % 4 AS ndof FROM facets) SELECT eid, ndof, CAST(coalesce(sum(ndof) OVER (ORDER BY eid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM n")
def edge_offsets(spark, d):
    return loops.edge_offsets(_facets(spark).select("eid", (1 + F.col("eid") % 4).alias("ndof")))


@query()
def facet_loops(spark, d):
    return loops.facet_loops(_dual(spark)[1], _loops(spark).select(F.col("loop_id").alias("node"), "eid"))


@query()
def map_loops(spark, d):
    """On clusters of two by two cells."""
    cell = lambda v: F.floor(v % K / 2) + F.floor(v / K / 2) * (K // 2)
    e = _dual(spark)[1].where("dst >= 0")
    a, b = cell(F.col("src")), cell(F.col("dst"))
    m = e.select("eid", F.when(a != b, F.least(a, b) * 10_000 + F.greatest(a, b)).cast("long").alias("ceid"), F.when(a < b, 1).otherwise(-1).alias("csign"))
    return loops.map_loops(_loops(spark), m)


def _beam(spark) -> tuple[DataFrame, DataFrame]:
    g = graphs.grid(spark, 10)
    t = g.edges.join(g.vertices.select(F.col("vid").alias("src"), F.col("pos").alias("a")), "src").join(g.vertices.select(F.col("vid").alias("dst"), F.col("pos").alias("b")), "dst")
    x, y = (F.get("b", F.lit(k)) - F.get("a", F.lit(k)) for k in (0, 1))
    z = F.lit(0.0)
    return t.select("src", "dst", F.array(x * x + 0.1, x * y, z, x * y, y * y + 0.1, z, z, z, F.lit(0.05)).alias("emat")), g.vertices.select("vid", "pos")


@query()
def elastic_coarse_edges(spark, d):
    edges, pos = _beam(spark)
    vmap = pos.select(F.col("vid").alias("f"), F.when(F.col("vid") % 10 > 0, F.floor(F.col("vid") / 2)).cast("long").alias("c"))
    return elastic.coarse_edge_matrices(edges, pos, vmap)[0].select("src", "dst", F.transform("emat", lambda v: F.round(v, 6)).alias("emat"))


@query()
def robust_soc(spark, d):
    return elastic.robust_soc(*_beam(spark)).select("src", "dst", F.round("soc", 6).alias("soc"))


@query()
def graph_partition(spark, d):
    e = held_edges(spark, d, 1)
    g = graph_of(e)
    clusters = staged(hier.clusters_of(0, g, hier.Options()).where("c is not null"), "clusters")
    return elastic.partition(g.vertices, clusters, 4)


@query(f"WITH {grid_sql(16)}, v AS (SELECT id AS i, CAST(id % 5 AS DOUBLE) AS x FROM ids) SELECT 0 AS space, i // 2 AS i, sum(x) AS x FROM v GROUP BY 2 UNION ALL SELECT 1, i // 4, sum(2 * x) FROM v GROUP BY 2")
def multi_restrict(spark, d):
    """Two spaces at once; the second has a coarser map and another vector."""
    i = spark.range(256).select(F.col("id").alias("i"))
    p = [i.select("i", F.floor(F.col("i") / n).alias("j"), F.lit(1.0).alias("v")) for n in (2, 4)]
    x = [i.select("i", (k * (F.col("i") % 5)).cast("double").alias("x")) for k in (1, 2)]
    a, b = elastic.multi_transfer(p, x)
    return a.select(F.lit(0).alias("space"), "i", "x").unionByName(b.select(F.lit(1).alias("space"), "i", "x"))


__all__ = ["ORACLE_SQL", "QUERIES"]
