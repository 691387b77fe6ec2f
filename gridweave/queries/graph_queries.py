"""Queries on the co-purchase graph and on grids, with the SQL that computes the same.

Weights are small integers, so sums are exact in any order; other results are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.operators import cluster, coarsen, linalg, prolong, reach, weights
from gridweave.plans import hierarchy as hier
from gridweave.plans import bulk, smooth, solve, vectorial
from gridweave.session import staged
from gridweave.sources import graphs
from gridweave.sources.graphs import Graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Least weight of the edges in the queries that SQL checks; those without SQL, and the ``_whole`` form of each other, take all.
LEAST = 2
_least: ContextVar[int] = ContextVar("least", default=LEAST)


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def edges_of(spark: SparkSession, d: str, least: int | None = None) -> DataFrame:
    return graphs.copurchase(table(spark, d, "lineitem"), _least.get() if least is None else least)


def held_edges(spark: SparkSession, d: str, least: int | None = None) -> DataFrame:
    """The edges, staged: several branches of one plan read them."""
    return staged(edges_of(spark, d, least), "copurchase")


def graph_of(edges: DataFrame) -> Graph:
    """Every 7th vertex weighs 1, every 11th isn't free."""
    v = graphs.vertices_of(edges)
    v = v.withColumn("w", (F.col("vid") % 7 == 0).cast("double")).withColumn("free", F.col("vid") % 11 != 0)
    return Graph(v, edges)


def matrix_of(edges: DataFrame) -> DataFrame:
    return graphs.laplacian(edges, 1.0)


def whole_laplacian(spark: SparkSession, d: str, o: hier.Options, shift: float = 1.0, copies: int = 1) -> DataFrame | bulk.Source:
    """The matrix of all edges, as blocks if its vertices are few enough for these options; once for each of ``copies`` components."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
    if (held := bulk.copurchase(lines, 1, shift, o, copies)) is not None:
        return held
    a = graphs.laplacian(held_edges(spark, d, 1), shift)
    return vectorial.repeated(a, copies) if copies > 1 else a


def held_laplacian(spark: SparkSession, d: str, shift: float = 1.0) -> bulk.Source | None:
    """``matrix_of(edges_of(spark, d))`` as blocks of rows, if its vertices are few enough and there is one."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
    return bulk.copurchase(lines, _least.get(), shift, hier.Options())


def vector_of(a: DataFrame) -> DataFrame:
    return a.where("i = j").select("i", (F.col("i") % 7 + 1).cast("double").alias("x"))


def vmap_of(edges: DataFrame) -> DataFrame:
    """A map that SQL can write down: vertices by thirds, every 11th dropped."""
    return graphs.vertices_of(edges).select(F.col("vid").alias("f"), F.when(F.col("vid") % 11 != 0, F.floor(F.col("vid") / 3)).cast("long").alias("c"))


# --- pieces of SQL
COP = """op AS (SELECT DISTINCT l_orderkey o, l_partkey p FROM lineitem),
edges0 AS (SELECT a.p AS src, b.p AS dst, CAST(count(*) AS DOUBLE) AS w FROM op a JOIN op b ON a.o = b.o AND a.p < b.p GROUP BY 1, 2)"""
EDGES = f"{COP}, edges AS (SELECT * FROM edges0 WHERE w >= {LEAST}), adj AS (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges)"
VERTS = "verts AS (SELECT DISTINCT src AS vid, CAST(src % 7 = 0 AS DOUBLE) AS w, 1.0::DOUBLE AS cnt, src % 11 <> 0 AS free FROM adj)"
MATRIX = f"{EDGES}, A AS (SELECT src AS i, dst AS j, -w AS v FROM adj UNION ALL SELECT src, src, sum(w) + 1 FROM adj GROUP BY src), X AS (SELECT i, CAST(i % 7 + 1 AS DOUBLE) AS x FROM A WHERE i = j)"
VMAP = "vmap AS (SELECT DISTINCT src AS f, CASE WHEN src % 11 <> 0 THEN src // 3 END AS c FROM adj)"
DATA = "data AS (SELECT v.vid, coalesce(s, 0) + v.w AS d, greatest(coalesce(m, 0), v.w) AS max_od, v.cnt FROM verts v LEFT JOIN (SELECT src, sum(w) s, max(w) m FROM adj GROUP BY src) g ON g.src = v.vid)"
P = "P AS (SELECT f AS i, c AS j, 1.0::DOUBLE AS v FROM vmap WHERE c IS NOT NULL)"


def soc_sql(expr: str) -> str:
    return f"soc AS (SELECT e.src, e.dst, e.w, CASE WHEN {expr} > 0 THEN e.w / ({expr}) ELSE 0 END AS soc FROM edges e JOIN data a ON a.vid = e.src JOIN data b ON b.vid = e.dst)"


GEOM = soc_sql("sqrt(a.max_od * b.max_od)")
STRONG = """bth AS (SELECT src, dst, w, soc FROM soc UNION ALL SELECT dst, src, w, soc FROM soc),
strong AS (SELECT src, dst, w, soc FROM (SELECT *, max(soc) OVER (PARTITION BY src) AS best FROM bth) WHERE soc >= 0.25 * best AND soc >= 0.025)"""


def tie(a: str, b: str) -> str:
    lo, hi = f"(least({a}, {b}) % 1000003)", f"(greatest({a}, {b}) % 1000003)"
    return f"(({lo} * 7919 + {hi} * 104729 + ({lo} * {hi} % 1000003) * 31) % 1000003)"


def handshake_sql(source: str, rounds: int, tag: str = "") -> str:
    """CTEs open{tag}_k and pairs{tag}_k of the rounds, and pairs{tag} of all."""
    parts, now = [], source
    for k in range(rounds):
        parts.append(f"""choice{tag}_{k} AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY soc DESC, {tie('src', 'dst')}, least(src, dst), greatest(src, dst)) AS r FROM {now}) WHERE r = 1),
pairs{tag}_{k} AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM choice{tag}_{k} GROUP BY 1, 2 HAVING count(*) = 2),
open{tag}_{k} AS (SELECT src, dst, soc FROM {now} WHERE src NOT IN (SELECT a FROM pairs{tag}_{k} UNION ALL SELECT b FROM pairs{tag}_{k}) AND dst NOT IN (SELECT a FROM pairs{tag}_{k} UNION ALL SELECT b FROM pairs{tag}_{k}))""")
        now = f"open{tag}_{k}"
    return ",\n".join(parts) + f",\npairs{tag} AS (" + " UNION ALL ".join(f"SELECT a, b FROM pairs{tag}_{k}" for k in range(rounds)) + ")"


def grid_sql(k: int, name: str = "edges") -> str:
    return f"ids AS (SELECT range AS id FROM range({k * k})), {name} AS (SELECT id AS src, id + 1 AS dst, 1.0::DOUBLE AS w FROM ids WHERE id % {k} < {k - 1} UNION ALL SELECT id, id + {k}, 1.0::DOUBLE FROM ids WHERE id // {k} < {k - 1})"


# --- sources
@query(f"WITH {COP} SELECT src, dst, w FROM edges0")
def g_copurchase_edges(spark, d):
    return edges_of(spark, d, 1)


@query(f"WITH {grid_sql(40)} SELECT src, dst, CASE WHEN (src // 40 // 4) % 2 = 1 AND (dst // 40 // 4) % 2 = 1 THEN 100.0 ELSE w END AS w FROM edges")
def g_grid_edges(spark, d):
    return graphs.grid(spark, 40, jump=100.0).edges


@query("WITH s AS (SELECT DISTINCT user_id u, event_type t, date_trunc('hour', ts) h FROM events) SELECT a.u AS src, b.u AS dst, CAST(count(*) AS DOUBLE) AS w FROM s a JOIN s b ON a.t = b.t AND a.h = b.h AND a.u < b.u GROUP BY 1, 2")
def g_user_edges(spark, d):
    return graphs.user_user(table(spark, d, "events"))


@query(f"WITH {MATRIX} SELECT i, j, v FROM A")
def lap_matrix(spark, d):
    return matrix_of(edges_of(spark, d))


@query(f"WITH {MATRIX} SELECT least(i, j) AS src, greatest(i, j) AS dst, CAST(1 AS DOUBLE) AS w FROM A WHERE i < j")
def graph_topology(spark, d):
    return weights.topology(matrix_of(edges_of(spark, d))).edges


@query(f"WITH {MATRIX} SELECT i AS src, j AS dst, abs(v) AS w FROM A WHERE i < j")
def edge_weights(spark, d):
    return weights.algebraic(matrix_of(edges_of(spark, d))).edges


@query(f"WITH {MATRIX} SELECT i AS vid, abs(sum(v)) AS w, 1.0::DOUBLE AS cnt FROM A GROUP BY i")
def vertex_weights(spark, d):
    return weights.algebraic(matrix_of(edges_of(spark, d))).vertices.select("vid", "w", "cnt")


@query(f"WITH {MATRIX}, T AS (SELECT i // 2 AS i, j // 2 AS j, sum(v) AS v FROM A WHERE i % 2 = j % 2 GROUP BY 1, 2) SELECT i AS src, j AS dst, abs(v) AS w FROM T WHERE i < j")
def edge_weights_blocked(spark, d):
    a = matrix_of(edges_of(spark, d))
    dofs = weights.dof_subset(a.select("i").distinct(), block=2)
    return weights.algebraic_blocked(a, dofs).edges


@query(f"WITH {EDGES} SELECT src, dst, 1.0::DOUBLE AS w FROM edges")
def trivial_weights(spark, d):
    return weights.trivial(graph_of(edges_of(spark, d))).edges


def _elements(edges: DataFrame) -> DataFrame:
    w, s = F.col("w"), F.col("w") + F.lit(0.5)
    return edges.select(F.array("src", "dst").alias("dofs"), F.array(s, -w, -w, s).alias("mat"))


@query(f"WITH {EDGES} SELECT src AS vid, sum(0.5)::DOUBLE AS w FROM adj GROUP BY src")
def element_vertex_weights(spark, d):
    return weights.element_row_sums(_elements(edges_of(spark, d)))[0]


@query(f"WITH {EDGES} SELECT src, dst, w FROM edges")
def element_edge_weights(spark, d):
    return weights.element_row_sums(_elements(edges_of(spark, d)))[1]


@query()
def element_schur_edges(spark, d):
    return weights.element_schur(_elements(edges_of(spark, d, 1)))[1]


@query(f"WITH {EDGES}, ids AS (SELECT DISTINCT src AS i FROM adj) SELECT i, i // 3 AS vid, CAST(i % 3 AS INTEGER) AS comp FROM ids WHERE (i < 500 OR i >= 900) AND i % 5 <> 0")
def dof_subset(spark, d):
    ids = graphs.vertices_of(edges_of(spark, d)).select(F.col("vid").alias("i"))
    return weights.dof_subset(ids, [(0, 500), (900, 10**9)], ids.where("i % 5 <> 0"), 3)


@query(f"WITH {EDGES}, ids AS (SELECT DISTINCT src AS i FROM adj) SELECT i, (999999 - i // 3) * 3 + i % 3 AS j, 1.0::DOUBLE AS v FROM ids")
def embedding_matrix(spark, d):
    ids = graphs.vertices_of(edges_of(spark, d)).select(F.col("vid").alias("i"))
    subset = weights.dof_subset(ids, block=3)
    return weights.embedding(subset, subset.select(F.col("vid").alias("f"), (999999 - F.col("vid")).alias("c")).distinct(), 3)


@query(f"WITH {EDGES}, m AS (SELECT src, dst, w, 1.0::DOUBLE AS tx, 0.0::DOUBLE AS ty FROM edges) SELECT src, dst, [w * 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS emat FROM m")
def elasticity_edges(spark, d):
    e = edges_of(spark, d)
    blocks = e.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.array(-2.0 * F.col("w"), F.lit(0.0), F.lit(0.0), F.lit(-5.0)).alias("v"))
    pos = graphs.vertices_of(e).select("vid", F.array(F.col("vid").cast("double"), F.lit(0.0)).alias("pos"))
    return weights.elasticity_edges_2d(blocks, pos)


# --- filters
@query(f"WITH {EDGES}, {VERTS} SELECT vid FROM verts WHERE free")
def free_vertices(spark, d):
    return graph_of(edges_of(spark, d)).vertices.where("free").select("vid")


@query(f"WITH {EDGES}, {VERTS} SELECT p_partkey AS vid FROM part WHERE p_partkey NOT IN (SELECT vid FROM verts)")
def drop_isolated(spark, d):
    e = edges_of(spark, d)
    v = table(spark, d, "part").select(F.col("p_partkey").alias("vid"))
    return weights.isolated(Graph(v, e))


@query(f"WITH {EDGES}, {VERTS}, g AS (SELECT src, sum(w) s, max(w) m FROM adj GROUP BY src) SELECT vid FROM verts v JOIN g ON g.src = v.vid WHERE v.w > 0.15 * (s + v.w) AND v.w > 0.25 * m")
def drop_l2_dominant(spark, d):
    return weights.drop_l2_dominant(graph_of(edges_of(spark, d)), 0.15)


# --- aggregates
@query(f"WITH {EDGES}, {VERTS}, {DATA} SELECT vid, d, max_od, cnt FROM data")
def aux_diag_maxod(spark, d):
    return weights.aux_diagonal(graph_of(edges_of(spark, d)))


@query(f"WITH {EDGES}, {VERTS}, e AS (SELECT src AS i, src AS j, w AS v FROM adj UNION ALL SELECT src, dst, -w FROM adj UNION ALL SELECT vid, vid, w FROM verts) SELECT i, j, sum(v) AS v FROM e GROUP BY 1, 2")
def aux_matrix(spark, d):
    return weights.aux_matrix(graph_of(edges_of(spark, d)))


@query(f"""WITH {EDGES}, {VERTS}, {VMAP}, u AS (SELECT c, w, cnt FROM verts JOIN vmap ON f = vid WHERE c IS NOT NULL UNION ALL
SELECT a.c, w, 0 FROM adj JOIN vmap a ON a.f = src LEFT JOIN vmap b ON b.f = dst WHERE a.c IS NOT NULL AND b.c IS NULL) SELECT c AS vid, sum(w) AS w, sum(cnt) AS cnt FROM u GROUP BY c""")
def coarse_vertices(spark, d):
    e = held_edges(spark, d)
    return coarsen.coarse_vertices(graph_of(e), vmap_of(e)).select("vid", "w", "cnt")


@query(f"WITH {EDGES}, {VMAP} SELECT least(a.c, b.c) AS src, greatest(a.c, b.c) AS dst, sum(w) AS w FROM edges JOIN vmap a ON a.f = src JOIN vmap b ON b.f = dst WHERE a.c <> b.c GROUP BY 1, 2")
def coarse_edges(spark, d):
    e = held_edges(spark, d)
    return coarsen.coarse_edges(e, vmap_of(e))


@query(f"WITH {EDGES}, {VMAP} SELECT src, dst, w, CASE WHEN a.c <> b.c THEN least(a.c, b.c) END AS csrc, CASE WHEN a.c <> b.c THEN greatest(a.c, b.c) END AS cdst FROM edges LEFT JOIN vmap a ON a.f = src LEFT JOIN vmap b ON b.f = dst")
def map_edges(spark, d):
    e = held_edges(spark, d)
    return coarsen.map_edges(e, vmap_of(e))


@query(f"WITH {EDGES}, {VMAP} SELECT f, CASE WHEN c IS NOT NULL THEN dense_rank() OVER (ORDER BY c NULLS LAST) - 1 END AS c FROM vmap")
def map_vertices(spark, d):
    return coarsen.map_vertices(staged(vmap_of(edges_of(spark, d)), "vmap"))


@query(f"WITH {EDGES}, {VMAP} SELECT c, list(f ORDER BY f) AS members FROM vmap WHERE c IS NOT NULL GROUP BY c")
def reverse_map(spark, d):
    return coarsen.reverse_map(vmap_of(edges_of(spark, d)))


@query(f"WITH {EDGES}, {VMAP} SELECT f, c // 2 AS c FROM vmap")
def concatenate_maps(spark, d):
    m = vmap_of(edges_of(spark, d))
    second = m.where("c is not null").select(F.col("c").alias("f"), F.floor(F.col("c") / 2).alias("c")).distinct()
    return coarsen.concatenate(m, second)


@query(f"WITH {EDGES} SELECT src AS key, sum(w) AS total, max(w) AS largest, count(*) AS n FROM adj GROUP BY src")
def reduce_table(spark, d):
    t = graphs.adjacency(edges_of(spark, d)).withColumnRenamed("src", "key")
    return coarsen.reduce_table(t, "key", total=F.sum("w"), largest=F.max("w"), n=F.count(F.lit(1)))


@query(f"WITH {EDGES}, ids AS (SELECT DISTINCT src AS vid FROM adj) SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS number FROM ids")
def enumerate_dofs(spark, d):
    return graphs.enumerate_rows(graphs.vertices_of(edges_of(spark, d)).select("vid"), "vid", "number").select("vid", F.col("number").cast("long").alias("number"))


@query(f"""WITH {EDGES}, {VMAP}, v AS (SELECT DISTINCT src AS vid, 1.0::DOUBLE AS w, CASE WHEN src % 13 = 0 THEN -CAST(src AS DOUBLE) ELSE 2.0 END AS vol FROM adj)
SELECT c AS vid, sum(w) AS w, coalesce(arg_min(vol, vid) FILTER (WHERE vol < 0), sum(vol)) AS vol FROM v JOIN vmap ON f = vid WHERE c IS NOT NULL GROUP BY c""")
def stokes_coarse_vertices(spark, d):
    e = held_edges(spark, d)
    v = graphs.vertices_of(e).select("vid", F.lit(1.0).alias("w"), F.when(F.col("vid") % 13 == 0, -F.col("vid").cast("double")).otherwise(2.0).alias("vol"))
    return coarsen.coarse_stokes(v, e.withColumn("flow", F.col("w")), vmap_of(e))[0]


@query(f"""WITH {EDGES}, {VMAP} SELECT least(a.c, b.c) AS src, greatest(a.c, b.c) AS dst,
sum(CASE WHEN a.c < b.c THEN 1 ELSE -1 END * CASE WHEN (src + dst) % 2 = 0 THEN w ELSE -w END) AS flow FROM edges JOIN vmap a ON a.f = src JOIN vmap b ON b.f = dst WHERE a.c <> b.c GROUP BY 1, 2""")
def stokes_coarse_edges(spark, d):
    e = held_edges(spark, d)
    flow = F.when((F.col("src") + F.col("dst")) % 2 == 0, F.col("w")).otherwise(-F.col("w"))
    v = graphs.vertices_of(e).select("vid", F.lit(1.0).alias("w"), F.lit(2.0).alias("vol"))
    return coarsen.coarse_stokes(v, e.withColumn("flow", flow), vmap_of(e))[1]


# --- strength of connection and clusters
def _data(e: DataFrame) -> DataFrame:
    return weights.aux_diagonal(graph_of(e))


def _soc(kind: str, expr: str) -> None:
    @query(f"WITH {EDGES}, {VERTS}, {DATA}, {soc_sql(expr)} SELECT src, dst, round(soc, 6) AS soc FROM soc")
    def f(spark, d):
        e = held_edges(spark, d)
        return cluster.soc(e, _data(e), kind).select("src", "dst", F.round("soc", 6).alias("soc"))

    QUERIES[f"soc_{kind}"], ORACLE_SQL[f"soc_{kind}"] = QUERIES.pop("f"), ORACLE_SQL.pop("f")


for _kind, _expr in (("geom", "sqrt(a.max_od * b.max_od)"), ("harm", "2 * a.max_od * b.max_od / (a.max_od + b.max_od)"), ("min", "least(a.max_od, b.max_od)"), ("alg", "(a.max_od + b.max_od) / 2"), ("max", "greatest(a.max_od, b.max_od)"), ("hharm", "a.max_od * b.max_od / (a.max_od + b.max_od)")):
    _soc(_kind, _expr)


@query(f"WITH {EDGES}, {VERTS}, {DATA} SELECT src, dst, w, round(w / max_od, 6) AS soc FROM adj JOIN data ON vid = src")
def soc_join(spark, d):
    e = held_edges(spark, d)
    return cluster.soc_join(e, _data(e)).select("src", "dst", "w", F.round("soc", 6).alias("soc"))


@query(f"""WITH {EDGES}, {VERTS}, {DATA}, b AS (SELECT e.src, e.dst, sum(x.w * y.w / (x.w + y.w)) AS b FROM edges e JOIN adj x ON x.src = e.src JOIN adj y ON y.src = e.dst AND y.dst = x.dst GROUP BY 1, 2)
SELECT e.src, e.dst, round((e.w + coalesce(b.b, 0)) / (p.d * q.d / (p.d + q.d)), 6) AS soc FROM edges e LEFT JOIN b ON b.src = e.src AND b.dst = e.dst JOIN data p ON p.vid = e.src JOIN data q ON q.vid = e.dst""")
def soc_robust(spark, d):
    if a := held_laplacian(spark, d, 0.0):
        # the diagonal has the sums of weights; those of vertices are as in graph_of
        data = bulk.whole(a.a, [(lo, x[0]) for lo, x in a.a.also]) + (a.ids % 7 == 0)
        return reach.robust_soc(a, data).select("src", "dst", F.round("soc", 6).alias("soc"))
    e = held_edges(spark, d)
    return cluster.robust_soc_scalar(e, _data(e)).select("src", "dst", F.round("soc", 6).alias("soc"))


@query(f"WITH {EDGES}, {VERTS}, {DATA}, {GEOM}, {STRONG} SELECT src, dst, w, round(soc, 6) AS soc FROM strong")
def strong_edges(spark, d):
    e = held_edges(spark, d)
    return cluster.strong(cluster.soc(e, _data(e))).select("src", "dst", "w", F.round("soc", 6).alias("soc"))


@query(f"WITH {EDGES}, {VERTS}, {DATA}, {GEOM}, {STRONG}, {handshake_sql('strong', 1)} SELECT a, b FROM pairs")
def pair_round0(spark, d):
    e = held_edges(spark, d)
    return cluster.mutual(cluster.strong(cluster.soc(e, _data(e))))


@query(f"WITH {EDGES}, {VERTS}, {DATA}, {GEOM}, {STRONG}, {handshake_sql('strong', 4)} SELECT a, b FROM pairs")
def pair_handshake(spark, d):
    e = held_edges(spark, d)
    return cluster.handshake(staged(cluster.strong(cluster.soc(e, _data(e))), "strong"), 4)


_ORPHANS = f"""pm AS (SELECT vid AS f, coalesce(a, vid) AS c FROM verts LEFT JOIN (SELECT a, a AS m FROM pairs UNION ALL SELECT a, b FROM pairs) ON m = vid),
sz AS (SELECT c, count(*) n FROM pm GROUP BY c), lone AS (SELECT f FROM pm JOIN sz USING (c) WHERE n = 1), rest AS (SELECT f, c FROM pm JOIN sz USING (c) WHERE n > 1),
tied AS (SELECT adj.src, c, sum(adj.w) / any_value(max_od) AS soc FROM adj JOIN data ON vid = adj.src JOIN lone ON lone.f = adj.src JOIN rest ON rest.f = adj.dst GROUP BY 1, 2 HAVING sum(adj.w) / any_value(max_od) >= 0.025),
wish AS (SELECT src, c AS nc FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY soc DESC, {tie('src', 'c')}, c) AS r FROM tied) WHERE r = 1),
joined AS (SELECT pm.f, coalesce(nc, c) AS c FROM pm LEFT JOIN wish ON src = pm.f)"""


@query(f"WITH {EDGES}, {VERTS}, {DATA}, {GEOM}, {STRONG}, {handshake_sql('strong', 3)}, {_ORPHANS} SELECT f, c FROM joined")
def orphan_join(spark, d):
    e = held_edges(spark, d)
    data = staged(_data(e), "data")
    pairs = cluster.handshake(staged(cluster.strong(cluster.soc(e, data)), "strong"), 3)
    return cluster.orphans_join(staged(cluster.pair_map(data.select("vid"), pairs), "pm"), e, data)


_MAPPED = """pm AS (SELECT vid AS f, coalesce(a, vid) AS c FROM verts LEFT JOIN (SELECT a, a AS m FROM pairs UNION ALL SELECT a, b FROM pairs) ON m = vid),
ends AS (SELECT a.c AS ca, b.c AS cb, w FROM edges JOIN pm a ON a.f = src JOIN pm b ON b.f = dst)"""


@query(f"""WITH {EDGES}, {VERTS}, {DATA}, {GEOM}, {STRONG}, {handshake_sql('strong', 2)}, {_MAPPED}
SELECT c AS vid, sum(d) - coalesce(max(inn), 0) AS d, max(max_od) AS max_od, sum(cnt) AS cnt FROM data JOIN pm ON f = vid LEFT JOIN (SELECT ca, sum(w) AS inn FROM ends WHERE ca = cb GROUP BY ca) ON ca = c GROUP BY c""")
def pair_round1_data(spark, d):
    e = held_edges(spark, d)
    data = staged(_data(e), "data")
    pairs = cluster.handshake(staged(cluster.strong(cluster.soc(e, data)), "strong"), 2)
    return cluster.map_data(data, e, cluster.pair_map(data.select("vid"), pairs))[0]


@query(f"""WITH {EDGES}, {VERTS}, {DATA}, {GEOM}, {STRONG}, {handshake_sql('strong', 2)}, {_MAPPED}
SELECT least(ca, cb) AS src, greatest(ca, cb) AS dst, sum(w) AS w FROM ends WHERE ca <> cb GROUP BY 1, 2""")
def pair_round1_edges(spark, d):
    e = held_edges(spark, d)
    data = staged(_data(e), "data")
    pairs = cluster.handshake(staged(cluster.strong(cluster.soc(e, data)), "strong"), 2)
    return cluster.map_data(data, e, cluster.pair_map(data.select("vid"), pairs))[1]


def luby_sql(rounds: int) -> str:
    h = "(((vid % 1000003) * 7919 + (vid % 1000003) * (vid % 1000003) % 1000003 * 31) % 1000003)"
    out = [f"deg AS (SELECT v.vid, {h} AS h, count(a.src) AS deg FROM verts v LEFT JOIN adj a ON a.src = v.vid GROUP BY v.vid), o0 AS (SELECT vid, deg, h FROM deg)"]
    for k in range(rounds):
        out.append(f"""m{k} AS MATERIALIZED (SELECT o.vid FROM o{k} o WHERE NOT EXISTS (SELECT 1 FROM adj a JOIN o{k} q ON q.vid = a.dst WHERE a.src = o.vid AND (q.deg, q.h, q.vid) < (o.deg, o.h, o.vid))),
o{k + 1} AS MATERIALIZED (SELECT * FROM o{k} WHERE vid NOT IN (SELECT vid FROM m{k} UNION ALL SELECT dst FROM adj JOIN m{k} ON vid = src))""")
    return ",\n".join(out) + ", mis AS (" + " UNION ALL ".join(f"SELECT vid FROM m{k}" for k in range(rounds)) + ")"


@query(f"WITH {EDGES}, {VERTS}, {luby_sql(6)} SELECT vid FROM mis")
def luby_mis(spark, d):
    e = held_edges(spark, d)
    return cluster.luby(graph_of(e).vertices.select("vid"), e)


@query()
def mis_clusters(spark, d):
    e = held_edges(spark, d, 1)
    return cluster.mis_clusters(graph_of(e).vertices.select("vid"), e, cluster.soc(e, _data(e)))


@query()
def spw_clusters(spark, d):
    e = held_edges(spark, d, 1)
    g = graph_of(e)
    return hier.clusters_of(0, g, hier.Options())


@query()
def cluster_sizes(spark, d):
    return spw_clusters(spark, d).where("c is not null").groupBy("c").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("clusters"))


@query()
def cluster_stability(spark, d):
    e = held_edges(spark, d, 1)
    m = hier.clusters_of(0, graph_of(e), hier.Options()).where("c is not null")
    return cluster.stable_clusters(staged(m, "m"), e)


@query("SELECT i AS f, i % 50 AS c FROM range(200) t(i)")
def plate_test(spark, d):
    """Columns of a 3D grid of 4 layers: equal (x, y)."""
    ids = spark.range(200).select(F.col("id").alias("vid"))
    pos = ids.select("vid", F.array((F.col("vid") % 10).cast("double"), F.floor(F.col("vid") / 10 % 5).cast("double"), F.floor(F.col("vid") / 50).cast("double")).alias("pos"))
    e = ids.where("vid < 150").select(F.col("vid").alias("src"), (F.col("vid") + 50).alias("dst")).unionByName(ids.where("vid % 10 < 9").select(F.col("vid").alias("src"), (F.col("vid") + 1).alias("dst")))
    return cluster.plate_test(pos, e)


@query()
def greedy_pairs(spark, d):
    e = held_edges(spark, d, 1)
    part = graphs.vertices_of(e).select("vid", (F.col("vid") % 8).alias("p"))
    return cluster.greedy(e, part)


@query(f"WITH {EDGES}, {VERTS}, {DATA}, {GEOM}, {STRONG}, k AS (SELECT src, dst, w, soc FROM strong WHERE (least(src, dst), greatest(src, dst)) IN (SELECT src, dst FROM edges WHERE w >= 3)), {handshake_sql('k', 1)} SELECT a, b FROM pairs")
def pair_allowed(spark, d):
    e = held_edges(spark, d)
    allowed = graphs.adjacency(e.where("w >= 3")).select("src", "dst")
    return cluster.mutual(cluster.strong(cluster.soc(e, _data(e))).join(allowed, ["src", "dst"], "left_semi"))


@query(f"WITH {EDGES}, {VERTS} SELECT vid AS f, vid % 10 AS c FROM verts WHERE vid % 10 < 2")
def fixed_clusters(spark, d):
    """Clusters given by hand stay as they are."""
    e = held_edges(spark, d)
    data = staged(_data(e), "data")
    fixed = data.where("vid % 10 < 2").select(F.col("vid").alias("f"), (F.col("vid") % 10).alias("c"))
    got = cluster.spw(data.select("vid"), e, data, rounds=1, handshakes=1, fixed=fixed)
    return got.join(fixed.select("f"), "f", "left_semi")


@query(f"WITH {EDGES}, n AS (SELECT src, list(dst ORDER BY dst) AS ns FROM adj GROUP BY src) SELECT e.src, e.dst, CAST(len(list_intersect(a.ns, b.ns)) AS INTEGER) AS common FROM edges e JOIN n a ON a.src = e.src JOIN n b ON b.src = e.dst")
def common_neighbours(spark, d):
    return reach.common_neighbours(held_laplacian(spark, d) or held_edges(spark, d))


# --- prolongation
@query(f"WITH {EDGES}, {VMAP}, {P} SELECT i, j, v FROM P")
def prol_piecewise(spark, d):
    return prolong.piecewise(vmap_of(edges_of(spark, d)))


AUXG = """cw AS (SELECT a.f AS v, a.c AS own, b.c AS c, sum(w) AS w FROM adj JOIN vmap a ON a.f = src JOIN vmap b ON b.f = dst WHERE a.c IS NOT NULL AND b.c IS NOT NULL GROUP BY 1, 2, 3),
inn AS (SELECT v, w AS inner_w FROM cw WHERE own = c),
rk AS (SELECT cw.v, c, w, inner_w, row_number() OVER o AS n, 0.2 * inner_w + sum(w) OVER (o ROWS UNBOUNDED PRECEDING) AS cum, greatest(max(w) OVER (PARTITION BY cw.v), inner_w) AS largest FROM cw JOIN inn ON inn.v = cw.v WHERE own <> c WINDOW o AS (PARTITION BY cw.v ORDER BY w DESC, c)),
ok AS (SELECT v, c, min(CASE WHEN w > 0.15 * cum AND w >= 0.15 * largest AND n < 3 THEN 1 ELSE 0 END) OVER (PARTITION BY v ORDER BY w DESC, c ROWS UNBOUNDED PRECEDING) AS good FROM rk),
ag AS (SELECT f AS v, c FROM vmap WHERE c IS NOT NULL UNION ALL SELECT v, c FROM ok WHERE good = 1)"""
AUXV = """us AS (SELECT adj.src AS v, b.c, sum(w) AS w FROM adj JOIN vmap b ON b.f = dst JOIN ag ON ag.v = adj.src AND ag.c = b.c GROUP BY 1, 2),
tot AS (SELECT v, sum(w) AS d FROM us GROUP BY v),
av AS (SELECT v AS i, c AS j, sum(x) AS v FROM (SELECT us.v, c, w / d AS x FROM us JOIN tot ON tot.v = us.v UNION ALL SELECT f, vmap.c, CASE WHEN d IS NULL THEN 1.0 ELSE 0.0 END FROM vmap LEFT JOIN tot ON tot.v = f WHERE vmap.c IS NOT NULL) GROUP BY 1, 2)"""


@query(f"WITH {EDGES}, {VMAP}, {AUXG} SELECT v, c FROM ag")
def prol_aux_graph(spark, d):
    e = held_edges(spark, d)
    return prolong.aux_graph(e, vmap_of(e))


@query(f"WITH {EDGES}, {VMAP}, {AUXG}, {AUXV} SELECT i, j, round(v, 6) AS v FROM av")
def prol_aux_values(spark, d):
    e = held_edges(spark, d)
    return prolong.aux_smoothed(e, vmap_of(e)).select("i", "j", F.round("v", 6).alias("v"))


CLASSIC = "cl AS (SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM P UNION ALL SELECT A.i, P.j, -sum(A.v * P.v) / any_value(D.v) FROM A JOIN P ON P.i = A.j JOIN A D ON D.i = A.i AND D.j = A.i WHERE A.i IN (SELECT i FROM P) GROUP BY 1, 2) GROUP BY 1, 2)"


@query(f"WITH {MATRIX}, {VMAP}, {P}, {CLASSIC} SELECT i, j, round(v, 6) AS v FROM cl")
def prol_classic(spark, d):
    e = held_edges(spark, d)
    return prolong.classic(matrix_of(e), vmap_of(e)).select("i", "j", F.round("v", 6).alias("v"))


@query(f"""WITH {MATRIX}, {VMAP}, {P}, {AUXG}, {AUXV}, {CLASSIC}, si AS (SELECT i FROM A LEFT JOIN vmap ON f = A.j GROUP BY i HAVING count(*) = count(c) AND count(DISTINCT c) <= 5)
SELECT i, j, round(v, 6) AS v FROM cl WHERE i IN (SELECT i FROM si) UNION ALL SELECT i, j, round(v, 6) FROM av WHERE i NOT IN (SELECT i FROM si)""")
def prol_semi_aux(spark, d):
    e = held_edges(spark, d)
    return prolong.semi_aux(matrix_of(e), e, vmap_of(e)).select("i", "j", F.round("v", 6).alias("v"))


@query(f"""WITH {MATRIX}, {VMAP}, {P}, {AUXG}, {AUXV}, ap AS (SELECT A.i, av.j, -sum(A.v * av.v) / any_value(D.v) AS v FROM A JOIN av ON av.i = A.j JOIN A D ON D.i = A.i AND D.j = A.i GROUP BY 1, 2),
fo AS (SELECT ap.i, CASE WHEN g.i IS NOT NULL THEN ap.j ELSE c END AS j, ap.v FROM ap JOIN vmap ON f = ap.i LEFT JOIN av g ON g.i = ap.i AND g.j = ap.j WHERE c IS NOT NULL)
SELECT i, j, round(sum(v), 6) AS v FROM (SELECT i, j, v FROM av UNION ALL SELECT i, j, v FROM fo) GROUP BY 1, 2""")
def prol_improve(spark, d):
    e = held_edges(spark, d)
    m = vmap_of(e)
    p = staged(prolong.aux_smoothed(e, m), "p")
    return prolong.improve(matrix_of(e), p, m).select("i", "j", F.round("v", 6).alias("v"))


@query()
def prol_embedded(spark, d):
    e = held_edges(spark, d, 1)
    return prolong.embedded(matrix_of(e), e, vmap_of(e), omega=0.8, improve_its=1).select("i", "j", F.round("v", 6).alias("v"))


# --- sparse algebra
@query(f"WITH {MATRIX} SELECT A.i, sum(v * x) AS x FROM A JOIN X ON X.i = A.j GROUP BY A.i")
def spmv(spark, d):
    a = staged(matrix_of(edges_of(spark, d)), "a")
    return linalg.spmv(a, vector_of(a))


@query(f"WITH {EDGES}, B AS (SELECT src AS i, dst AS j, w AS v FROM edges), X AS (SELECT DISTINCT src AS i, CAST(src % 7 + 1 AS DOUBLE) AS x FROM adj) SELECT B.j AS i, sum(v * x) AS x FROM B JOIN X ON X.i = B.i GROUP BY B.j")
def spmv_t(spark, d):
    e = held_edges(spark, d)
    b = e.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("v"))
    return linalg.spmv_t(b, graphs.vertices_of(e).select(F.col("vid").alias("i"), (F.col("vid") % 7 + 1).cast("double").alias("x")))


@query(f"WITH {MATRIX} SELECT i, 2 * x + 3 * (i % 5) AS x FROM X")
def scaled_add(spark, d):
    x = vector_of(matrix_of(edges_of(spark, d)))
    return linalg.axpy(2.0, x, x.select("i", (F.col("i") % 5).cast("double").alias("x")), 3.0)


@query(f"WITH {EDGES} SELECT dst AS i, src AS j, w AS v FROM edges")
def transpose(spark, d):
    return linalg.transpose(edges_of(spark, d).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("v")))


@query(f"WITH {EDGES} SELECT dst AS i, src AS j, [w, 3, 2, 4, 0, 5]::DOUBLE[] AS v FROM edges")
def transpose_block(spark, d):
    m = edges_of(spark, d).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.array(F.col("w"), F.lit(2.0), F.lit(0.0), F.lit(3.0), F.lit(4.0), F.lit(5.0)).alias("v"))
    return linalg.transpose_blocks(m, 2, 3)


@query(f"WITH {MATRIX} SELECT a.i, b.j, sum(a.v * b.v) AS v FROM A a JOIN A b ON a.j = b.i GROUP BY 1, 2")
def spgemm(spark, d):
    if held := held_laplacian(spark, d):
        return reach.squared(held)
    a = staged(matrix_of(edges_of(spark, d)), "a")
    return linalg.spgemm(a, a)


@query(f"WITH {MATRIX}, {VMAP}, {P} SELECT p.j AS i, q.j, sum(p.v * A.v * q.v) AS v FROM A JOIN P p ON p.i = A.i JOIN P q ON q.i = A.j GROUP BY 1, 2")
def rap(spark, d):
    e = held_edges(spark, d)
    return linalg.rap(matrix_of(e), prolong.piecewise(vmap_of(e)))


@query(f"WITH {MATRIX}, {VMAP}, {P} SELECT p.j AS i, q.j, sum(p.v * A.v * q.v) AS v FROM A JOIN P p ON p.i = A.i JOIN P q ON q.i = A.j GROUP BY 1, 2")
def rap_with_factor(spark, d):
    e = held_edges(spark, d)
    return linalg.rap_with_factor(matrix_of(e), prolong.piecewise(vmap_of(e)))[0]


@query(f"WITH {MATRIX} SELECT i, j, sum(v) AS v FROM (SELECT i, j, 2 * v AS v FROM A UNION ALL SELECT i, i, -3.0::DOUBLE FROM X) GROUP BY 1, 2")
def add_mats(spark, d):
    a = staged(matrix_of(edges_of(spark, d)), "a")
    return linalg.add(2.0, a, -3.0, linalg.identity(a.select("i").distinct()))


@query(f"WITH {MATRIX} SELECT i, j, v FROM A WHERE abs(v) > 2")
def compress(spark, d):
    return linalg.compress(matrix_of(edges_of(spark, d)), 2.0)


@query(f"WITH {MATRIX} SELECT i, j, v FROM A WHERE i % 4 = 0 OR (i % 4 = 1 AND j % 4 = 1) OR (i % 4 = 2 AND j % 4 = 3)")
def block_restrict(spark, d):
    a = staged(matrix_of(edges_of(spark, d)), "a")
    ids = a.select("i").distinct()
    b = ids.where("i % 4 <> 0").select("i", (F.col("i") % 4).alias("b"))
    pairs = spark.createDataFrame([(1, 1), (2, 3)], "rb long, cb long")
    return linalg.restrict_to_blocks(a, b, b, pairs)


@query(f"WITH {EDGES} SELECT src * 2 + k // 2 AS i, dst * 2 + k % 2 AS j, w + k AS v FROM edges, range(4) t(k)")
def flatten_blocks(spark, d):
    m = edges_of(spark, d).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.array(*[F.col("w") + k for k in range(4)]).alias("v"))
    return linalg.flatten(m, 2, 2)


@query(f"WITH {EDGES} SELECT src * 2 AS i, dst * 2 AS j, [w, 1, 4, 5]::DOUBLE[] AS v FROM edges UNION ALL SELECT src * 2, dst * 2 + 1, [2, 3, 6, 7]::DOUBLE[] FROM edges UNION ALL SELECT src * 2 + 1, dst * 2 + 1, [10, 11, 14, 15]::DOUBLE[] FROM edges")
def reblock(spark, d):
    v = F.array(F.col("w"), *[F.lit(float(k if k not in (8, 9, 12, 13) else 0)) for k in range(1, 16)])
    return linalg.reblock(edges_of(spark, d).select(F.col("src").alias("i"), F.col("dst").alias("j"), v.alias("v")), 4, 2)


@query(f"WITH {MATRIX} SELECT i * 2 AS i, j * 2 AS j, v FROM A")
def embed_matrix(spark, d):
    a = staged(matrix_of(edges_of(spark, d)), "a")
    m = a.select(F.col("i").alias("f"), (F.col("i") * 2).alias("c")).distinct()
    return linalg.embed(a, m, m)


@query(f"WITH {EDGES} SELECT i, j, sum(v) AS v FROM (SELECT src AS i, src AS j, w + 0.5 AS v FROM adj UNION ALL SELECT src, dst, -w FROM adj) GROUP BY 1, 2")
def assemble_elements(spark, d):
    return linalg.assemble(_elements(edges_of(spark, d)))


@query(f"WITH {MATRIX} SELECT i, j, v FROM A WHERE i % 3 = j % 3")
def split_local(spark, d):
    a = staged(matrix_of(edges_of(spark, d)), "a")
    return linalg.split_by_part(a, a.select("i", (F.col("i") % 3).alias("p")).distinct())[0]


@query(f"WITH {MATRIX} SELECT i, j, v FROM A WHERE i % 3 <> j % 3")
def split_ghost(spark, d):
    a = staged(matrix_of(edges_of(spark, d)), "a")
    return linalg.split_by_part(a, a.select("i", (F.col("i") % 3).alias("p")).distinct())[1]


@query("""WITH A AS (SELECT i, j FROM range(120) t(i), range(120) s(j) WHERE i // 3 % 4 = j // 30), l AS (SELECT i, list(j ORDER BY j) AS cols FROM A GROUP BY i),
g AS (SELECT i, cols, i - row_number() OVER (PARTITION BY cols ORDER BY i) AS g FROM l) SELECT i, min(i) OVER (PARTITION BY cols, g) AS chunk, min(i) OVER (PARTITION BY cols) AS block FROM g""")
def row_fusing(spark, d):
    """Rows of three share their columns; four kinds of rows alternate."""
    i = spark.range(120).select(F.col("id").alias("i"))
    a = i.select("i", F.explode(F.sequence(F.floor(F.col("i") / 3) % 4 * 30, F.floor(F.col("i") / 3) % 4 * 30 + 29)).alias("j")).withColumn("v", F.lit(1.0))
    return linalg.row_blocks(a)


@query(f"WITH {MATRIX}, n AS (SELECT count(DISTINCT i) AS \"rows\", count(*) AS nnz FROM A) SELECT \"rows\", nnz, nnz * 12 + (\"rows\" + 1) * 8 AS bytes FROM n")
def matrix_counts(spark, d):
    return linalg.counts(matrix_of(edges_of(spark, d)))


@query(f"WITH {MATRIX} SELECT i, round(max(CASE WHEN i = j THEN 1 ELSE 0 END) / max(abs(v)), 6) AS err FROM A GROUP BY i")
def bf_check(spark, d):
    a = staged(matrix_of(edges_of(spark, d)), "a")
    b = a.select("i", "j", F.when(F.col("i") == F.col("j"), F.col("v") + 1).otherwise(F.col("v")).alias("v"))
    return linalg.row_errors(a, b).select("i", F.round("err", 6).alias("err"))


@query(f"""WITH {MATRIX}, D AS (SELECT i, v AS d FROM A WHERE i = j), s AS (SELECT A.i, sum(abs(v) / sqrt(p.d * q.d)) AS s FROM A JOIN D p ON p.i = A.i JOIN D q ON q.i = A.j WHERE A.i % 3 <> A.j % 3 GROUP BY A.i)
SELECT D.i, round(d * greatest(1.0, 0.51 * (1 + coalesce(s, 0))), 6) AS d FROM D LEFT JOIN s ON s.i = D.i""")
def hybrid_mod_diag(spark, d):
    a = staged(matrix_of(edges_of(spark, d)), "a")
    return linalg.hybrid_diagonal(a, a.select("i", (F.col("i") % 3).alias("p")).distinct()).select("i", F.round("d", 6).alias("d"))


# --- transfers, cycles, solvers
def _grid_matrix(spark: SparkSession, k: int) -> DataFrame:
    return graphs.laplacian(graphs.grid(spark, k).edges, 1.0)


@query(f"WITH {MATRIX}, {VMAP}, {P} SELECT j AS i, sum(x) AS x FROM P JOIN X ON X.i = P.i GROUP BY j")
def restrict_vec(spark, d):
    e = held_edges(spark, d)
    return linalg.spmv_t(prolong.piecewise(vmap_of(e)), vector_of(matrix_of(e)))


@query(f"WITH {EDGES}, {VMAP}, {P} SELECT i, CAST(j % 7 + 1 AS DOUBLE) AS x FROM P")
def prolong_vec(spark, d):
    e = held_edges(spark, d)
    p = prolong.piecewise(vmap_of(e))
    return linalg.spmv(p, p.select(F.col("j").alias("i"), (F.col("j") % 7 + 1).cast("double").alias("x")).distinct())


@query(f"WITH {EDGES}, {VMAP}, {P} SELECT i, 1.0::DOUBLE AS x FROM P WHERE j = 7")
def basis_function(spark, d):
    e = held_edges(spark, d)
    return linalg.spmv(prolong.piecewise(vmap_of(e)), spark.createDataFrame([(7, 1.0)], "i long, x double"))


@query(f"WITH {MATRIX}, D AS (SELECT i, v AS d FROM A WHERE i = j), R AS (SELECT A.i, any_value(D.d) AS d, sum(v * x) AS ax FROM A JOIN X ON X.i = A.j JOIN D ON D.i = A.i GROUP BY A.i) SELECT i, round(0.9 * (1 - ax) / d + CAST(i % 7 + 1 AS DOUBLE), 6) AS x FROM R")
def jacobi_sweep(spark, d):
    a = staged(matrix_of(edges_of(spark, d)), "a")
    x = vector_of(a)
    s = smooth.Jacobi(a, stage=False)
    return s.smooth(x, x.select("i", F.lit(1.0).alias("x")), update_res=False)[0].select("i", F.round("x", 6).alias("x"))


@query(f"WITH {MATRIX}, R AS (SELECT A.i, sum(v * x) AS ax FROM A JOIN X ON X.i = A.j GROUP BY A.i) SELECT i, round(0.1 * (1 - ax) + CAST(i % 7 + 1 AS DOUBLE), 6) AS x FROM R")
def richardson_step(spark, d):
    a = staged(matrix_of(edges_of(spark, d)), "a")
    x = vector_of(a)
    return smooth.Richardson(a, 0.1, stage=False).smooth(x, x.select("i", F.lit(1.0).alias("x")), update_res=False)[0].select("i", F.round("x", 6).alias("x"))


@query(f"WITH {MATRIX}, R AS (SELECT A.i, 1 - sum(v * x) AS r FROM A JOIN X ON X.i = A.j GROUP BY A.i) SELECT round(sqrt(sum(r * r)), 6) AS err FROM R")
def residual_norm(spark, d):
    a = staged(matrix_of(edges_of(spark, d)), "a")
    x = vector_of(a)
    r = smooth.residual(a, x, x.select("i", F.lit(1.0).alias("x")))
    return r.agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("err"))


@query(f"WITH {EDGES}, {VMAP} SELECT c AS block_id, list(f ORDER BY f) AS ids FROM vmap WHERE c IS NOT NULL GROUP BY c")
def gs_blocks(spark, d):
    return solve.gs_blocks(vmap_of(edges_of(spark, d))).groupBy("block_id").agg(F.array_sort(F.collect_list("i")).alias("ids"))


@query("SELECT * FROM (VALUES (0, 1000, 3000, 5000, 1.3, 1.4), (1, 250, 900, 1500, 1.3, 1.4), (2, 50, 200, 500, 1.3, 1.4)) t(level, nv, ne, nnz, v_complexity, op_complexity)".replace("1.3, 1.4", "1.3::DOUBLE, 1.4::DOUBLE"))
def op_complexity(spark, d):
    return hier.complexity(spark.createDataFrame([(0, 1000, 3000, 5000), (1, 250, 900, 1500), (2, 50, 200, 500)], "level int, nv long, ne long, nnz long"))


@query("SELECT * FROM (VALUES ('BS', 4.0), ('V', 1.4), ('W', 2.0)) t(cycle, ops)".replace("4.0", "(5000 * 2 + 1500 * 4 + 500 * 6) / 5000.0::DOUBLE").replace("1.4", "7000 / 5000.0::DOUBLE").replace("2.0)", "(5000 + 3000 + 2000) / 5000.0::DOUBLE)"))
def cycle_work(spark, d):
    sizes = spark.createDataFrame([(0, 1000, 3000, 5000), (1, 250, 900, 1500), (2, 50, 200, 500)], "level int, nv long, ne long, nnz long")
    out = [hier.cycle_complexity(sizes, c).select(F.lit(c).alias("cycle"), "ops") for c in ("V", "W", "BS")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT * FROM (VALUES (0, 1000, 100), (1, 100, 50), (2, 50, 50)) t(level, nv, goal)")
def coarsening_goals(spark, d):
    o = hier.Options()
    return spark.createDataFrame([(k, n, g) for k, (n, g) in enumerate(zip([1000, 100, 50], hier.goals([1000, 100, 50], o), strict=True))], "level int, nv int, goal int")


_TWO = f"""{grid_sql(24)}, adj AS (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, w FROM edges), A AS (SELECT src AS i, dst AS j, -w AS v FROM adj UNION ALL SELECT src, src, sum(w) + 1 FROM adj GROUP BY src),
D AS (SELECT i, v AS d FROM A WHERE i = j), B AS (SELECT i, CAST(i % 7 + 1 AS DOUBLE) AS x FROM D)"""


@query(f"""WITH {_TWO}, x1 AS (SELECT B.i, 0.9 * x / d AS x FROM B JOIN D USING (i)), r1 AS (SELECT B.i, any_value(B.x) - sum(v * x1.x) AS r FROM B JOIN A ON A.i = B.i JOIN x1 ON x1.i = A.j GROUP BY B.i),
P AS (SELECT i, i // 2 AS j FROM B), rc AS (SELECT j AS i, sum(r) AS r FROM r1 JOIN P USING (i) GROUP BY j), AC AS (SELECT p.j AS i, q.j, sum(v) AS v FROM A JOIN P p ON p.i = A.i JOIN P q ON q.i = A.j GROUP BY 1, 2),
xc AS (SELECT rc.i, 0.9 * r / v AS x FROM rc JOIN AC ON AC.i = rc.i AND AC.j = rc.i), x2 AS (SELECT x1.i, x1.x + xc.x AS x FROM x1 JOIN P USING (i) JOIN xc ON xc.i = P.j),
r2 AS (SELECT B.i, any_value(B.x) - sum(v * x2.x) AS r FROM B JOIN A ON A.i = B.i JOIN x2 ON x2.i = A.j GROUP BY B.i) SELECT x2.i, round(x2.x + 0.9 * r / d, 6) AS x FROM x2 JOIN r2 USING (i) JOIN D USING (i)""")
def two_grid_jacobi(spark, d):
    """A V-cycle of two levels, Jacobi on both."""
    a = staged(_grid_matrix(spark, 24), "a")
    b = vector_of(a)
    p = a.where("i = j").select("i", F.floor(F.col("i") / 2).alias("j"), F.lit(1.0).alias("v"))
    ac = staged(linalg.rap(a, p), "ac")
    levels = [hier.Level(a, None, 0, 0, 0, p), hier.Level(ac, None, 0, 0, 0)]
    c = solve.Cycle(hier.Hierarchy(levels, hier.Options()), [smooth.Jacobi(a), smooth.Jacobi(ac)], "V", "sm")
    return c.apply(b).select("i", F.round("x", 6).alias("x"))


@query()
def level_summary(spark, d):
    o = hier.Options(max_coarse_size=100)
    return hier.build(whole_laplacian(spark, d, o), o).summary(spark)


@query()
def color_gs(spark, d):
    a = staged(_grid_matrix(spark, 24), "a")
    c = smooth.color(a)
    s = smooth.ColoredGaussSeidel(a, c, int(c.agg(F.max("color")).first()[0]) + 1)
    b = vector_of(a)
    return s.smooth(b, b)[0].select("i", F.round("x", 6).alias("x"))


@query()
def block_gs(spark, d):
    a = staged(_grid_matrix(spark, 24), "a")
    blocks = a.where("i = j").select(F.floor(F.col("i") / 6).alias("block_id"), "i")
    b = vector_of(a)
    return smooth.BlockGaussSeidel(a, blocks).smooth(b, b)[0].select("i", F.round("x", 6).alias("x"))


@query()
def hybrid_gs(spark, d):
    a = staged(_grid_matrix(spark, 24), "a")
    b = vector_of(a)
    s = smooth.HybridGaussSeidel(a, a.where("i = j").select("i", F.floor(F.col("i") / 72).alias("p")))
    return s.smooth(b, b)[0].select("i", F.round("x", 6).alias("x"))


@query()
def cg_history(spark, d):
    """Conjugate gradients with a V-cycle over the co-purchase matrix."""
    o = hier.Options(max_coarse_size=300)
    h = hier.build(whole_laplacian(spark, d, o), o)
    errors = solve.cg_cycles(h, h.vector(0).select("i", (F.col("i") % 7 + 1).cast("double").alias("x")), 1e-6, 12)
    return spark.createDataFrame([(k, float(f"{e:.6g}")) for k, e in enumerate(errors)], "iter int, err double")


@query()
def lanczos_bounds(spark, d):
    a = staged(_grid_matrix(spark, 24), "a")
    _, _, steps = solve.cg(a, staged(vector_of(a), "b"), lambda r: smooth.Jacobi(a, 1.0, stage=False).update(r), 1e-4, 8)
    lo, hi, k = solve.eigenvalue_bounds(steps)
    return spark.createDataFrame([(round(lo, 6), round(hi, 6), round(k, 6))], "lo double, hi double, ratio double")


@query()
def solver_history(spark, d):
    a = staged(_grid_matrix(spark, 24), "a")
    s = solve.LinearSolver(a, lambda x, b: smooth.Jacobi(a, stage=False).smooth(x, b, update_res=False)[0], 1e-3, 6)
    s.solve(staged(vector_of(a), "b"))
    return s.history(spark).select("iter", F.round("err", 6).alias("err"))


# --- the whole graph: the queries above that SQL checks on the edges of weight 2 and more, on all edges
def _whole(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, d: str) -> DataFrame:
        before = _least.set(1)
        try:
            return f(spark, d)
        finally:
            _least.reset(before)

    return run


QUERIES |= {f"{name}_whole": _whole(QUERIES[name]) for name, sql in ORACLE_SQL.items() if EDGES in sql}
