"""The multilevel hierarchy: a driver loop over coarsening, prolongation and the Galerkin product.

Each level is staged in the shared folder, so no lineage grows with the levels, and dealt over as many partitions as its size
takes: coarse levels end up in few tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.functions.columns import coarsening_goal, level_partitions
from gridweave.operators import cluster, coarsen, linalg, prolong, weights
from gridweave.options import Options
from gridweave.plans import bulk, local
from gridweave.session import staged
from gridweave.sources.graphs import Graph


@dataclass
class Level:
    """matrix and graph of a level, its sizes, and the prolongation from the next coarser one (None on the last)."""

    matrix: DataFrame
    graph: Graph
    nv: int
    ne: int
    nnz: int
    p: DataFrame | None = None
    vmap: DataFrame | None = None
    #: vertices that the step to the next level was to reach, and the tasks this one is dealt over
    goal: int = 0
    parts: int = 0


@dataclass
class Hierarchy:
    levels: list[Level]
    options: Options
    block: int = 1
    smoothers: dict[int, object] = field(default_factory=dict)

    def summary(self, spark: SparkSession) -> DataFrame:
        """(level, nv, ne, nnz, v_complexity, op_complexity): sizes and sums over levels relative to the finest."""
        rows = [(k, x.nv, x.ne, x.nnz) for k, x in enumerate(self.levels)]
        return complexity(spark.createDataFrame(rows, "level int, nv long, ne long, nnz long"))

    def steps(self, spark: SparkSession) -> DataFrame:
        """(level, nv, goal, reached, parts): what each step was to reach, whether it did, and the tasks of the level."""
        rows = [(k, x.nv, x.goal, k + 1 < len(self.levels) and self.levels[k + 1].nv <= x.goal, x.parts) for k, x in enumerate(self.levels)]
        return spark.createDataFrame(rows, "level int, nv long, goal long, reached boolean, parts int")

    def sizes(self, level: int) -> dict[str, int]:
        """Of a level: unknowns of a vertex, vertices, unknowns, edges, entries."""
        x = self.levels[level]
        block = self.block if level else x.matrix.select("i").distinct().count() // max(x.nv, 1) or 1
        return {"block": block, "vertices": x.nv, "unknowns": x.nv * block, "edges": x.ne, "entries": x.nnz}

    def vector(self, level: int, value: float = 0.0) -> DataFrame:
        """(i, x) on the rows of a level."""
        x = self.levels[level]
        if isinstance(x, bulk.HeldLevel):
            return x.spark.createDataFrame(pa.table({"i": x.rows, "x": np.full(len(x.rows), value)}))
        return self.levels[level].matrix.select("i").distinct().select("i", F.lit(value).alias("x"))

    def step(self, level: int) -> DataFrame:
        """The prolongation from the next level."""
        return self.levels[level].p

    def sub(self, first: int, last: int | None = None) -> Hierarchy:
        """The hierarchy of some levels."""
        return Hierarchy(self.levels[first:last], self.options, self.block)

    def regularized(self, level: int, tol: float = 1e-10) -> DataFrame:
        """A level's matrix with diagonal entries that are zero (relative to the largest) replaced by one."""
        a = self.levels[level].matrix
        d = linalg.diagonal(a)
        most = float(d.agg(F.max(F.abs("d"))).first()[0] or 0.0)
        zero = self.vector(level).join(d.where(F.abs("d") > tol * most), "i", "left_anti")
        return a.join(zero.select("i", F.col("i").alias("j")), ["i", "j"], "left_anti").unionByName(zero.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v")))

    def kernel_errors(self, vector: DataFrame) -> DataFrame:
        """(level, err): for a vector of the kernel of the finest matrix that all levels have (restricted by averages), the largest
        entry of A_k x_k, and of x_k - P x_(k+1)."""
        spark = vector.sparkSession
        if self.held and self.block == 1:
            return spark.createDataFrame(bulk.kernel_errors(self.levels, bulk.vector(self.levels[0], vector)), "level int, err double")
        x, rows = vector, []
        for k, lev in enumerate(self.levels):
            err = linalg.spmv(lev.matrix, x).agg(F.max(F.abs("x"))).first()[0] or 0.0
            if lev.p is not None:
                count = lev.vmap.where("c is not null")
                coarse = staged(count.join(x.select(F.col("i").alias("f"), "x"), "f").groupBy(F.col("c").alias("i")).agg(F.avg("x").alias("x")), "kernel")
                back = linalg.axpy(-1.0, linalg.spmv(lev.p, coarse), x.join(lev.p.select("i").distinct(), "i", "left_semi"))
                err = max(err, back.agg(F.max(F.abs("x"))).first()[0] or 0.0)
                x = coarse
            rows.append((k, float(err)))
        return spark.createDataFrame(rows, "level int, err double")

    @property
    def held(self) -> bool:
        """Whether all levels are blocks of rows."""
        return all(isinstance(x, bulk.HeldLevel) for x in self.levels)

    def n_levels(self) -> int:
        return len(self.levels)

    def restrict(self, level: int, x: DataFrame) -> DataFrame:
        """From a level to the next."""
        return linalg.spmv_t(self.levels[level].p, x)

    def prolong(self, level: int, x: DataFrame) -> DataFrame:
        """From the next level to a level."""
        return linalg.spmv(self.levels[level].p, x)

    def transfer(self, a: int, b: int, x: DataFrame) -> DataFrame:
        """From level a to level b, through those between."""
        for k in range(a, b):
            x = self.restrict(k, x)
        for k in reversed(range(b, a)):
            x = self.prolong(k, x)
        return x

    def basis_function(self, level: int, number: int) -> DataFrame:
        """A unit vector of a level on the finest one."""
        spark = self.levels[0].matrix.sparkSession
        return self.transfer(level, 0, spark.createDataFrame([(number, 1.0)], "i long, x double"))

    def concatenated(self, a: int, b: int) -> DataFrame:
        """The prolongation from level b to level a as one matrix."""
        out = self.levels[a].p
        for k in range(a + 1, b):
            out = linalg.spgemm(out, self.levels[k].p)
        return out

    def project(self, matrix: DataFrame) -> list[DataFrame]:
        """A matrix of the finest level on all levels."""
        out = [matrix]
        for x in self.levels[:-1]:
            out.append(linalg.rap(out[-1], x.p))
        return out


def complexity(sizes: DataFrame) -> DataFrame:
    """Adds the sums over all levels of vertices and entries, relative to level 0: one row's values on every row."""
    every = Window.partitionBy()
    ratio = lambda c: F.round(F.sum(c).over(every) / F.max(F.when(F.col("level") == 0, F.col(c))).over(every), 6)
    return sizes.select("level", "nv", "ne", "nnz", ratio("nv").alias("v_complexity"), ratio("nnz").alias("op_complexity"))


def cycle_complexity(sizes: DataFrame, cycle: str) -> DataFrame:
    """(ops): work of a cycle over the entries of the finest level: a level k counts once, 2**k times in W, 2 (1 + k) in BS."""
    factor = {"V": F.lit(1.0), "W": F.pow(F.lit(2.0), F.col("level")), "BS": F.lit(2.0) * (1 + F.col("level"))}[cycle]
    return sizes.agg((F.sum(F.col("nnz") * factor) / F.max(F.when(F.col("level") == 0, F.col("nnz")))).alias("ops"))


def clusters_of(level: int, graph: Graph, o: Options, fixed: DataFrame | None = None) -> DataFrame:
    """(f, c) for every vertex, c null where it is dropped: not free, isolated, or dominated by its own weight."""
    live = graph.vertices.where("free").select("vid")
    if o.vert_thresh > 0:
        live = live.join(weights.drop_l2_dominant(graph, o.vert_thresh), "vid", "left_anti")
    if o.check_isolated_vertices:
        live = live.join(weights.isolated(graph), "vid", "left_anti")
    live = staged(live, "live")
    data = staged(weights.aux_diagonal(graph), "aux")
    edges = graph.edges.select("src", "dst", "w")
    kind, alg = o.spw_pick_avg.at(level), o.crs_alg.at(level)
    if alg == "spw" and fixed is None and o.local_edges and edges.limit(o.local_edges + 1).count() <= o.local_edges:
        got = local.spw(live, edges, data, o.spw_rounds.at(level), o.handshakes, kind, o.edge_thresh, o.spw_orphan_treatment)
    elif alg == "spw":
        got = cluster.spw(live, edges, data, o.spw_rounds.at(level), o.handshakes, kind, o.edge_thresh, o.spw_orphan_treatment, fixed)
    elif alg == "mis":
        keep = edges.join(live.select(F.col("vid").alias("src")), "src", "left_semi").join(live.select(F.col("vid").alias("dst")), "dst", "left_semi")
        got = cluster.mis_clusters(live, keep, cluster.soc(keep, data, kind), o.mis_dist2.at(level))
    elif alg == "plate_test":
        got = cluster.plate_test(graph.vertices.join(live, "vid", "left_semi"), edges)
    else:
        raise ValueError(f"unknown clustering {alg!r}")
    return graph.vertices.select(F.col("vid").alias("f")).join(got, "f", "left").select("f", "c")


def prolongation(level: int, a: DataFrame, graph: Graph, vmap: DataFrame, o: Options) -> DataFrame:
    kind = o.prol_type.at(level)
    edges = graph.edges.select("src", "dst", "w")
    frac, rows, omega = o.sp_min_frac.at(level), o.sp_max_per_row.at(level), o.sp_omega.at(level)
    if kind == "piecewise":
        p = prolong.piecewise(vmap)
    elif kind == "aux_smoothed":
        p = prolong.aux_smoothed(edges, vmap, frac, rows, omega)
    elif kind == "semi_aux_smoothed":
        p = prolong.semi_aux(a, edges, vmap, frac, rows, o.sp_max_per_row_classic.at(level), omega)
    else:
        raise ValueError(f"unknown prolongation {kind!r}")
    for _ in range(o.sp_improve_its.at(level)):
        p = prolong.improve(a, staged(p, "p"), vmap, omega)
    return p


def accepted(fine: int, coarse: int, o: Options) -> bool:
    """Whether a step is taken: it must leave fewer vertices, and where levels may be dealt anew, at most ``crs_thresh`` of them."""
    return coarse >= max(o.min_coarse_size, 1) and coarse < fine and (not o.redistribute or coarse / fine < o.crs_thresh)


def partitions_of(now: int, coarse: int, goal: int, parts: int, o: Options, most: int) -> int:
    """Tasks of the next level, given those of this one.

    A level of at most ``seq_vertices`` is one task's. Else the tasks become fewer by at most ``task_factor`` where a step missed its
    goal or slowed down, or where they would hold less than ``vertices_per_task`` each.
    """
    if coarse <= o.seq_vertices:
        return 1
    if not o.redistribute:
        return parts
    slow = coarse > goal or coarse / max(now, 1) > o.crs_thresh
    fit = level_partitions(coarse, o.vertices_per_task, most)
    least = max(1, int(parts * o.task_factor))
    return max(1, min(parts, max(fit, least) if not slow else least))


def build(a: DataFrame | bulk.Source, options: Options | None = None, free: DataFrame | None = None, graph: Graph | None = None, fixed: DataFrame | None = None) -> Hierarchy:
    """The hierarchy of a symmetric matrix (i, j, v); free (i) lists free rows, graph replaces the one from the matrix.

    It ends at max_levels, at max_coarse_size vertices, or with a step that isn't ``accepted``. Each step has a goal from first_aaf, aaf
    and aaf_scale; one that misses it, or slows down, deals the next level over fewer tasks, as ``partitions_of`` says.
    """
    o = options or Options()
    if isinstance(a, bulk.Source):
        if free is None and graph is None and fixed is None and bulk.fits(o):
            return Hierarchy(bulk.levels(a, o), o, a.copies)
        a = a.matrix
    spark = a.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if free is None and graph is None and fixed is None and bulk.fits(o) and (held := bulk.levels(a, o)):
        return Hierarchy(held, o)
    a = staged(a, "level")
    g = graph or (weights.algebraic(a, free) if o.energy == "alg" else weights.trivial(weights.topology(a, free)))
    g = Graph(staged(g.vertices, "vertices"), staged(g.edges, "edges"))
    nv = g.vertices.count()
    levels = [Level(a, g, nv, g.edges.count(), a.count(), parts=level_partitions(nv, o.vertices_per_task, most))]
    while len(levels) < o.max_levels:
        now = levels[-1]
        k = len(levels) - 1
        if now.nv <= o.max_coarse_size:
            break
        rounds = clusters_of(k, now.graph, o, fixed if k == 0 else None)
        vmap = staged(coarsen.map_vertices(rounds), "map")
        n = vmap.select("c").distinct().where("c is not null").count()
        if not accepted(now.nv, n, o):
            break
        p = staged(prolongation(k, now.matrix, now.graph, vmap, o), "p")
        now.goal = goals([now.nv], o, k)[0]
        parts = partitions_of(now.nv, n, now.goal, now.parts, o, most)
        # products are dealt by their own size; the level is read over fewer tasks
        matrix = staged(linalg.rap(now.matrix, p), "level").coalesce(parts)
        coarse = coarsen.coarse_graph(now.graph, vmap)
        coarse = Graph(staged(coarse.vertices.coalesce(parts), "vertices"), staged(coarse.edges.coalesce(parts), "edges"))
        now.p, now.vmap = p, vmap
        levels.append(Level(matrix, coarse, n, coarse.edges.count(), matrix.count(), parts=parts))
    return Hierarchy(levels, o)


def goals(sizes: list[int], o: Options, first: int = 0) -> list[int]:
    """The coarsening goal of each level of these sizes, from level ``first`` on."""
    return [coarsening_goal(k, n, o.first_aaf, o.aaf, o.aaf_scale, o.max_coarse_size) for k, n in enumerate(sizes, first)]


#: Builders by model name; others may be added.
REGISTRY: dict[str, Callable[..., Hierarchy]] = {
    "h1_scal": build,
}


def build_hierarchy(a: DataFrame, model: str = "h1_scal", **arguments: object) -> Hierarchy:
    """By the name of a model in ``REGISTRY``; those of vector-valued problems are in ``plans.vectorial``."""
    from gridweave.plans import vectorial  # noqa: F401

    if model not in REGISTRY:
        raise ValueError(f"unknown model {model!r}; known are {sorted(REGISTRY)}")
    return REGISTRY[model](a, **arguments)
