"""From matrices to weighted graphs, and the per-vertex and per-edge data derived from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.sources.graphs import Graph, adjacency


def topology(a: DataFrame, free: DataFrame | None = None) -> Graph:
    """One edge for each structural pair i < j, a vertex for each row; ``free`` (i) lists the rows that are free (all by default)."""
    edges = a.where("i <> j").select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")).distinct().withColumn("w", F.lit(1.0))
    rows = a.select(F.col("i").alias("vid")).distinct().select("vid", F.lit(0.0).alias("w"), F.lit(1.0).alias("cnt"))
    if free is None:
        return Graph(rows.withColumn("free", F.lit(True)), edges)
    marked = free.select(F.col("i").alias("vid")).distinct().withColumn("free", F.lit(True))
    return Graph(rows.join(marked, "vid", "left").withColumn("free", F.coalesce("free", F.lit(False))), edges)


def algebraic(a: DataFrame, free: DataFrame | None = None) -> Graph:
    """Weights from the matrix: |a_ij| for an edge, |row sum| for a vertex, count 1."""
    edges = a.where("i < j").select(F.col("i").alias("src"), F.col("j").alias("dst"), F.abs("v").alias("w"))
    sums = a.groupBy(F.col("i").alias("vid")).agg(F.abs(F.sum("v")).alias("w")).select("vid", "w", F.lit(1.0).alias("cnt"))
    flags = topology(a, free).vertices.select("vid", "free") if free is not None else None
    return Graph(sums.withColumn("free", F.lit(True)) if flags is None else sums.join(flags, "vid"), edges)


def algebraic_blocked(a: DataFrame, dof_vertex: DataFrame) -> Graph:
    """The same with several dofs at a vertex: dof_vertex is (i, vid); weights come from sums over equal components.

    An edge weighs the absolute sum of the entries between its vertices' equal components, and so for the row sums.
    """
    part = dof_vertex.select("i", F.col("vid").alias("vi"), F.col("comp").alias("ci"))
    other = dof_vertex.select(F.col("i").alias("j"), F.col("vid").alias("vj"), F.col("comp").alias("cj"))
    traced = a.join(part, "i").join(other, "j").where("ci = cj").groupBy(F.col("vi").alias("i"), F.col("vj").alias("j")).agg(F.sum("v").alias("v"))
    return algebraic(traced)


def trivial(graph: Graph) -> Graph:
    """Weight 0 and count 1 for vertices, weight 1 for edges."""
    return Graph(graph.vertices.withColumn("w", F.lit(0.0)).withColumn("cnt", F.lit(1.0)), graph.edges.withColumn("w", F.lit(1.0)))


def element_row_sums(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertex and edge weights from element matrices (dofs, mat): |row sum| and |entry|, summed over elements."""
    n = F.size("dofs")
    e = elements.select("dofs", n.alias("n"), F.posexplode("mat").alias("k", "v"))
    e = e.select(F.get("dofs", F.floor(F.col("k") / F.col("n")).cast("int")).alias("i"), F.get("dofs", (F.col("k") % F.col("n")).cast("int")).alias("j"), "v")
    # row sums are taken inside the element's array, so no element needs a number
    row = lambda r: F.aggregate(F.slice("mat", (r * n + 1).cast("int"), n), F.lit(0.0), lambda a, x: a + x)
    rows = elements.select(F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda r: F.struct(F.get("dofs", r).alias("vid"), F.abs(row(r)).alias("w")))).alias("r"))
    vertices = rows.groupBy(F.col("r.vid").alias("vid")).agg(F.sum("r.w").alias("w"))
    edges = e.where("i < j").groupBy(F.col("i").alias("src"), F.col("j").alias("dst")).agg(F.sum(F.abs("v")).alias("w"))
    return vertices, edges


def element_schur(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertex and edge weights from the inverse of element matrices bordered by ones, summed over elements.

    With S the inverse without the border, a pair i, j has the weight 1 / (s_ii - 2 s_ij + s_jj): the stiffness between the
    two with all others free. A vertex has the absolute row sum, which the border takes out of S.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for dofs, mat in zip(p["dofs"], p["mat"], strict=True):
                n = len(dofs)
                a = np.asarray(mat, float).reshape(n, n)
                bordered = np.zeros((n + 1, n + 1))
                bordered[:n, :n], bordered[:n, n], bordered[n, :n] = a, 1, 1
                s = np.linalg.pinv(bordered)[:n, :n]
                for i in range(n):
                    out.append((int(dofs[i]), int(dofs[i]), abs(float(a[i].sum()))))
                    for j in range(i + 1, n):
                        gap = s[i, i] - s[i, j] - s[j, i] + s[j, j]
                        out.append((int(min(dofs[i], dofs[j])), int(max(dofs[i], dofs[j])), float(1 / gap) if abs(gap) > 1e-14 else 0.0))
            yield pd.DataFrame(out, columns=["a", "b", "w"])

    got = elements.select("dofs", "mat").mapInPandas(run, "a long, b long, w double").groupBy("a", "b").agg(F.sum("w").alias("w"))
    return got.where("a = b").select(F.col("a").alias("vid"), "w"), got.where("a < b").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")


def dof_subset(ids: DataFrame, ranges: list[tuple[int, int]] | None = None, selected: DataFrame | None = None, block: int = 1) -> DataFrame:
    """(i, vid, comp): the dofs in one of the ranges (ends excluded) and in ``selected`` (i), grouped by ``block`` to vertices."""
    out = ids
    if ranges:
        condition = F.lit(False)
        for a, b in ranges:
            condition = condition | ((F.col("i") >= a) & (F.col("i") < b))
        out = out.where(condition)
    if selected is not None:
        out = out.join(selected.select("i").distinct(), "i", "left_semi")
    return out.select("i", F.floor(F.col("i") / block).cast("long").alias("vid"), (F.col("i") % block).cast("int").alias("comp"))


def embedding(subset: DataFrame, permutation: DataFrame, block: int = 1) -> DataFrame:
    """(i, j, v): the matrix from solver unknowns to all dofs: subset times expansion times permutation.

    subset is (i, vid, comp); permutation is (f, c), vertices to solver vertices. Rows of dofs that aren't in it are zero.
    """
    return subset.join(permutation.select(F.col("f").alias("vid"), "c"), "vid").where("c is not null").select("i", (F.col("c") * block + F.col("comp")).alias("j"), F.lit(1.0).alias("v"))


def aux_diagonal(graph: Graph) -> DataFrame:
    """(vid, d, max_od, cnt): edge weights plus the vertex weight, and the largest of both."""
    sums = adjacency(graph.edges).groupBy(F.col("src").alias("vid")).agg(F.sum("w").alias("s"), F.max("w").alias("m"))
    j = graph.vertices.select("vid", "w", "cnt").join(sums, "vid", "left")
    return j.select("vid", (F.coalesce("s", F.lit(0.0)) + F.col("w")).alias("d"), F.greatest(F.coalesce("m", F.lit(0.0)), F.col("w")).alias("max_od"), "cnt")


def aux_matrix(graph: Graph, vertex_weights: bool = True) -> DataFrame:
    """(i, j, v): the replacement matrix, [[w, -w], [-w, w]] for each edge and the vertex weights on the diagonal."""
    four = F.explode(F.array(*[F.struct(F.col(a).alias("i"), F.col(b).alias("j"), (F.col("w") * s).alias("v")) for a, b, s in (("src", "src", 1.0), ("src", "dst", -1.0), ("dst", "src", -1.0), ("dst", "dst", 1.0))])).alias("e")
    entries = graph.edges.select(four).select("e.i", "e.j", "e.v")
    if vertex_weights:
        entries = entries.unionByName(graph.vertices.select(F.col("vid").alias("i"), F.col("vid").alias("j"), F.col("w").alias("v")))
    return entries.groupBy("i", "j").agg(F.sum("v").alias("v"))


def drop_l2_dominant(graph: Graph, thresh: float) -> DataFrame:
    """(vid): vertices whose own weight dominates: w / d above the threshold and above a quarter of the largest edge weight."""
    sums = adjacency(graph.edges).groupBy(F.col("src").alias("vid")).agg(F.sum("w").alias("s"), F.max("w").alias("m"))
    j = graph.vertices.join(sums, "vid", "left").withColumn("s", F.coalesce("s", F.lit(0.0))).withColumn("m", F.coalesce("m", F.lit(0.0)))
    return j.where((F.col("w") > thresh * (F.col("s") + F.col("w"))) & (F.col("w") > 0.25 * F.col("m"))).select("vid")


def isolated(graph: Graph) -> DataFrame:
    """(vid): vertices without an edge.

    The ends are as many as the edges, whose size Catalyst guesses from their files, so they are never broadcast.
    """
    ends = adjacency(graph.edges.select("src", "dst")).select(F.col("src").alias("vid")).distinct()
    return graph.vertices.select("vid").join(ends.hint("merge"), "vid", "left_anti")


def elasticity_edges_2d(a: DataFrame, positions: DataFrame) -> DataFrame:
    """(src, dst, emat): |t' (-A_ij) t| t t' in the first two rows and columns of a 3 x 3 matrix, t the unit tangent.

    a is a block matrix of 2 x 2 blocks, positions (vid, pos).
    """
    p = positions.select(F.col("vid").alias("i"), F.col("pos").alias("pi"))
    q = positions.select(F.col("vid").alias("j"), F.col("pos").alias("pj"))
    d = lambda k: F.get(F.col("pj"), F.lit(k)) - F.get(F.col("pi"), F.lit(k))
    j = a.where("i < j").join(p, "i").join(q, "j").withColumn("dx", d(0)).withColumn("dy", d(1))
    norm = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    j = j.withColumn("tx", F.col("dx") / norm).withColumn("ty", F.col("dy") / norm)
    v = lambda k: F.get(F.col("v"), F.lit(k))
    s = F.abs(v(0) * F.col("tx") * F.col("tx") + (v(1) + v(2)) * F.col("tx") * F.col("ty") + v(3) * F.col("ty") * F.col("ty"))
    j = j.withColumn("s", s)
    e = [F.col("s") * F.col(a_) * F.col(b_) for a_ in ("tx", "ty") for b_ in ("tx", "ty")]
    zero = F.lit(0.0)
    return j.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.array(e[0], e[1], zero, e[2], e[3], zero, zero, zero, zero).alias("emat"))
