"""Dual graphs of meshes, loops around their nodes, and the discrete curl and divergence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dual_graph(facets: DataFrame, volumes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, vol, kind) and edges (eid, src, dst) of the dual graph of a mesh.

    facets is (eid, a, b, boundary): the two elements of a facet, b null at a boundary with an index; volumes is (vid, vol).
    Each boundary index is one fictitious vertex of negative volume, numbered -1 - index; a facet without an index and without
    a second element leads to vertex -1000000.
    """
    outside = F.coalesce(F.col("b"), -1 - F.col("boundary").cast("long"), F.lit(-1_000_000).cast("long"))
    edges = facets.select("eid", F.col("a").alias("src"), outside.alias("dst"))
    extra = edges.where("dst < 0").select(F.col("dst").alias("vid")).distinct().select("vid", F.col("vid").cast("double").alias("vol"), F.lit("fictitious").alias("kind"))
    return volumes.select("vid", "vol", F.lit("real").alias("kind")).unionByName(extra), edges


def curl(loops: DataFrame) -> DataFrame:
    """(i, j, v): edges by loops, from (loop_id, pos, eid, sign)."""
    return loops.groupBy(F.col("eid").alias("i"), F.col("loop_id").alias("j")).agg(F.sum("sign").cast("double").alias("v")).where("v <> 0")


def divergence(edges: DataFrame) -> DataFrame:
    """(i, j, v): vertices by edges: +1 where an edge (eid, src, dst) leaves and -1 where it arrives; fictitious ends don't count."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("i"), F.lit(1.0).alias("v")), F.struct(F.col("dst").alias("i"), F.lit(-1.0).alias("v")))).alias("e")
    return edges.select("eid", ends).where("e.i >= 0").select("e.i", F.col("eid").alias("j"), "e.v")


def facet_loops(edges: DataFrame, around: DataFrame) -> DataFrame:
    """(loop_id, pos, eid, sign): for each node the chain of dual edges around it; around is (node, eid).

    A node's edges are a bounded group (the facets that meet there), chained by shared ends from the smallest vertex on.
    """
    rows = around.join(edges.select("eid", "src", "dst"), "eid")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        left = {int(e): (int(a), int(b)) for e, a, b in sorted(zip(p["eid"], p["src"], p["dst"], strict=True))}
        degree: dict[int, int] = {}
        for a, b in left.values():
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
        ends = sorted(v for v, d in degree.items() if d == 1)
        at = ends[0] if ends else min(degree)
        out = []
        while left:
            near = [(e, 1 if a == at else -1, b if a == at else a) for e, (a, b) in left.items() if at in (a, b)]
            if not near:
                break
            e, sign, at = near[0]
            del left[e]
            out.append((int(p["node"].iloc[0]), len(out), e, sign))
        return pd.DataFrame(out, columns=["loop_id", "pos", "eid", "sign"])

    return rows.select("node", "eid", "src", "dst").groupBy("node").applyInPandas(run, "loop_id long, pos int, eid long, sign int")


def map_loops(loops: DataFrame, emap: DataFrame) -> DataFrame:
    """(loop_id, pos, eid, sign): loops on the coarse graph; emap is (eid, ceid, csign), ceid null inside a cluster.

    Edges inside clusters go; neighbours that undo each other cancel (at the ends of the list too); loops that vanish, and all
    but the first of equal ones (up to where they begin and which way they run), are dropped.
    """
    mapped = loops.join(emap, "eid").where("ceid is not null").select("loop_id", "pos", F.col("ceid").alias("eid"), (F.col("sign") * F.col("csign")).alias("sign"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("pos")
        chain: list[int] = []
        for e, s in zip(p["eid"], p["sign"], strict=True):
            x = int(s) * (1 + int(e))
            if chain and chain[-1] == -x:
                chain.pop()
            else:
                chain.append(x)
        while len(chain) >= 2 and chain[0] == -chain[-1]:
            chain = chain[1:-1]
        turned = [-x for x in reversed(chain)]
        forms = [c[k:] + c[:k] for c in (chain, turned) for k in range(len(c))]
        best = min(forms) if forms else []
        return pd.DataFrame({"loop_id": pd.Series([int(p["loop_id"].iloc[0])] * bool(best), dtype="int64"), "chain": pd.Series([best] if best else [], dtype=object)})

    chains = mapped.groupBy("loop_id").applyInPandas(run, "loop_id long, chain array<long>")
    unique = chains.groupBy("chain").agg(F.min("loop_id").alias("loop_id"))
    return unique.select("loop_id", F.posexplode("chain").alias("pos", "x")).select("loop_id", F.col("pos").cast("int").alias("pos"), (F.abs("x") - 1).alias("eid"), F.signum("x").cast("int").alias("sign"))


def edge_offsets(edges: DataFrame) -> DataFrame:
    """(eid, ndof, first): offsets of variable numbers of dofs; edges (eid, ndof). Ranges of ids are summed first."""
    from gridweave.session import staged

    dealt = staged(edges.select("eid", "ndof").repartitionByRange("eid").withColumn("part", F.spark_partition_id()), "offsets")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(F.col("part").alias("p")).agg(F.sum("ndof").alias("n")).select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy("eid").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(starts, F.col("part") == F.col("p")).select("eid", "ndof", (F.col("start") + F.coalesce(F.sum("ndof").over(inside), F.lit(0))).alias("first"))


def element_prolongation(clusters: pd.DataFrame) -> pd.DataFrame:
    """Of one cluster (i, j, a, b, c): inner unknowns from outer ones by least energy under the constraints of divergence.

    Rows hold the entries a of the energy and b of the constraints; the stationary point of the bordered system gives how the
    inner unknowns (c true) follow the outer ones.
    """
    ids = np.unique(np.concatenate([clusters["i"], clusters["j"]]))
    n = len(ids)
    a, b = np.zeros((n, n)), np.zeros((n, n))
    i, j = np.searchsorted(ids, clusters["i"]), np.searchsorted(ids, clusters["j"])
    a[i, j], b[i, j] = clusters["a"], clusters["b"]
    inner = np.zeros(n, bool)
    inner[i[clusters["c"].to_numpy(bool)]] = True
    outer = ~inner
    rows = b[np.abs(b).sum(axis=1) > 0]
    m = len(rows)
    k = np.block([[a[np.ix_(inner, inner)], rows[:, inner].T], [rows[:, inner], np.zeros((m, m))]])
    rhs = -np.vstack([a[np.ix_(inner, outer)], rows[:, outer]])
    x = np.linalg.lstsq(k, rhs, rcond=None)[0][: inner.sum()]
    r, c = np.nonzero(np.abs(x) > 1e-14)
    return pd.DataFrame({"i": ids[inner][r], "j": ids[outer][c], "v": x[r, c]})


def loop_table(loops: DataFrame, edges: DataFrame) -> DataFrame:
    """(loop_id, length, closed): the steps of each loop, and whether it comes back to where it began; edges (eid, src, dst)."""
    ends = loops.join(edges, "eid").select("loop_id", F.explode(F.array(F.struct(F.col("src").alias("v"), F.col("sign").alias("s")), F.struct(F.col("dst").alias("v"), (-F.col("sign")).alias("s")))).alias("e"))
    even = ends.groupBy("loop_id", F.col("e.v").alias("v")).agg(F.sum("e.s").alias("s")).groupBy("loop_id").agg(F.max(F.abs("s")).alias("s"))
    return loops.groupBy("loop_id").agg(F.count(F.lit(1)).alias("length")).join(even, "loop_id").select("loop_id", "length", (F.col("s") == 0).alias("closed"))


def loop(loops: DataFrame, loop_id: int) -> DataFrame:
    """(pos, eid, sign) of one loop."""
    return loops.where(F.col("loop_id") == loop_id).select("pos", "eid", "sign")


def preserved(edges: DataFrame, positions: DataFrame, component: int) -> DataFrame:
    """(i, x): the flow of a constant field across the facets that dual edges (eid, src, dst) stand for; positions are (vid, pos).

    These vectors have no divergence inside, and prolongations are to keep them. An end without a position counts as none.
    """
    at = lambda name: positions.select(F.col("vid").alias(name), F.get("pos", F.lit(component)).alias(f"x_{name}"))
    return edges.join(at("src"), "src").join(at("dst"), "dst").select(F.col("eid").alias("i"), (F.col("x_dst") - F.col("x_src")).alias("x"))
