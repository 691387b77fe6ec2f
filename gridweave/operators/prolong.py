"""Prolongations: piecewise constant, auxiliary-smoothed, classic, and the mixture of the last two.

Candidates of a row are ranked by a window over the row, whose size is bounded by the vertex's coarse neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.operators.linalg import diagonal, spgemm
from gridweave.sources.graphs import adjacency

#: Edge weights below this count as this in the smoothing.
FLOOR = 1e-8


def piecewise(vmap: DataFrame) -> DataFrame:
    """(i, j, v): one entry 1 for each mapped vertex."""
    return vmap.where("c is not null").select(F.col("f").alias("i"), F.col("c").alias("j"), F.lit(1.0).alias("v"))


def cluster_weights(edges: DataFrame, vmap: DataFrame) -> DataFrame:
    """(v, own, c, w): for each mapped vertex and coarse neighbour (its own cluster too), the sum of edge weights to it."""
    both = adjacency(edges.select("src", "dst", "w"))
    a, b = vmap.where("c is not null").select(F.col("f").alias("src"), F.col("c").alias("own")), vmap.where("c is not null").select(F.col("f").alias("dst"), "c")
    return both.join(a, "src").join(b, "dst").groupBy(F.col("src").alias("v"), "own", "c").agg(F.sum("w").alias("w"))


def aux_graph(edges: DataFrame, vmap: DataFrame, min_frac: float = 0.15, max_per_row: int = 3) -> DataFrame:
    """(v, c): the columns of each row. The own cluster always; others by falling weight while the weight is above
    ``min_frac`` of the running sum (which starts at 0.2 of the weight inside and includes the candidate) and of the largest,
    up to ``max_per_row`` in all, and none after the first that fails. Rows without a neighbour inside keep their own only.
    """
    w = cluster_weights(edges, vmap)
    inside = w.where("own = c").select("v", F.col("w").alias("inner"))
    others = w.where("own <> c").join(inside, "v")
    order = Window.partitionBy("v").orderBy(F.col("w").desc(), "c")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    ranked = others.withColumn("n", F.row_number().over(order)).withColumn("cw", F.lit(0.2) * F.col("inner") + F.sum("w").over(running))
    ranked = ranked.withColumn("largest", F.greatest(F.max("w").over(Window.partitionBy("v")), "inner"))
    ok = (F.col("w") > min_frac * F.col("cw")) & (F.col("w") >= min_frac * F.col("largest")) & (F.col("n") < max_per_row)
    kept = ranked.withColumn("ok", ok.cast("int")).withColumn("all_ok", F.min("ok").over(running)).where("all_ok = 1").select("v", "c")
    return vmap.where("c is not null").select(F.col("f").alias("v"), "c").unionByName(kept)


def aux_values(edges: DataFrame, vmap: DataFrame, graph: DataFrame, omega: float = 1.0) -> DataFrame:
    """(i, j, v): rows of (I - omega D^-1 A^) P, A^ the replacement matrix of the edges between a vertex and neighbours whose
    cluster is in its graph. Rows sum to one."""
    both = adjacency(edges.select("src", "dst", "w")).withColumn("w", F.greatest("w", F.lit(FLOOR)))
    near = both.join(vmap.where("c is not null").select(F.col("f").alias("dst"), "c"), "dst").select(F.col("src").alias("v"), "c", "w")
    used = near.join(graph, ["v", "c"]).groupBy("v", "c").agg(F.sum("w").alias("w"))
    total = used.groupBy("v").agg(F.sum("w").alias("d"))
    own = vmap.where("c is not null").select(F.col("f").alias("v"), "c")
    # omega w / d to each column, and 1 - omega more to the own one
    spread = used.join(total, "v").select("v", "c", (omega * F.col("w") / F.col("d")).alias("x"))
    stay = own.join(total, "v", "left").select("v", "c", F.when(F.col("d").isNull(), 1.0).otherwise(1.0 - omega).alias("x"))
    return spread.unionByName(stay).groupBy(F.col("v").alias("i"), F.col("c").alias("j")).agg(F.sum("x").alias("v"))


def aux_smoothed(edges: DataFrame, vmap: DataFrame, min_frac: float = 0.15, max_per_row: int = 3, omega: float = 1.0) -> DataFrame:
    return aux_values(edges, vmap, aux_graph(edges, vmap, min_frac, max_per_row), omega)


def classic(a: DataFrame, vmap: DataFrame, omega: float = 1.0) -> DataFrame:
    """(i, j, v): P - omega D^-1 A P with the piecewise P; only rows that are mapped."""
    p = piecewise(vmap)
    d = diagonal(a)
    ap = spgemm(a, p).join(d, "i").join(p.select("i").distinct(), "i", "left_semi").select("i", "j", (-omega * F.col("v") / F.col("d")).alias("v"))
    return p.unionByName(ap).groupBy("i", "j").agg(F.sum("v").alias("v"))


def semi_aux(a: DataFrame, edges: DataFrame, vmap: DataFrame, min_frac: float = 0.15, max_per_row: int = 3, max_classic: int = 5, omega: float = 1.0) -> DataFrame:
    """(i, j, v): classic rows where the matrix row meets mapped vertices only, of at most ``max_classic`` clusters; auxiliary
    rows elsewhere."""
    met = a.join(vmap.select(F.col("f").alias("j"), "c"), "j", "left").groupBy("i").agg(F.countDistinct("c").alias("n"), F.sum(F.col("c").isNull().cast("int")).alias("bad"))
    simple = met.where((F.col("bad") == 0) & (F.col("n") <= max_classic)).select("i")
    first = classic(a, vmap, omega).join(simple, "i", "left_semi")
    second = aux_smoothed(edges, vmap, min_frac, max_per_row, omega).join(simple, "i", "left_anti")
    return first.unionByName(second)


def improve(a: DataFrame, p: DataFrame, vmap: DataFrame, omega: float = 1.0) -> DataFrame:
    """(i, j, v): P - omega D^-1 A P without growing P's graph; what falls outside is added to the own cluster's column."""
    ap = spgemm(a, p).join(diagonal(a), "i").select("i", "j", (-omega * F.col("v") / F.col("d")).alias("v"))
    graph = p.select("i", "j", F.lit(True).alias("in"))
    own = vmap.where("c is not null").select(F.col("f").alias("i"), F.col("c").alias("own"))
    folded = ap.join(own, "i").join(graph, ["i", "j"], "left").select("i", F.when(F.col("in"), F.col("j")).otherwise(F.col("own")).alias("j"), "v")
    return p.select("i", "j", "v").unionByName(folded).groupBy("i", "j").agg(F.sum("v").alias("v"))


def embedded(a: DataFrame, edges: DataFrame, vmap: DataFrame, min_frac: float = 0.15, max_per_row: int = 3, omega: float = 1.0, improve_its: int = 0) -> DataFrame:
    """(i, j, v): the first member of each cluster stays piecewise; the others are smoothed improve_its + 1 times with a
    smaller step on a graph whose candidates are compared with the largest weight only; what falls outside is dealt equally
    to the row's columns."""
    steps = improve_its + 1
    small = 1 - (1 - omega) ** (1 / steps) if omega < 1 else omega
    w = cluster_weights(edges, vmap)
    largest = Window.partitionBy("v")
    order = Window.partitionBy("v").orderBy(F.col("w").desc(), "c")
    others = w.withColumn("largest", F.max("w").over(largest)).where("own <> c").withColumn("n", F.row_number().over(order))
    kept = others.where((F.col("w") >= min_frac * F.col("largest")) & (F.col("n") < max_per_row)).select("v", "c")
    own = vmap.where("c is not null").select(F.col("f").alias("v"), "c")
    first = own.groupBy("c").agg(F.min("v").alias("v")).select("v")
    graph = own.unionByName(kept.join(first, "v", "left_anti")).select(F.col("v").alias("i"), F.col("c").alias("j"))
    sizes = graph.groupBy("i").agg(F.count(F.lit(1)).alias("m"))
    p = piecewise(vmap)
    for _ in range(steps):
        ap = spgemm(a, p).join(diagonal(a), "i").join(first.select(F.col("v").alias("i")), "i", "left_anti").select("i", "j", (-small * F.col("v") / F.col("d")).alias("v"))
        placed = ap.join(graph.withColumn("in", F.lit(True)), ["i", "j"], "left")
        inside = placed.where("in").select("i", "j", "v")
        outside = placed.where("in is null").groupBy("i").agg(F.sum("v").alias("o")).join(sizes, "i").join(graph, "i").select("i", "j", (F.col("o") / F.col("m")).alias("v"))
        p = p.unionByName(inside).unionByName(outside).groupBy("i", "j").agg(F.sum("v").alias("v"))
    return p
