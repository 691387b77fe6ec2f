"""Coarse graphs from a vertex map (f, c); c is null for vertices that are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.sources.graphs import Graph, adjacency, enumerate_rows


def map_vertices(clusters: DataFrame) -> DataFrame:
    """(f, c): clusters numbered from 0 in the order of their names; null stays null."""
    names = enumerate_rows(clusters.where("c is not null").select(F.col("c").alias("name")).distinct(), "name", "number")
    return clusters.join(names, F.col("c") == F.col("name"), "left").select("f", F.col("number").cast("long").alias("c"))


def map_edges(edges: DataFrame, vmap: DataFrame) -> DataFrame:
    """(src, dst, w, csrc, cdst): each edge with its coarse edge, null inside a cluster or where an end is dropped."""
    a, b = vmap.select(F.col("f").alias("src"), F.col("c").alias("ca")), vmap.select(F.col("f").alias("dst"), F.col("c").alias("cb"))
    j = edges.join(a, "src", "left").join(b, "dst", "left")
    kept = F.col("ca").isNotNull() & F.col("cb").isNotNull() & (F.col("ca") != F.col("cb"))
    return j.select("src", "dst", "w", F.when(kept, F.least("ca", "cb")).alias("csrc"), F.when(kept, F.greatest("ca", "cb")).alias("cdst"))


def coarse_edges(edges: DataFrame, vmap: DataFrame) -> DataFrame:
    """(src, dst, w): sums of the edges that are mapped to one coarse edge."""
    m = map_edges(edges, vmap).where("csrc is not null")
    return m.groupBy(F.col("csrc").alias("src"), F.col("cdst").alias("dst")).agg(F.sum("w").alias("w"))


def coarse_vertices(graph: Graph, vmap: DataFrame) -> DataFrame:
    """(vid, w, cnt, free): sums over members; edges to dropped vertices add their weight to the end that stays."""
    members = graph.vertices.join(vmap.select(F.col("f").alias("vid"), "c"), "vid").where("c is not null").select("c", "w", "cnt")
    both = adjacency(graph.edges.select("src", "dst", "w"))
    a, b = vmap.select(F.col("f").alias("src"), "c"), vmap.select(F.col("f").alias("dst"), F.col("c").alias("cb"))
    ground = both.join(a, "src").join(b, "dst", "left").where("c is not null and cb is null").select("c", "w", F.lit(0.0).alias("cnt"))
    return members.unionByName(ground).groupBy(F.col("c").alias("vid")).agg(F.sum("w").alias("w"), F.sum("cnt").alias("cnt")).withColumn("free", F.lit(True))


def coarse_graph(graph: Graph, vmap: DataFrame) -> Graph:
    return Graph(coarse_vertices(graph, vmap), coarse_edges(graph.edges, vmap))


def reverse_map(vmap: DataFrame) -> DataFrame:
    """(c, members): the fine vertices of each coarse one, sorted."""
    return vmap.where("c is not null").groupBy("c").agg(F.array_sort(F.collect_list("f")).alias("members"))


def concatenate(first: DataFrame, second: DataFrame) -> DataFrame:
    """(f, c): one map after the other; null where either drops the vertex."""
    return first.join(second.select(F.col("f").alias("m"), F.col("c").alias("nc")), F.col("c") == F.col("m"), "left").select("f", F.col("nc").alias("c"))


def reduce_table(table: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    """Rows of several contributors reduced by key: any aggregate, partial before the shuffle and final after it."""
    return table.groupBy(key).agg(*[c.alias(n) for n, c in aggregates.items()])


def coarse_stokes(vertices: DataFrame, edges: DataFrame, vmap: DataFrame, tol: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, w, vol) and oriented edges (src, dst, flow) of the coarse graph.

    Weights add up, and so do volumes of real members (vol > 0); a cluster with a fictitious member (vol < 0) has the volume of
    its first such one. Flows add with orientation; a sum that is tiny against the absolute sum is exactly 0.
    """
    j = vertices.join(vmap.select(F.col("f").alias("vid"), "c"), "vid").where("c is not null")
    fictitious = F.min_by("vol", F.when(F.col("vol") < 0, F.col("vid")))
    out = j.groupBy(F.col("c").alias("vid")).agg(F.sum("w").alias("w"), F.coalesce(fictitious_only(fictitious), F.sum("vol")).alias("vol"))
    a, b = vmap.select(F.col("f").alias("src"), F.col("c").alias("ca")), vmap.select(F.col("f").alias("dst"), F.col("c").alias("cb"))
    e = edges.join(a, "src").join(b, "dst").where("ca is not null and cb is not null and ca <> cb")
    signed = F.when(F.col("ca") < F.col("cb"), F.col("flow")).otherwise(-F.col("flow"))
    sums = e.groupBy(F.least("ca", "cb").alias("src"), F.greatest("ca", "cb").alias("dst")).agg(F.sum(signed).alias("s"), F.sum(F.abs("flow")).alias("t"))
    return out, sums.select("src", "dst", F.when(F.abs("s") <= tol * F.col("t"), F.lit(0.0)).otherwise(F.col("s")).alias("flow"))


def fictitious_only(column: Column) -> Column:
    """Null where there is no fictitious member: the volume that min_by gives then isn't negative."""
    return F.when(column < 0, column)
