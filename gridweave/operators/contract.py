"""Contraction: the pieces of several parts become pieces of fewer parts, with their data, vectors, matrices, maps and loops.

A piece knows its part: vertices (p, v, ...) have local numbers v, and ``nodes`` (p, v, g) says which global vertex g a local one
is a copy of; the smallest part that has a vertex owns it. ``groups`` (p, q) says which part each one goes to. On DataFrames,
contraction is a join with the groups and one aggregation; local numbers of the new parts follow the global ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scatter(values: DataFrame, nodes: DataFrame) -> DataFrame:
    """(p, v, x): the owners' values (g, x) at all copies."""
    return nodes.join(values, "g").select("p", "v", "x")


def gather(copies: DataFrame, nodes: DataFrame, distributed: bool = True) -> DataFrame:
    """(g, x) from copies (p, v, x): sums if each part holds a share, else the owner's value."""
    j = copies.join(nodes, ["p", "v"]).groupBy("g")
    return j.agg((F.sum("x") if distributed else F.min(F.struct("p", "x"))["x"]).alias("x"))


def contract_nodes(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(p, v, g, q, u): the new part and the new local number of every local vertex; copies that meet in one part become one."""
    moved = nodes.join(groups, "p")
    numbers = moved.select("q", "g").distinct().withColumn("u", F.row_number().over(Window.partitionBy("q").orderBy("g")) - 1)
    return moved.join(numbers, ["q", "g"]).select("p", "v", "g", "q", F.col("u").cast("long").alias("u"))


def contract_data(data: DataFrame, mapping: DataFrame, distributed: bool) -> DataFrame:
    """(q, u, x) from node data (p, v, x): shares are summed; data that all copies hold whole is taken from the smallest part."""
    j = data.join(mapping, ["p", "v"]).groupBy("q", "u")
    return j.agg((F.sum("x") if distributed else F.min(F.struct("p", "x"))["x"]).alias("x"))


def contract_edges(edges: DataFrame, mapping: DataFrame, distributed: bool = True) -> DataFrame:
    """(q, src, dst, w) from edges (p, src, dst, w) between local vertices; edges that meet in one part become one.

    An edge between vertices that were apart in the old parts needs no care: its ends are looked up by themselves.
    """
    end = lambda name, to: mapping.select("p", F.col("v").alias(name), "q", F.col("u").alias(to))
    j = edges.join(end("src", "a"), ["p", "src"]).join(end("dst", "b").drop("q"), ["p", "dst"])
    j = j.groupBy("q", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    return j.agg((F.sum("w") if distributed else F.min(F.struct("p", "w"))["w"]).alias("w"))


def contract_vector(x: DataFrame, mapping: DataFrame, distributed: bool = True) -> DataFrame:
    """(q, u, x): a vector on the old parts on the new ones."""
    return contract_data(x, mapping, distributed)


def expand_vector(x: DataFrame, mapping: DataFrame) -> DataFrame:
    """(p, v, x): a vector (q, u, x) on the new parts at all copies of the old ones."""
    return x.join(mapping, ["q", "u"]).select("p", "v", "x")


def contract_matrix(a: DataFrame, mapping: DataFrame) -> DataFrame:
    """(q, i, j, v): matrices (p, i, j, v) of the old parts, added up in the new ones."""
    row = mapping.select("p", F.col("v").alias("i"), "q", F.col("u").alias("r"))
    col = mapping.select("p", F.col("v").alias("j"), F.col("u").alias("c"))
    return a.join(row, ["p", "i"]).join(col, ["p", "j"]).groupBy("q", F.col("r").alias("i"), F.col("c").alias("j")).agg(F.sum("v").alias("v"))


def pull_prolongation(prol: DataFrame, fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """(q, i, j, v): the prolongation between contracted spaces that does on them what (p, i, j, v) does on the old ones.

    Rows of copies agree, so each row is taken from the smallest part that has it.
    """
    row = fine.select("p", F.col("v").alias("i"), "q", F.col("u").alias("r"))
    col = coarse.select("p", F.col("v").alias("j"), F.col("u").alias("c"))
    j = prol.join(row, ["p", "i"]).join(col, ["p", "j"])
    return j.groupBy("q", F.col("r").alias("i"), F.col("c").alias("j")).agg(F.min(F.struct("p", "v"))["v"].alias("v"))


def contract_loops(loops: DataFrame, edge_mapping: DataFrame) -> DataFrame:
    """(q, loop_id, pos, eid, sign): loops (p, loop_id, pos, eid, sign), of which each part holds the steps on its edges.

    ``edge_mapping`` is (p, eid, q, ceid, csign), csign -1 where an edge turns round. Steps that several parts hold become one, and
    positions are counted anew in each new part.
    """
    j = loops.join(edge_mapping, ["p", "eid"]).select("q", "loop_id", "pos", F.col("ceid").alias("eid"), (F.col("sign") * F.col("csign")).cast("int").alias("sign")).distinct()
    return j.select("q", "loop_id", (F.row_number().over(Window.partitionBy("q", "loop_id").orderBy("pos", "eid")) - 1).alias("pos"), "eid", "sign")
