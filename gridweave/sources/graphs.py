"""Graphs and matrices from tables and generators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """vertices (vid, w, cnt, free, ...) and edges (src, dst, w, ...) with src < dst, each pair once."""

    vertices: DataFrame
    edges: DataFrame

    @property
    def adjacency(self) -> DataFrame:
        """(src, dst, w): every edge from both ends."""
        return adjacency(self.edges)


def adjacency(edges: DataFrame) -> DataFrame:
    """Every edge from both ends, in one pass: an explode of two rows rather than a union of two scans."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
    return edges.select(ends, *rest).select("e.src", "e.dst", *rest)


def copurchase(lineitem: DataFrame, least: int = 1) -> DataFrame:
    """(src, dst, w): parts bought together; w counts orders, and edges with fewer than ``least`` are left out.

    An order has few lines, so pairs within an order are linear in the lines; the count aggregates partially before its shuffle.
    """
    lines = lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    parts = lines.groupBy("o").agg(F.array_sort(F.collect_list("p")).alias("ps")).where("size(ps) > 1")
    a = parts.select("ps", F.posexplode("ps").alias("k", "src"))
    pairs = a.select("src", F.explode(F.expr("slice(ps, k + 2, size(ps))")).alias("dst"))
    counted = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c"))
    return counted.where(F.col("c") >= least).select("src", "dst", F.col("c").cast("double").alias("w"))


def vertices_of(edges: DataFrame, free: Column | None = None) -> DataFrame:
    """(vid, w, cnt, free) for the ends of the edges, without weight of their own."""
    ids = adjacency(edges).select(F.col("src").alias("vid")).distinct()
    return ids.select("vid", F.lit(0.0).alias("w"), F.lit(1.0).alias("cnt"), (F.lit(True) if free is None else free).alias("free"))


def grid(spark: SparkSession, k: int, dim: int = 2, jump: float = 1.0, band: int = 4, kind: str = "fibres") -> Graph:
    """A grid of k**dim vertices with ``pos``; edges inside the second material weigh ``jump``.

    fibres: every other band of rows; inclusions: the middle third in all directions.
    """
    n = k**dim
    coordinate = lambda v, d: F.floor(v / F.lit(k**d)) % k
    ids = spark.range(n).select(F.col("id").alias("vid"))
    inside = lambda v: (
        (F.floor(coordinate(v, 1) / band) % 2 == 1) if kind == "fibres" else _all([(coordinate(v, d) * 3 >= k) & (coordinate(v, d) * 3 < 2 * k) for d in range(dim)])
    )
    vertices = ids.select("vid", F.lit(0.0).alias("w"), F.lit(1.0).alias("cnt"), F.lit(True).alias("free"), F.array(*[coordinate(F.col("vid"), d).cast("double") for d in range(dim)]).alias("pos"))
    steps = F.explode(F.array(*[F.struct(F.lit(k**d).cast("long").alias("step"), (coordinate(F.col("vid"), d) < k - 1).alias("ok")) for d in range(dim)])).alias("s")
    edges = ids.select("vid", steps).where("s.ok").select(F.col("vid").alias("src"), (F.col("vid") + F.col("s.step")).alias("dst"))
    both = inside(F.col("src")) & inside(F.col("dst"))
    return Graph(vertices, edges.select("src", "dst", F.when(both, F.lit(float(jump))).otherwise(1.0).alias("w")))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def user_user(events: DataFrame) -> DataFrame:
    """(src, dst, w): users that share (event_type, hour); w counts shared slots."""
    from gridweave.operators.shared import sharing

    slots = events.select("user_id", "event_type", F.date_trunc("hour", "ts").alias("h")).dropna().distinct()
    # the hour is a number and comes first, so a slot's name says both
    return sharing(slots.select(F.col("user_id").alias("member"), F.concat_ws(" ", F.unix_seconds("h").cast("string"), "event_type").alias("slot")))


def laplacian(edges: DataFrame, shift: float = 1.0) -> DataFrame:
    """(i, j, v): minus the weights off the diagonal, and their sum plus ``shift`` on it."""
    adj = adjacency(edges)
    diagonal = adj.groupBy(F.col("src").alias("i")).agg((F.sum("w") + F.lit(shift)).alias("v")).select("i", F.col("i").alias("j"), "v")
    return adj.select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("w")).alias("v")).unionByName(diagonal)


def enumerate_rows(df: DataFrame, id_col: str, name: str) -> DataFrame:
    """Consecutive numbers from 0 in the order of an id, by ranges: counts of ranges (few rows) plus ranks within a range."""
    from gridweave.session import staged

    dealt = staged(df.repartitionByRange(F.col(id_col)).withColumn("_part", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(id_col)
    return dealt.join(starts, F.col("_part") == F.col("_p")).withColumn(name, F.col("_start") + F.row_number().over(inside) - 1).drop("_part", "_p", "_start")
