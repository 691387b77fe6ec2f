"""Sparse linear algebra as relations: matrices (i, j, v), vectors (i, x); an absent entry is zero.

Products are an equi-join on the inner index and a sum by the outer ones, which aggregates partially before its shuffle.
Whether a vector is broadcast is left to its measured size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spmv(a: DataFrame, x: DataFrame) -> DataFrame:
    """y = A x."""
    return a.join(x.select(F.col("i").alias("j"), "x"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("x"))


def spmv_t(a: DataFrame, x: DataFrame) -> DataFrame:
    """y = A^T x."""
    return spmv(transpose(a), x)


def axpy(alpha: float, x: DataFrame, y: DataFrame, beta: float = 1.0) -> DataFrame:
    """alpha x + beta y, by a union and a sum rather than an outer join."""
    return x.select("i", (F.col("x") * alpha).alias("x")).unionByName(y.select("i", (F.col("x") * beta).alias("x"))).groupBy("i").agg(F.sum("x").alias("x"))


def dot(x: DataFrame, y: DataFrame) -> float:
    got = x.join(y.select("i", F.col("x").alias("y")), "i").agg(F.sum(F.col("x") * F.col("y"))).first()[0]
    return float(got or 0.0)


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def transpose_blocks(a: DataFrame, rows: int, cols: int) -> DataFrame:
    """Of a block matrix (v row-major, rows * cols entries): the blocks are transposed too."""
    turned = F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda k: F.get(F.col("v"), ((k % rows) * cols + F.floor(k / rows)).cast("int")))
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), turned.alias("v"))


def spgemm(a: DataFrame, b: DataFrame) -> DataFrame:
    """A B."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("va")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("vb"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


def rap(a: DataFrame, p: DataFrame) -> DataFrame:
    """The Galerkin product P^T A P, as (P^T A) P."""
    return spgemm(spgemm(transpose(p), a), p)


def rap_with_factor(a: DataFrame, p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P^T (A P), and A P to be used again."""
    from gridweave.session import staged

    ap = staged(spgemm(a, p), "ap")
    return spgemm(transpose(p), ap), ap


def add(alpha: float, a: DataFrame, beta: float, b: DataFrame) -> DataFrame:
    """alpha A + beta B."""
    return reduce(DataFrame.unionByName, [m.select("i", "j", (F.col("v") * s).alias("v")) for s, m in ((alpha, a), (beta, b))]).groupBy("i", "j").agg(F.sum("v").alias("v"))


def compress(a: DataFrame, tol: float = 1e-20) -> DataFrame:
    """Without entries of absolute value up to ``tol`` (negative ones count by their size)."""
    return a.where(F.abs("v") > tol)


def restrict_to_blocks(a: DataFrame, row_block: DataFrame, col_block: DataFrame, pairs: DataFrame) -> DataFrame:
    """Entries whose (row block, column block) is in ``pairs`` (rb, cb); rows with a block keep nothing else, other rows all.

    row_block and col_block are (i, b).
    """
    rows, cols = row_block.select("i", F.col("b").alias("rb")), col_block.select(F.col("i").alias("j"), F.col("b").alias("cb"))
    blocked = a.join(rows, "i", "left").join(cols, "j", "left").join(pairs.withColumn("_in", F.lit(True)), ["rb", "cb"], "left")
    return blocked.where("rb is null or _in").select("i", "j", "v")


def identity(ids: DataFrame) -> DataFrame:
    """From ids (i)."""
    return ids.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))


def flatten(a: DataFrame, rows: int, cols: int) -> DataFrame:
    """Scalar entries of a block matrix."""
    return a.select("i", "j", F.posexplode("v").alias("k", "x")).select(
        (F.col("i") * rows + F.floor(F.col("k") / cols)).cast("long").alias("i"), (F.col("j") * cols + F.col("k") % cols).cast("long").alias("j"), F.col("x").alias("v"))


def reblock(a: DataFrame, big: int, small: int) -> DataFrame:
    """Blocks of size big x big as blocks of size small x small, with entries that are all zero left out."""
    n = big // small
    parts = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda t: F.struct(t.alias("t"), F.transform(
        F.sequence(F.lit(0), F.lit(small * small - 1)),
        lambda k: F.get(F.col("v"), ((F.floor(t / n) * small + F.floor(k / small)) * big + (t % n) * small + k % small).cast("int"))).alias("v")))).alias("p")
    out = a.select("i", "j", parts).select((F.col("i") * n + F.floor(F.col("p.t") / n)).cast("long").alias("i"), (F.col("j") * n + F.col("p.t") % n).cast("long").alias("j"), F.col("p.v").alias("v"))
    return out.where(F.exists("v", lambda x: x != 0))


def embed(a: DataFrame, row_map: DataFrame, col_map: DataFrame) -> DataFrame:
    """A in a larger matrix: maps (f, c) give the new row and column."""
    rows, cols = row_map.select(F.col("f").alias("i"), F.col("c").alias("ni")), col_map.select(F.col("f").alias("j"), F.col("c").alias("nj"))
    return a.join(rows, "i").join(cols, "j").select(F.col("ni").alias("i"), F.col("nj").alias("j"), "v")


def assemble(elements: DataFrame) -> DataFrame:
    """From element matrices (dofs array<long>, mat array<double> row-major): entries summed over elements."""
    n = F.size("dofs")
    at = F.posexplode("mat").alias("k", "v")
    e = elements.select("dofs", n.alias("n"), at)
    return e.select(F.get("dofs", F.floor(F.col("k") / F.col("n")).cast("int")).alias("i"), F.get("dofs", (F.col("k") % F.col("n")).cast("int")).alias("j"), "v").groupBy("i", "j").agg(F.sum("v").alias("v"))


def split_by_part(a: DataFrame, part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A = M + G: entries between rows of one part, and those across parts; part is (i, p)."""
    both = a.join(part.select("i", F.col("p").alias("pi")), "i").join(part.select(F.col("i").alias("j"), F.col("p").alias("pj")), "j")
    return both.where("pi = pj").select("i", "j", "v"), both.where("pi <> pj").select("i", "j", "v")


def row_blocks(a: DataFrame) -> DataFrame:
    """(i, chunk, block): consecutive rows with the same columns are one chunk (named by its first row), and chunks with the
    same columns one block (named by its smallest row).

    The column lists are compared by hash and the hash groups verified by the list itself, being part of the key.
    """
    lists = a.groupBy("i").agg(F.array_sort(F.collect_set("j")).alias("cols"))
    keyed = lists.withColumn("h", F.xxhash64("cols"))
    # rows of one column list, by islands of consecutive numbers
    w = Window.partitionBy("h", "cols").orderBy("i")
    island = F.col("i") - F.row_number().over(w)
    numbered = keyed.withColumn("g", island)
    chunk = F.min("i").over(Window.partitionBy("h", "cols", "g"))
    block = F.min("i").over(Window.partitionBy("h", "cols"))
    return numbered.select("i", chunk.alias("chunk"), block.alias("block"))


def counts(a: DataFrame) -> DataFrame:
    """(rows, nnz, bytes): entries, rows that have any, and the bytes of a compressed-row store of doubles and 4-byte indices."""
    return a.agg(F.countDistinct("i").alias("rows"), F.count(F.lit(1)).alias("nnz")).select("rows", "nnz", (F.col("nnz") * 12 + (F.col("rows") + 1) * 8).alias("bytes"))


def row_errors(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, err): the largest difference in a row relative to the largest entry of A there."""
    both = a.select("i", "j", F.col("v").alias("va"), F.lit(0.0).alias("vb")).unionByName(b.select("i", "j", F.lit(0.0).alias("va"), F.col("v").alias("vb")))
    entry = both.groupBy("i", "j").agg(F.sum("va").alias("va"), F.sum("vb").alias("vb"))
    return entry.groupBy("i").agg((F.max(F.abs(F.col("va") - F.col("vb"))) / F.greatest(F.max(F.abs("va")), F.lit(1e-300))).alias("err"))


def diagonal(a: DataFrame) -> DataFrame:
    """(i, d)."""
    return a.where("i = j").select("i", F.col("v").alias("d"))


def hybrid_diagonal(a: DataFrame, part: DataFrame) -> DataFrame:
    """(i, d): d * max(1, 0.51 (1 + sum of |g_ij| / sqrt(d_i d_j))) over entries that cross parts."""
    _, g = split_by_part(a, part)
    d = diagonal(a)
    crossing = g.join(d, "i").join(d.select(F.col("i").alias("j"), F.col("d").alias("dj")), "j")
    sums = crossing.groupBy("i").agg(F.sum(F.abs("v") / F.sqrt(F.col("d") * F.col("dj"))).alias("s"))
    factor: Column = F.greatest(F.lit(1.0), F.lit(0.51) * (F.lit(1.0) + F.coalesce("s", F.lit(0.0))))
    return d.join(sums, "i", "left").select("i", (F.col("d") * factor).alias("d"))
