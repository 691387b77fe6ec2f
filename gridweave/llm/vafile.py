"""Exact top-k search with vector-approximation files.

Components are integers. The approximation file holds a byte for each component: the number of a cell of ``width`` integers, the
least width with which ``LEVELS`` cells cover the values of the table (cells of one integer where they fit, so that bounds are
tight). A search scans the cells only: the product with the cells' middles, give or take the sum of |q| times half a cell, bounds
every inner product from both sides. What can't reach the k-th best lower bound of its query is dropped. Exact vectors are read
for what is left, in the order of the bounds, in two reads: first each query's ``FIRST`` best, which give a k-th exact score, then
all others whose upper bound still reaches it, after which the result is certain (ties included). Bounds are computed in
floating point on integers small enough to be exact (float32 below 2**24, else float64), so none is wrong by rounding.

Scale: what is dealt to pairs of query and candidate blocks is cells, an eighth of the exact vectors, and each pair is one
cogrouped task that sends on what its own k-th lower bound leaves. Exact vectors move once for each read, by a join on
their row. The number of query blocks is what multiplies the cells' shuffle: it is the query count over ``QUERY_BLOCK``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.vectors import distinct_rows, matrix, valid_vectors
from gridweave.session import staged

QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 32_768
#: Cells of a component: a byte.
LEVELS = 256
#: Rows of each query that are read first, in multiples of k.
FIRST = 2
#: Queries that one numpy product takes at once.
STEP = 64


def cell_width(low: int, high: int, levels: int = LEVELS) -> int:
    """Integers of one cell, so that ``levels`` cells from ``low`` on reach ``high``."""
    return max(1, -(-(high - low + 1) // levels))


def approximations(v: np.ndarray, low: int, width: int) -> np.ndarray:
    """The cells of integer vectors, a byte each."""
    return ((v - low) // width).astype(np.uint8)


def scan(q: np.ndarray, cells: np.ndarray, low: int, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, lower, upper) by position: what may be among the k + 1 best of the block for each query.

    One more than k, as a query's own row may be one of them.
    """
    half = (width - 1) / 2
    reach = float(np.abs(q).sum(axis=1).max(initial=0)) * (max(abs(low), abs(low + width * LEVELS)) + width)
    kind = np.float32 if 4 * reach < 2**24 else np.float64
    middle = (cells.astype(kind) * kind(width) + kind(low + half)).T
    slack = np.abs(q).sum(axis=1) * half
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(q), STEP):
        product = (q[at : at + STEP].astype(kind) @ middle).astype(np.float64)
        near = slack[at : at + STEP, None]
        if len(cells) > k + 1:
            floor = np.partition(product, len(cells) - (k + 1), axis=1)[:, len(cells) - (k + 1), None] - near
            i, j = np.nonzero(product + near >= floor)
        else:
            i, j = (x.ravel() for x in np.indices(product.shape))
        out.append((i + at, j, product[i, j] - near[i, 0], product[i, j] + near[i, 0]))
    return tuple(np.concatenate([x[n] for x in out]) if out else np.zeros(0) for n in range(4))  # type: ignore[return-value]


def search(queries: DataFrame, candidates: DataFrame, k: int, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, levels: int = LEVELS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products with candidate rows other than its own.

    Both have (vec_id, vh, v array<bigint>), one row for each (vec_id, vh) (``distinct_rows``); a row is its own only with both
    equal. Vectors of one length are compared with one another only. Ranks start at 1 for each query row, ties go to the smaller
    id (of one id, to the smaller vh). A query with fewer candidates gets them all. Empty tables give an empty result.
    """
    span = candidates.agg(F.min(F.array_min("v")), F.max(F.array_max("v")), F.count(F.lit(1))).first()
    low, high = int(span[0] or 0), int(span[1] or 0)
    width = cell_width(low, high, levels)
    blocks_q, blocks_c = max(1, -(-queries.count() // query_block)), max(1, -(-span[2] // candidate_block))

    def quantise(batches):
        for b in batches:
            values = np.asarray(b.column("v").flatten())
            offsets = np.asarray(b.column("v").offsets)
            cells = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((offsets - offsets[0]).astype(np.int32)), pa.py_buffer(approximations(values, low, width))])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vh"), cells], ["vec_id", "vh", "cells"])

    file = staged(candidates.select("vec_id", "vh", "v").mapInArrow(quantise, "vec_id long, vh long, cells binary"), "va-cells")
    block = lambda n: F.pmod(F.xxhash64("vec_id", "vh"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("dim", F.size("v")).withColumn("qb", block(blocks_q)).withColumn("cb", every(blocks_c))
    right = file.withColumn("dim", F.length("cells")).withColumn("cb", block(blocks_c)).withColumn("qb", every(blocks_q))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            i, j, lower, upper = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        else:
            cells = np.frombuffer(b"".join(b["cells"].to_pylist()), np.uint8).reshape(b.num_rows, -1)
            i, j, lower, upper = scan(matrix(a["v"], np.int64), cells, low, width, k)
        return pa.table({"query_id": a["vec_id"].take(pa.array(i)), "qh": a["vh"].take(pa.array(i)), "vec_id": b["vec_id"].take(pa.array(j)), "vh": b["vh"].take(pa.array(j)), "lower": lower, "upper": upper})

    keys = ["dim", "qb", "cb"]
    left_of, right_of = left.groupBy(*keys), right.groupBy(*keys)
    schema = "query_id long, qh long, vec_id long, vh long, lower double, upper double"
    bounds = left_of.cogroup(right_of).applyInArrow(run, schema).where("query_id <> vec_id or qh <> vh")
    bounds = staged(bounds, "va-bounds")
    me = Window.partitionBy("query_id", "qh")
    # the k-th best lower bound of all blocks
    kth = bounds.withColumn("n", F.row_number().over(me.orderBy(F.col("lower").desc()))).where(F.col("n") == k).select("query_id", "qh", F.col("lower").alias("floor"))
    left_over = bounds.join(kth, ["query_id", "qh"], "left").where("floor is null or upper >= floor")
    ordered = staged(left_over.withColumn("n", F.row_number().over(me.orderBy(F.col("upper").desc(), "vec_id", "vh"))).select("query_id", "qh", "vec_id", "vh", "upper", "n"), "va-order")
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("vh").alias("qh"), F.col("v").alias("q"))
    product = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)

    def exact(rows: DataFrame) -> DataFrame:
        return rows.join(candidates, ["vec_id", "vh"]).join(asked, ["query_id", "qh"]).select("query_id", "qh", "vec_id", "vh", product.alias("score"))

    best = me.orderBy(F.col("score").desc(), "vec_id", "vh")
    first = staged(exact(ordered.where(F.col("n") <= FIRST * k)), "va-first")
    certain = first.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("query_id", "qh", F.col("score").alias("least"))
    rest = ordered.where(F.col("n") > FIRST * k).join(certain, ["query_id", "qh"]).where("upper >= least")
    found = first.unionByName(exact(rest.select("query_id", "qh", "vec_id", "vh")))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, vh, v array<bigint>) with floor(scale * x) for each component x as double; invalid vectors are left out.

    Rows that are equal in id and vector count once.
    """
    rows = distinct_rows(valid_vectors(vectors))
    return rows.select("vec_id", "vh", F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def top_k(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Search with the rows whose id is divisible by ``every`` against all rows."""
    rows = staged(integer_vectors(vectors), "va")
    return search(rows.where(F.col("vec_id") % every == 0), rows, k)
