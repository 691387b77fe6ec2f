"""Products of a symmetric matrix with itself, whole or where it has an entry, by blocks of rows.

A block of rows is sent the rows that its columns name, each once, and makes its rows of the product alone: neither the pairs of a
row's and a neighbour's entries nor partial sums are shuffled. What is sent are the entries times the blocks that meet a row.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.operators import packed
from gridweave.operators.packed import Block, Packed, State, firsts, spread, summed
from gridweave.session import staged
from gridweave.sources.graphs import adjacency

#: Entries of a block of rows: of a product, and of common neighbours; pairs of entries at once.
ROWS, NEIGHBOURS, AT_ONCE = 600_000, 2_400_000, 1_500_000


def send(b: Block, s: State) -> list[tuple[int, tuple]]:
    """(block, (rows, lens, cols, vals)): rows to the blocks of their columns, and to their own; of a graph without the diagonal, as weights."""
    if s["graph"]:
        row, col, val = packed.edges(b)
        b = packed.block_of_rows(row, col, val, b.first, b.first + len(b.ends))
    n, lens = len(b.ends), b.lens()
    first, vals = b.ends - lens, packed.slim(b.vals)
    home = np.searchsorted(s["bounds"], b.cols, "right") - 1
    own = np.searchsorted(s["bounds"], np.arange(b.first, b.first + n), "right") - 1
    pairs = np.unique(np.concatenate([home * n + (b.rows() - b.first), own * n + np.arange(n)]))
    home, row = np.divmod(pairs, n)
    out = []
    for lo, hi in zip(firsts(home), np.append(firsts(home)[1:], len(home)), strict=True):
        r = row[lo:hi]
        at = spread(first[r], lens[r])
        out.append((int(home[lo]), ((r + b.first).astype(np.int32), lens[r].astype(np.int32), b.cols[at], vals[at] if s["values"] else vals[:0])))
    return out


def received(parts: list[tuple], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lens) by row, and the entries."""
    rows, lens, cols, vals = (np.concatenate([p[k] for p in parts]) for k in range(4))
    start, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
    start[rows], count[rows] = np.cumsum(lens, dtype=np.int64) - lens, lens
    return start, count, cols, vals


def pieces(row: np.ndarray, cost: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of entries of about AT_ONCE in all."""
    total = np.cumsum(cost)
    lo = 0
    while lo < len(cost):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + AT_ONCE, "right")))
        yield lo, hi
        lo = hi


def product_rows(to: int, parts: list[tuple], s: State) -> Iterator[pa.RecordBatch]:
    """The rows of A A in a block, a few at a time."""
    start, count, cols, vals = received(parts, s["columns"])
    ids, lo, hi = s["ids"], int(s["bounds"][to]), int(s["bounds"][to + 1])
    mine = np.arange(lo, hi)
    each = np.add.reduceat(np.append(count[cols[spread(start[mine], count[mine])]], 0), np.cumsum(count[mine]) - count[mine])
    for a, z in pieces(mine, np.where(count[mine] > 0, each, 0)):
        at = spread(start[mine[a:z]], count[mine[a:z]])
        row, k = np.repeat(mine[a:z], count[mine[a:z]]), cols[at]
        to_ = spread(start[k], count[k])
        r, c, v = summed(np.repeat(row, count[k]), cols[to_], np.repeat(vals[at].astype(float), count[k]) * vals[to_], s["columns"])
        yield pa.record_batch({"i": pa.array(ids[r]), "j": pa.array(ids[c]), "v": pa.array(v)})


def upper(to: int, parts: list[tuple], s: State) -> Iterator[tuple]:
    """A few of a block's edges src < dst at a time: (src, dst, at, x, y), ``at`` an edge for each common neighbour, x and y the weights of
    that neighbour's edges to src and dst."""
    start, count, cols, vals = received(parts, s["columns"])
    lo, hi = int(s["bounds"][to]), int(s["bounds"][to + 1])
    names, local = np.unique(cols, return_inverse=True)
    mine = np.arange(lo, hi)
    src, dst = np.repeat(mine, count[mine]), cols[spread(start[mine], count[mine])]
    up = dst > src
    src, dst = src[up], dst[up]
    for a, z in pieces(src, count[dst] + count[src] // 8):
        x, y = src[a:z], dst[a:z]
        rows, at = np.unique(x, return_inverse=True)
        mine_, of = np.repeat(np.arange(len(rows)), count[rows]), spread(start[rows], count[rows])
        mark = np.zeros(len(rows) * len(names), bool)
        mark[mine_ * len(names) + local[of]] = True
        other = spread(start[y], count[y])
        cell = np.repeat(at * len(names), count[y]) + local[other]
        hit = np.flatnonzero(mark[cell])
        edge = np.searchsorted(np.cumsum(count[y]), hit, "right")
        if not s["values"]:
            yield x, y, edge, None, None
            continue
        place = np.zeros(len(mark), np.int32)
        place[mine_ * len(names) + local[of]] = np.arange(len(of))
        yield x, y, edge, vals[of[place[cell[hit]]]].astype(float), vals[other[hit]].astype(float)


def common_rows(to: int, parts: list[tuple], s: State) -> Iterator[pa.RecordBatch]:
    """(src, dst, common) for a block's edges src < dst."""
    ids = s["ids"]
    for x, y, edge, _, _ in upper(to, parts, s):
        yield pa.record_batch({"src": pa.array(ids[x]), "dst": pa.array(ids[y]), "common": pa.array(np.bincount(edge, minlength=len(x)).astype(np.int32))})


def robust_rows(to: int, parts: list[tuple], s: State) -> Iterator[pa.RecordBatch]:
    """(src, dst, soc) of ``cluster.robust_soc_scalar`` for a block's edges src < dst."""
    start, count, cols, vals = received(parts, s["columns"])
    ids, d, mine = s["ids"], s["d"], np.arange(int(s["bounds"][to]), int(s["bounds"][to + 1]))
    own = spread(start[mine], count[mine])
    w = vals[own][cols[own] > np.repeat(mine, count[mine])].astype(float)
    done = 0
    for x, y, edge, wi, wj in upper(to, parts, s):
        e = w[done : done + len(x)] + np.bincount(edge, wi * wj / (wi + wj), len(x))
        done += len(x)
        c = d[x] * d[y] / (d[x] + d[y])
        yield pa.record_batch({"src": pa.array(ids[x]), "dst": pa.array(ids[y]), "soc": pa.array(np.divide(e, c, out=np.zeros_like(e), where=c > 0))})


def by_reach(a: Any, f, schema: str, entries: int, more: State) -> DataFrame:
    """f of every block of rows of a symmetric matrix and the rows that it meets; the matrix is (i, j, v), or blocks with ``spark``, ``a`` and
    ``ids`` (see ``bulk.Source``), which are dropped."""
    spark, p, ids = (a.sparkSession, *_blocks(a)) if isinstance(a, DataFrame) else (a.spark, a.a, a.ids)
    bounds = packed.bounds_of(p.lens, entries)
    s: State = {"bounds": bounds, "columns": len(ids), "ids": ids} | more
    state = spark.sparkContext.broadcast(s)

    def gather(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("source").to_numpy(), kind="stable")
        parts = [t.column("part")[int(k)].as_py() for k in order]
        return pa.table({"to": t.column("to")[:1], "part": pa.array([pickle.dumps(parts, protocol=5)], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for to, part in zip(t.column("to"), t.column("part"), strict=True):
                yield from f(to.as_py(), [packed.unwired(x) for x in pickle.loads(part.as_buffer())], state.value)

    blocks = max(1, len(bounds) - 1)
    held = staged(packed.messages(spark, p, send, state, s).repartition(min(blocks, 2000), "to").groupBy("to").applyInArrow(gather, "to long, part binary"), "reach")
    p.drop()
    return held.mapInArrow(run, schema)


def _blocks(a: DataFrame) -> tuple[Packed, np.ndarray]:
    got = a.groupBy("i").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("i")
    ids, lens = got["i"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    return packed.pack(a, ids, lens), ids


def squared(a: Any) -> DataFrame:
    """A A as (i, j, v), for a symmetric A as ``by_reach`` takes it."""
    return by_reach(a, product_rows, "i long, j long, v double", ROWS, {"values": True, "graph": False})


def common_neighbours(edges: Any) -> DataFrame:
    """(src, dst, common): for every edge, the vertices next to both ends. Edges are (src, dst), or off the diagonal of blocks."""
    if isinstance(edges, DataFrame):
        edges = adjacency(edges.select("src", "dst")).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.0).alias("v"))
    return by_reach(edges, common_rows, "src long, dst long, common int", NEIGHBOURS, {"values": False, "graph": True})


def robust_soc(a: Any, d: np.ndarray) -> DataFrame:
    """``cluster.robust_soc_scalar`` of the edges off the diagonal of blocks; ``d`` is in the order of their ids."""
    return by_reach(a, robust_rows, "src long, dst long, soc double", NEIGHBOURS, {"values": True, "graph": True, "d": d})
