"""Matrices packed by blocks of rows, and what is done to a block at once in numpy.

Rows and columns are positions 0..n-1. A block holds the rows from ``first`` on: where each ends, its columns in order, its values.
Per-vertex arrays (the state of a step: clusters, prolongation, vectors) are shipped to every task, so their length is bounded
by ``Options.held_vertices``; entries are never on the driver unless there are at most ``LOCAL`` of them, in which case no job is run.
Sums run in the order of rows and blocks, so results don't depend on the tasks.
"""

from __future__ import annotations

import gc
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.session import drop, staged

#: Entries of a matrix that stays on the driver, entries of a block, entries that a task collects before it deals them, and blocks of a file.
LOCAL, BLOCK, AT_ONCE, FILE = 5_000_000, 200_000, 1_000_000, 8
#: Cells of a dense table that a kernel makes at most, and cells for each product from which on it sorts instead.
CELLS, WIDE = 8_000_000, 16
#: Products (entries of A and of two prolongations) for a block of rows of a product over two levels, and how many such blocks there are at most.
FAR, MANY = 6_000_000, 20_000
#: Entries from which on shuffle files are cleared at once.
LARGE = 5_000_000

State = dict[str, Any]


class Block(NamedTuple):
    first: int
    ends: np.ndarray
    cols: np.ndarray
    vals: np.ndarray

    def lens(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.first, self.first + len(self.ends)), self.lens())


@dataclass
class Packed:
    """A matrix: its blocks in memory or as a table (block, lens, part), the first row of each block (and the end), the length of each row."""

    bounds: np.ndarray
    lens: np.ndarray
    local: list[Block] | None = None
    table: DataFrame | None = None
    #: (first row, what was asked about it) of each block, where that was found when the blocks were made
    also: list[tuple[int, Any]] | None = None

    def drop(self) -> None:
        """Delete the files."""
        if self.table is not None:
            drop(self.table)

    @property
    def nnz(self) -> int:
        return int(self.lens.sum())


def bounds_of(cost: np.ndarray, most: int | None = None, unit: int = 1) -> np.ndarray:
    """Blocks of consecutive rows that cost up to about ``most`` each; they begin at multiples of ``unit``."""
    total = np.concatenate([[0], np.cumsum(cost)])
    k = np.arange(1, int(total[-1] // (most or BLOCK)) + 1) * (most or BLOCK)
    at = np.searchsorted(total, k) // unit * unit
    return np.unique(np.concatenate([[0], at[at < len(cost)], [len(cost)]])).astype(np.int64)


def firsts(group: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (count of them), one range after the other."""
    return np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)


def summed(row: np.ndarray, col: np.ndarray, val: np.ndarray, ncol: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, col, val) in order, each pair once with its sum, zeros too."""
    if not len(row):
        return row, col, val
    low = int(row.min())
    mark = np.zeros(ncol, bool)
    mark[col] = True
    names = np.flatnonzero(mark)
    cells = (int(row.max()) - low + 1) * len(names)
    if cells <= 3 * len(row):
        at = np.zeros(ncol, np.int64)
        at[names] = np.arange(len(names))
        key = (row - low).astype(np.int64) * len(names) + at[col]
        cell = np.flatnonzero(np.bincount(key, minlength=cells))
        r, c = np.divmod(cell, len(names))
        return r + low, names[c], np.bincount(key, val, cells)[cell]
    key = (row - low).astype(np.int64) * ncol + col
    least, most = val.min(), val.max()
    bits = int(most - least).bit_length() if np.isfinite(most - least) else 64
    if bits + int(key.max()).bit_length() <= 62 and (val == np.rint(val)).all():
        # whole numbers are sorted with their keys, in one word; their sums are exact in any order
        key = (key << bits) | (val - least).astype(np.int64)
        key.sort()
        name = key >> bits
        at = firsts(name)
        total = np.add.reduceat(key & ((1 << bits) - 1), at) + np.diff(np.append(at, len(key))) * int(least)
        r, c = np.divmod(name[at], ncol)
        return r + low, c, total.astype(float)
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = firsts(key)
    r, c = np.divmod(key[at], ncol)
    return r + low, c, np.add.reduceat(val[order], at)


def met(row: np.ndarray, col: np.ndarray, val: np.ndarray, ncol: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``summed`` where the rows (in order) and columns that occur make a table smaller than the entries; else the entries as they are."""
    if not len(row):
        return row, col, val
    start = firsts(row)
    mark = np.zeros(ncol, bool)
    mark[col] = True
    names = np.flatnonzero(mark)
    cells = len(start) * len(names)
    if cells > 0.8 * len(row):
        return row, col, val
    at = np.zeros(ncol, np.int64)
    at[names] = np.arange(len(names))
    key = np.repeat(np.arange(len(start)) * len(names), np.diff(np.append(start, len(row)))) + at[col]
    cell = np.flatnonzero(np.bincount(key, minlength=cells))
    r, c = np.divmod(cell, len(names))
    return row[start][r], names[c], np.bincount(key, val, cells)[cell]


def slim(val: np.ndarray) -> np.ndarray:
    """Small whole numbers in one or two bytes each, for files and shuffles; other values as they are."""
    if not len(val):
        return val
    most = np.abs(val).max()
    if not most < 2**15 or not (val == np.rint(val)).all():
        return val
    return val.astype(np.int8 if most < 2**7 else np.int16)


class Planes(NamedTuple):
    """A long array for files and shuffles, whose compression finds runs of equal bytes: first the lowest byte of every value, then the
    next one. Whole numbers are steps from one to the next, their sign in the lowest bit; high bytes that are all zero are left out."""

    kind: str
    size: int
    bytes: np.ndarray


def wire(x: Any) -> bytes:
    """What ``unwired`` gives back: a value, or a tuple of some, with its long arrays as ``Planes``."""
    return _binary(type(x)(*map(_planes, x)) if isinstance(x, Block) else tuple(map(_planes, x)) if isinstance(x, tuple) else x)


def unwired(part: Any) -> Any:
    x = pickle.loads(part)
    return type(x)(*map(_whole, x)) if isinstance(x, Block) else tuple(map(_whole, x)) if isinstance(x, tuple) else x


def _planes(a: Any) -> Any:
    if not isinstance(a, np.ndarray) or a.ndim != 1 or len(a) < 32 or a.itemsize not in (2, 4, 8) or a.dtype.kind not in "if":
        return a
    z = a
    if a.dtype.kind == "i":  # steps may wrap around, and back
        z = np.empty_like(a)
        z[0] = a[0]
        np.subtract(a[1:], a[:-1], out=z[1:])
        z = (z << 1) ^ (z >> (8 * a.itemsize - 1))
    width = a.itemsize
    if a.dtype.kind == "i":
        most = int(z.view(f"u{width}").max())
        width = max(1, (most.bit_length() + 7) // 8)
    return Planes(a.dtype.str, len(a), np.ascontiguousarray(z.view(np.uint8).reshape(len(a), a.itemsize)[:, :width].T))


def _whole(p: Any) -> Any:
    if not isinstance(p, Planes):
        return p
    kind = np.dtype(p.kind)
    z = np.zeros((p.size, kind.itemsize), np.uint8)
    z[:, : len(p.bytes)] = p.bytes.T
    if kind.kind == "f":
        return z.view(kind).reshape(-1)
    z = z.view(f"u{kind.itemsize}").reshape(-1)
    step = (z >> 1).view(kind) ^ -(z & 1).view(kind)
    return np.cumsum(step, dtype=kind)


def stored(b: Block) -> bytes:
    """A block for files: values ``slim``."""
    return wire(b._replace(vals=slim(b.vals)))


def loaded(part: Any) -> Block:
    b = unwired(part)
    return b._replace(vals=b.vals.astype(float))


def block_of_rows(row: np.ndarray, col: np.ndarray, val: np.ndarray, lo: int, hi: int) -> Block:
    """From entries in the order of rows."""
    return Block(lo, np.cumsum(np.bincount(row - lo, minlength=hi - lo)), col.astype(np.int32), np.asarray(val, float))


def deal(row: np.ndarray, parts: tuple, bounds: np.ndarray) -> list[tuple[int, tuple]]:
    """(block, slices of the arrays) for entries in the order of rows."""
    at = np.searchsorted(row, bounds)
    return [(int(k), tuple(p[at[k] : at[k + 1]] for p in parts)) for k in np.flatnonzero(np.diff(at))]


def combine(to: int, parts: list[tuple], s: State) -> Block:
    """A block from (row, col, val) of several others."""
    row, col, val = (np.concatenate([p[k] for p in parts]) for k in range(3))
    return block_of_rows(*summed(row, col, val.astype(float), s["columns"]), int(s["bounds"][to]), int(s["bounds"][to + 1]))


def _binary(x: Any) -> bytes:
    return pickle.dumps(x, protocol=5)


def each(spark: SparkSession, p: Packed, f: Callable[[Block, State], Any], s: State) -> list[Any]:
    """(first row, f) of every block, in order: what f returns goes to the driver, so it is of the size of the rows."""
    if p.local is not None:
        return [(b.first, f(b, s)) for b in p.local]
    state = spark.sparkContext.broadcast(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for key, part in zip(t.column("block"), t.column("part"), strict=True):
                b = loaded(part.as_buffer())
                yield pa.record_batch({"block": pa.array([key.as_py()], pa.int64()), "out": pa.array([_binary((b.first, f(b, state.value)))], pa.binary())})

    try:
        got = p.table.select("block", "part").mapInArrow(run, "block long, out binary").collect()
    finally:
        state.destroy()
    return [pickle.loads(r.out) for r in sorted(got, key=lambda r: r.block)]


def exchange(spark: SparkSession, p: Packed, f: Callable[[Block, State], list[tuple[int, tuple]]], g: Callable[[int, list[tuple], State], Block], s: State, also: Callable[[Block, State], Any] | None = None) -> Packed:
    """The matrix of other rows: f deals parts of a block to new ones (``bounds`` of the state), g makes a block of its parts; ``also`` is
    what the same jobs find of the new blocks."""
    bounds = s["bounds"]
    if p.local is not None:
        parts: dict[int, list[tuple]] = {}
        for b in p.local:
            for to, x in f(b, s):
                parts.setdefault(to, []).append(x)
        blocks = [g(to, parts[to], s) for to in sorted(parts)]
        return Packed(bounds, _lens(((b.first, b.lens()) for b in blocks), int(bounds[-1])), blocks, also=[(b.first, also(b, s)) for b in blocks] if also else None)
    state = spark.sparkContext.broadcast(s)
    try:
        return gathered(messages(spark, p, f, state, s), g, state, bounds, also)
    finally:
        state.destroy()


def passed(spark: SparkSession, p: Packed, f: Callable[[Block, State], list[tuple[int, tuple]]], g: Callable[[int, list[tuple], State], Block], s: State, also: Callable[[Block, State], Any]) -> tuple[np.ndarray, list[tuple[int, Any]]]:
    """The lengths of the rows that ``exchange`` would make and what ``also`` finds of its blocks, which are kept nowhere."""
    state = spark.sparkContext.broadcast(s)
    try:
        return _found(_merged(messages(spark, p, f, state, s), g, state, s["bounds"], also, keep=False), s["bounds"])
    finally:
        state.destroy()


def messages(spark: SparkSession, p: Packed, f: Callable[[Block, State], list[tuple[int, tuple]]], state: Any, s: State) -> DataFrame:
    """What f deals, as a table; ``state`` is ``s`` as a broadcast variable."""
    if p.local is not None:
        return spark.createDataFrame([(to, k, bytearray(wire(x))) for k, b in enumerate(p.local) for to, x in f(b, s)], MESSAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for key, part in zip(t.column("block"), t.column("part"), strict=True):
                for to, x in f(loaded(part.as_buffer()), state.value):
                    yield pa.record_batch({"to": pa.array([to], pa.int64()), "source": pa.array([key.as_py()], pa.int64()), "part": pa.array([wire(x)], pa.binary())})

    return p.table.select("block", "part").mapInArrow(run, MESSAGE)


MESSAGE = "to long, source long, part binary"


def _merged(messages: DataFrame, g: Callable[[int, list[tuple], State], Block], state: Any, bounds: np.ndarray, also: Callable[[Block, State], Any] | None, keep: bool = True) -> DataFrame:
    def merge(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("source").to_numpy(), kind="stable")
        to, part = t.column("to")[0].as_py(), t.column("part")
        b = g(to, [unwired(part[int(k)].as_buffer()) for k in order], state.value)
        of = (b.first, b.lens().astype(np.int32), also(b, state.value) if also else None)
        return pa.table({"block": pa.array([to], pa.int64()), "lens": pa.array([_binary(of)], pa.binary()), "part": pa.array([stored(b) if keep else None], pa.binary())})

    n = len(bounds) - 1
    return messages.repartition(min(n, max(12, -(-n // FILE))), "to").groupBy("to").applyInArrow(merge, "block long, lens binary, part binary")


def _found(merged: DataFrame, bounds: np.ndarray) -> tuple[np.ndarray, list[tuple[int, Any]]]:
    of = sorted((pickle.loads(r.lens) for r in merged.select("lens").collect()), key=lambda x: x[0])
    lens = _lens((x[:2] for x in of), int(bounds[-1]))
    if lens.sum() > LARGE:  # shuffle files stay until the driver collects its garbage
        gc.collect()
        merged.sparkSession._jvm.System.gc()
    return lens, [(x[0], x[2]) for x in of]


def gathered(messages: DataFrame, g: Callable[[int, list[tuple], State], Block], state: Any, bounds: np.ndarray, also: Callable[[Block, State], Any] | None = None) -> Packed:
    table = staged(_merged(messages, g, state, bounds, also), "packed")
    lens, found = _found(table, bounds)
    found = found if also else None
    if lens.sum() > LOCAL:
        return Packed(bounds, lens, table=table, also=found)
    return Packed(bounds, lens, [loaded(r.part) for r in sorted(table.select("block", "part").collect(), key=lambda r: r.block)], also=found)


def _lens(blocks: Any, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for first, lens in blocks:
        out[first : first + len(lens)] = lens
    return out


def pack(a: DataFrame, ids: np.ndarray, lens: np.ndarray, unit: int = 1) -> Packed:
    """A matrix (i, j, v) with the rows ``ids`` (in order), which have ``lens`` entries; columns must be among the rows."""
    spark = a.sparkSession
    bounds = bounds_of(lens, unit=unit)
    s: State = {"bounds": bounds, "columns": len(ids), "ids": ids}
    if lens.sum() <= LOCAL:
        got = a.select("i", "j", "v").toPandas()
        whole = {"bounds": np.array([0, len(ids)]), "columns": len(ids)}
        row, col = position(ids, got["i"].to_numpy()), position(ids, got["j"].to_numpy())
        block = combine(0, [(row, col, got["v"].to_numpy(float))], whole)
        return Packed(whole["bounds"], block.lens(), [block])
    state = spark.sparkContext.broadcast(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            row, col = (position(ids_, t.column(c).to_numpy()).astype(np.int32) for c in "ij")
            order = np.argsort(row, kind="stable")
            for to, x in deal(row[order], (row[order], col[order], t.column("v").to_numpy()[order]), state.value["bounds"]):
                yield pa.record_batch({"to": pa.array([to], pa.int64()), "source": pa.array([0], pa.int64()), "part": pa.array([wire(x)], pa.binary())})

        ids_ = state.value["ids"]
        for t in batches:
            held.append(t)
            if sum(len(x) for x in held) >= AT_ONCE:
                yield from flush()
                held.clear()
        if held:
            yield from flush()

    try:
        return gathered(a.select("i", "j", "v").mapInArrow(run, MESSAGE), combine, state, bounds)
    finally:
        state.destroy()


def position(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ids, x), max(len(ids) - 1, 0))
    if len(x) and not np.array_equal(ids[at], x):
        raise ValueError("the matrix has columns that aren't rows; it must be symmetric")
    return at


def unpacked(spark: SparkSession, p: Packed, ids: np.ndarray, copies: int = 1) -> DataFrame:
    """(i, j, v) with the names of rows and columns. With ``copies``, that many components of which each has its share of the values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for part in t.column("part"):
                b = loaded(part.as_buffer())
                for k in range(copies):
                    yield pa.record_batch({"i": pa.array(ids[b.rows()] * copies + k), "j": pa.array(ids[b.cols] * copies + k), "v": pa.array(b.vals / copies)})

    table = p.table
    if table is None:
        table = spark.createDataFrame([(bytearray(stored(b)),) for b in p.local or []], "part binary")
    return table.select("part").mapInArrow(run, "i long, j long, v double")


# --- kernels
def edges(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, weight) of the entries off the diagonal."""
    row = b.rows()
    off = row != b.cols
    return row[off], b.cols[off], np.abs(b.vals[off])


def entries_of(b: Block, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the rows where ``mask`` (over the block's rows) is set."""
    lens = b.lens()
    row = np.repeat(np.flatnonzero(mask) + b.first, lens[mask])
    if mask.all():
        return row, b.cols, b.vals
    keep = np.repeat(mask, lens)
    return row, b.cols[keep], b.vals[keep]


def relabel(b: Block, s: State) -> list[tuple[int, tuple]]:
    """Entries between vertices that have a place in ``to``, under their places, for ``combine``: weights of those off the diagonal, or
    with ``signed`` the values of all."""
    to, n, lens = s["to"], len(b.ends), b.lens()
    target = to[b.first : b.first + n]
    order = np.argsort(target, kind="stable")
    order = order[target[order] >= 0]
    at = spread((b.ends - lens)[order], lens[order])
    row, col, val = np.repeat(target[order], lens[order]), to[b.cols[at]], b.vals[at]
    keep = col >= 0 if s.get("signed") else (col >= 0) & (row != col)
    row, col, val = row[keep], col[keep], val[keep]
    row, col, val = met(row, col, val if s.get("signed") else np.abs(val), s["columns"])
    return deal(row, (row.astype(np.int32), col.astype(np.int32), slim(val)), s["bounds"])


def spmv(b: Block, s: State) -> np.ndarray:
    return np.bincount(b.rows() - b.first, b.vals * s["x"][b.cols], len(b.ends)) if len(b.cols) else np.zeros(len(b.ends))


def diagonal(b: Block, s: State) -> np.ndarray:
    row = b.rows()
    on = row == b.cols
    return np.bincount(row[on] - b.first, b.vals[on], len(b.ends))


def largest(b: Block, s: State) -> np.ndarray:
    """The largest weight of each row's entries off the diagonal."""
    out = np.zeros(len(b.ends))
    if len(b.cols):
        lens = b.lens()
        some = np.flatnonzero(lens)
        out[some] = np.maximum.reduceat(np.where(b.rows() != b.cols, np.abs(b.vals), 0.0), (b.ends - lens)[some])
    return out


def product(row: np.ndarray, col: np.ndarray, val: np.ndarray, p: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Products of the entries with the rows of p (starts, cols, vals), not summed."""
    start, pc, pv = p
    count = start[col + 1] - start[col]
    at = spread(start[col], count)
    return np.repeat(row, count), pc[at], np.repeat(val, count) * pv[at]


def times(row: np.ndarray, col: np.ndarray, val: np.ndarray, p: tuple[np.ndarray, np.ndarray, np.ndarray], ncol: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``summed`` products of the entries (each pair once) with the rows of p; as dense matrices where the entries nearly fill theirs."""
    start, pc, pv = p
    low, high = (int(row.min()), int(row.max()) + 1) if len(row) else (0, 0)
    mark = np.zeros(len(start) - 1, bool)
    mark[col] = True
    names = np.flatnonzero(mark)
    cells = (high - low) * len(names)
    count = start[names + 1] - start[names]
    at = spread(start[names], count)
    mark = np.zeros(ncol, bool)
    mark[pc[at]] = True
    coarse = np.flatnonzero(mark)
    if not len(coarse) or cells > min(2 * len(row), CELLS) or len(names) * len(coarse) > min(20 * len(row), CELLS):
        return summed(*product(row, col, val, p), ncol)
    place, to = np.zeros(len(start) - 1, np.int64), np.zeros(ncol, np.int64)
    place[names], to[coarse] = np.arange(len(names)), np.arange(len(coarse))
    a, b = np.zeros((high - low, len(names))), np.zeros((len(names), len(coarse)))
    a[row - low, place[col]] = val
    b[np.repeat(np.arange(len(names)), count), to[pc[at]]] = pv[at]
    out = a @ b
    if len(row) == cells:
        there = np.ones(out.shape, bool)
    else:  # sums that are zero stay
        a[:], b[:] = 0.0, 0.0
        a[row - low, place[col]] = 1.0
        b[np.repeat(np.arange(len(names)), count), to[pc[at]]] = 1.0
        there = a @ b > 0
    r, c = np.nonzero(there)
    return r + low, coarse[c], out[there]


def ship(b: Block, s: State) -> list[tuple[int, tuple]]:
    """Rows of A, or of A P if those have fewer entries, to the blocks of the coarse rows that they are part of."""
    start, pc, _ = s["p"]
    n, lens = len(b.ends), b.lens()
    mark = np.zeros(len(start) - 1, bool)
    mark[b.cols] = True
    reach = np.flatnonzero(mark)
    coarse = np.zeros(s["columns"], bool)
    coarse[pc[spread(start[reach], start[reach + 1] - start[reach])]] = True
    cols, vals, done = b.cols, slim(b.vals), False
    if n * int(coarse.sum()) < len(cols):
        row, cols, vals = times(b.rows(), cols, b.vals, s["p"], s["columns"])
        cols, lens, done = cols.astype(np.int32), np.bincount(row - b.first, minlength=n), True
    first = np.cumsum(lens) - lens
    count = start[b.first + 1 : b.first + n + 1] - start[b.first : b.first + n]
    mine = pc[start[b.first] : start[b.first + n]]
    pairs = np.unique((np.searchsorted(s["bounds"], mine, "right") - 1) * n + np.repeat(np.arange(n), count))
    home, row = np.divmod(pairs, n)
    out = []
    for lo, hi in zip(firsts(home), np.append(firsts(home)[1:], len(home)), strict=True):
        r = row[lo:hi]
        at = spread(first[r], lens[r])
        out.append((int(home[lo]), ((r + b.first).astype(np.int32), lens[r].astype(np.int32), cols[at], vals[at], done)))
    return out


def through(need: np.ndarray, p: tuple[np.ndarray, np.ndarray, np.ndarray], q: tuple[np.ndarray, np.ndarray, np.ndarray], ncol: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of P Q (starts, cols, vals) that ``need`` marks; others are empty."""
    start, pc, pv = p
    rows = np.flatnonzero(need)
    count = start[rows + 1] - start[rows]
    at = spread(start[rows], count)
    r, c, v = summed(*product(np.repeat(rows, count), pc[at], pv[at], q), ncol)
    return np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(need)))]), c, v


def ship_far(b: Block, s: State) -> list[tuple[int, tuple]]:
    """``ship`` for the product of two prolongations, of which only the rows met are made."""
    need = np.zeros(len(s["p"][0]) - 1, bool)
    need[b.cols] = need[b.first : b.first + len(b.ends)] = True
    return ship(b, s | {"p": through(need, s["p"], s["q"], s["columns"])})


def galerkin_far(to: int, parts: list[tuple], s: State) -> Block:
    """``galerkin`` for the product of two prolongations."""
    need = np.zeros(len(s["p"][0]) - 1, bool)
    for rows, _, cols, _, done in parts:
        need[rows] = True
        if not done:
            need[cols] = True
    return galerkin(to, parts, s | {"p": through(need, s["p"], s["q"], s["columns"])})


def _some(parts: list[tuple], p: tuple[np.ndarray, np.ndarray, np.ndarray], most: int) -> Iterator[tuple]:
    """(rows, lens, cols, vals, done) of a few rows of the parts at a time: at most ``most`` rows and about AT_ONCE products."""
    start = p[0]
    for rows, lens, cols, vals, done in parts:
        ends = np.cumsum(lens, dtype=np.int64)
        cost = ends if done else np.cumsum(start[cols + 1] - start[cols])[ends - 1] if len(cols) else ends
        lo = 0
        while lo < len(rows):
            hi = min(lo + most, max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + AT_ONCE, "right"))))
            a, z = int(ends[lo - 1]) if lo else 0, int(ends[hi - 1])
            yield rows[lo:hi], lens[lo:hi], cols[a:z], vals[a:z], done
            lo = hi


def _joined(parts: list[tuple]) -> list[tuple]:
    """The parts with those that are alike side by side: of rows of A, and of A P."""
    out = []
    for done in (False, True):
        if some := [x[:4] for x in parts if x[4] == done and len(x[0])]:
            out.append((*(np.concatenate([x[k] for x in some]) for k in range(4)), done))
    return out


def galerkin(to: int, parts: list[tuple], s: State) -> Block:
    """P^T A P, of the coarse rows of a block."""
    start, pc, pv = s["p"]
    lo, hi = int(s["bounds"][to]), int(s["bounds"][to + 1])
    parts = _joined(parts)
    mark, fine = np.zeros(s["columns"], bool), np.zeros(len(start) - 1, bool)
    entries = count = 0
    for rows, _, cols, _, done in parts:
        (mark if done else fine)[cols] = True
        entries += len(cols) if done else int((start[cols + 1] - start[cols]).sum())
        count += len(rows)
    reach = np.flatnonzero(fine)
    mark[pc[spread(start[reach], start[reach + 1] - start[reach])]] = True
    names = np.flatnonzero(mark)
    wide = len(names) * max(count, 1) > WIDE * entries or len(names) * (hi - lo) > CELLS
    got = _products(_some(parts, s["p"], AT_ONCE if wide else max(1, CELLS // max(len(names), 1))), s["p"], lo, hi)
    if wide:
        return block_of_rows(*_by_sorting(got, lo, s["columns"]), lo, hi)
    # rows of A P side by side, in a table over the columns that occur; a coarse row is a sum of such rows
    place = np.zeros(s["columns"], np.int64)
    place[names] = np.arange(len(names))
    total, hit = np.zeros((hi - lo, len(names))), np.zeros((hi - lo, len(names)), bool)
    for n, local, cols, vals, owner, mine, w in got:
        key = local * len(names) + place[cols]
        table = np.bincount(key, vals, n * len(names)).reshape(n, len(names))
        there = np.zeros(n * len(names), bool)
        there[key] = True  # sums that are zero stay
        there = there.reshape(table.shape)
        order = np.argsort(mine, kind="stable")
        owner, mine, w = owner[order], mine[order], w[order]
        for a, z in zip(firsts(mine), np.append(firsts(mine)[1:], len(mine)), strict=True):
            total[mine[a]] += w[a:z] @ table[owner[a:z]]
            hit[mine[a]] |= there[owner[a:z]].any(axis=0)
    r, c = np.nonzero(hit)
    return Block(lo, np.cumsum(np.count_nonzero(hit, axis=1)), names[c].astype(np.int32), total[hit])


def _products(some: Iterator[tuple], p: tuple[np.ndarray, np.ndarray, np.ndarray], lo: int, hi: int) -> Iterator[tuple]:
    """Of a few rows of A at a time: how many, the entries of their products with P, and what they are in coarse rows lo to hi."""
    start, pc, pv = p
    for rows, lens, cols, vals, done in some:
        local = np.repeat(np.arange(len(rows)), lens)
        if not done:
            local, cols, vals = product(local, cols, vals, p)
        count = start[rows + 1] - start[rows]
        at = spread(start[rows], count)
        owner = np.repeat(np.arange(len(rows)), count)
        inside = (pc[at] >= lo) & (pc[at] < hi)
        yield len(rows), local, cols, vals, owner[inside], pc[at][inside] - lo, pv[at][inside]


def _by_sorting(got: Iterator[tuple], lo: int, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``galerkin`` where a table of cells would be too large or too empty."""
    out = []
    for n, local, cols, vals, owner, coarse, w in got:
        mine = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
        many = mine[local + 1] - mine[local]
        pick = spread(mine[local], many)
        out.append(summed(coarse[pick] + lo, np.repeat(cols, many), np.repeat(vals, many) * w[pick], columns))
    return summed(*(np.concatenate([x[k] for x in out]) for k in range(3)), columns)


def traced(b: Block, s: State) -> list[tuple[int, tuple]]:
    """Sums over equal components; a block's rows are those of whole vertices."""
    k = s["block"]
    row, col = b.rows(), b.cols
    same = row % k == col % k
    row, col, val = summed(row[same] // k, col[same] // k, b.vals[same], s["columns"])
    return deal(row, (row.astype(np.int32), col.astype(np.int32), val), s["bounds"])
