"""Smoothers: each takes and returns (x, res) so that residuals are reused.

``res_updated`` says that res is b - A x on entry, ``update_res`` asks for it on return, ``x_zero`` that x is zero. Vectors
are (i, x). Sequential Gauss-Seidel becomes multicolour Gauss-Seidel: one product for each colour. Blocks of block
Gauss-Seidel are coloured with a halo of one layer, so that blocks of a colour are independent and their order doesn't matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.columns import vertex_hash
from gridweave.functions.dense import pseudo_inverse
from gridweave.operators.linalg import axpy, diagonal, hybrid_diagonal, row_blocks, spmv, split_by_part, transpose
from gridweave.session import staged

Vectors = tuple[DataFrame, DataFrame]


def residual(a: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """b - A x, in one aggregation of the union of b and the products."""
    ax = a.join(x.select(F.col("i").alias("j"), "x"), "j").select("i", (-F.col("v") * F.col("x")).alias("x"))
    return b.select("i", "x").unionByName(ax).groupBy("i").agg(F.sum("x").alias("x"))


def correct(x: DataFrame, d: DataFrame) -> DataFrame:
    return x.select("i", "x").unionByName(d.select("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))


class Smoother:
    """A step is ``update(res)``, the correction for a residual; x and res follow from it."""

    def __init__(self, a: DataFrame, stage: bool = True) -> None:
        self.a, self.stage = a, stage

    def hold(self, df: DataFrame) -> DataFrame:
        return staged(df, "smooth") if self.stage else df

    def update(self, res: DataFrame) -> DataFrame:
        raise NotImplementedError

    def smooth(self, x: DataFrame, b: DataFrame, res: DataFrame | None = None, res_updated: bool = False, update_res: bool = True, x_zero: bool = False) -> Vectors:
        now = res if res_updated and res is not None else (b if x_zero else residual(self.a, x, b))
        d = self.hold(self.update(now))
        x = d if x_zero else correct(x, d)
        if update_res:
            now = residual(self.a, d, now)
        return self.hold(x), self.hold(now) if update_res else now

    def smooth_back(self, x: DataFrame, b: DataFrame, res: DataFrame | None = None, res_updated: bool = False, update_res: bool = True, x_zero: bool = False) -> Vectors:
        return self.smooth(x, b, res, res_updated, update_res, x_zero)


class Richardson(Smoother):
    """x += omega P res, with a preconditioner P given as a function of vectors."""

    def __init__(self, a: DataFrame, omega: float, precondition: Callable[[DataFrame], DataFrame] | None = None, stage: bool = True) -> None:
        super().__init__(a, stage)
        self.omega, self.precondition = omega, precondition

    def update(self, res: DataFrame) -> DataFrame:
        p = self.precondition(res) if self.precondition else res
        return p.select("i", (F.col("x") * self.omega).alias("x"))


class Jacobi(Smoother):
    """x += omega D^-1 res on free rows; ``free`` (i) lists them (all by default)."""

    def __init__(self, a: DataFrame, omega: float = 0.9, free: DataFrame | None = None, d: DataFrame | None = None, stage: bool = True) -> None:
        super().__init__(a, stage)
        d = diagonal(a) if d is None else d
        self.omega, self.d = omega, d if free is None else d.join(free.select("i"), "i", "left_semi")

    def update(self, res: DataFrame) -> DataFrame:
        return res.join(self.d, "i").select("i", (self.omega * F.col("x") / F.col("d")).alias("x"))


class HybridJacobi(Jacobi):
    """Jacobi with the diagonal made larger where rows depend on other parts; part is (i, p)."""

    def __init__(self, a: DataFrame, part: DataFrame, omega: float = 0.9, stage: bool = True) -> None:
        super().__init__(a, omega, d=hybrid_diagonal(a, part), stage=stage)


def color(a: DataFrame, rounds: int = 200, stage: bool = True) -> DataFrame:
    """(i, color): neighbours differ. In each round the vertices that come first among their open neighbours get the smallest
    colour that is free around them."""
    adj = a.where("i <> j").select(F.col("i").alias("src"), F.col("j").alias("dst")).distinct()
    nodes = a.select("i").distinct()
    done = nodes.where("false").select("i", F.lit(0).alias("color"))
    open_ = nodes.select("i", F.struct(vertex_hash(F.col("i")).alias("h"), F.col("i").alias("id")).alias("p"))
    hold = (lambda df: staged(df, "color")) if stage else (lambda df: df)
    adj, open_ = hold(adj), hold(open_)
    for _ in range(rounds):
        least = adj.join(open_.select(F.col("i").alias("dst"), F.col("p").alias("q")), "dst").groupBy(F.col("src").alias("i")).agg(F.min("q").alias("q"))
        ready = open_.join(least, "i", "left").where(F.col("q").isNull() | (F.col("p") < F.col("q"))).select("i")
        used = adj.join(done.select(F.col("i").alias("dst"), "color"), "dst").groupBy(F.col("src").alias("i")).agg(F.collect_set("color").alias("used"))
        new = ready.join(used, "i", "left").select("i", F.coalesce("used", F.array().cast("array<int>")).alias("used"))
        new = new.select("i", F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), "used")).cast("int").alias("color"))
        done = hold(done.unionByName(new))
        open_ = hold(open_.join(done.select("i"), "i", "left_anti"))
        if stage and open_.isEmpty():
            break
    else:
        if stage:
            raise RuntimeError(f"vertices without a colour after {rounds} rounds")
    return done


class ColoredGaussSeidel(Smoother):
    """Gauss-Seidel in the order of colours; backwards in the reverse order. ``colors`` (i, color) with ``count`` colours."""

    def __init__(self, a: DataFrame, colors: DataFrame, count: int, stage: bool = True) -> None:
        super().__init__(a, stage)
        self.d, self.colors, self.count = diagonal(a), colors, count

    def _sweep(self, order: list[int], x: DataFrame, b: DataFrame, res: DataFrame | None, res_updated: bool, x_zero: bool) -> Vectors:
        now = res if res_updated and res is not None else (b if x_zero else residual(self.a, x, b))
        for c in order:
            d = now.join(self.d, "i").join(self.colors.where(F.col("color") == c).select("i"), "i", "left_semi").select("i", (F.col("x") / F.col("d")).alias("x"))
            d = self.hold(d)
            x, now = self.hold(correct(x, d)), self.hold(residual(self.a, d, now))
        return x, now

    def smooth(self, x: DataFrame, b: DataFrame, res: DataFrame | None = None, res_updated: bool = False, update_res: bool = True, x_zero: bool = False) -> Vectors:
        return self._sweep(list(range(self.count)), x, b, res, res_updated, x_zero)

    def smooth_back(self, x: DataFrame, b: DataFrame, res: DataFrame | None = None, res_updated: bool = False, update_res: bool = True, x_zero: bool = False) -> Vectors:
        return self._sweep(list(range(self.count))[::-1], x, b, res, res_updated, x_zero)


def block_inverses(a: DataFrame, blocks: DataFrame, pseudo: bool = False) -> DataFrame:
    """(block_id, ids, inv): the inverse of each diagonal block; blocks is (block_id, i). A block is a bounded group."""
    rows = blocks.join(a, "i").join(blocks.select(F.col("block_id").alias("other"), F.col("i").alias("j")), "j").where("block_id = other").select("block_id", "i", "j", "v")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(p["i"])
        m = np.zeros((len(ids), len(ids)))
        m[np.searchsorted(ids, p["i"]), np.searchsorted(ids, p["j"])] = p["v"]
        inv = pseudo_inverse(m) if pseudo else np.linalg.inv(m)
        return pd.DataFrame({"block_id": [int(p["block_id"].iloc[0])], "ids": [ids.tolist()], "inv": [inv.ravel().tolist()]})

    return rows.groupBy("block_id").applyInPandas(run, "block_id long, ids array<long>, inv array<double>")


def block_colors(a: DataFrame, blocks: DataFrame, stage: bool = True) -> DataFrame:
    """(block_id, color): blocks that share an unknown or an entry of the matrix differ."""
    other = blocks.select(F.col("block_id").alias("k"), F.col("i").alias("j"))
    near = blocks.join(a.select("i", "j"), "i").join(other, "j").select(F.col("block_id").alias("i"), F.col("k").alias("j")).distinct()
    return color(near, stage=stage).select(F.col("i").alias("block_id"), "color")


class BlockGaussSeidel(Smoother):
    """x_b += D_b^-1 (b - A x)_b, one colour of blocks after the other; inverses are stored row by row and applied by a join."""

    def __init__(self, a: DataFrame, blocks: DataFrame, pseudo: bool = False, stage: bool = True, colors: DataFrame | None = None) -> None:
        super().__init__(a, stage)
        inverse = block_inverses(a, blocks, pseudo).join(block_colors(a, blocks, stage) if colors is None else colors, "block_id")
        n = F.size("ids")
        e = inverse.select("color", "ids", n.alias("n"), F.posexplode("inv").alias("k", "v"))
        self.inverse = self.hold(e.select("color", F.get("ids", F.floor(F.col("k") / F.col("n")).cast("int")).alias("i"), F.get("ids", (F.col("k") % F.col("n")).cast("int")).alias("j"), "v"))
        self.count = int(self.inverse.agg(F.max("color")).first()[0]) + 1

    def _sweep(self, order: list[int], x: DataFrame, b: DataFrame, res: DataFrame | None, res_updated: bool, x_zero: bool) -> Vectors:
        now = res if res_updated and res is not None else (b if x_zero else residual(self.a, x, b))
        for c in order:
            d = self.hold(spmv(self.inverse.where(F.col("color") == c).select("i", "j", "v"), now))
            x, now = self.hold(correct(x, d)), self.hold(residual(self.a, d, now))
        return x, now

    def smooth(self, x: DataFrame, b: DataFrame, res: DataFrame | None = None, res_updated: bool = False, update_res: bool = True, x_zero: bool = False) -> Vectors:
        return self._sweep(list(range(self.count)), x, b, res, res_updated, x_zero)

    def smooth_back(self, x: DataFrame, b: DataFrame, res: DataFrame | None = None, res_updated: bool = False, update_res: bool = True, x_zero: bool = False) -> Vectors:
        return self._sweep(list(range(self.count))[::-1], x, b, res, res_updated, x_zero)


class DynamicBlockGaussSeidel(BlockGaussSeidel):
    """Block Gauss-Seidel on the blocks that the matrix has by itself: rows with the same columns; ``free`` (i) lists free rows."""

    def __init__(self, a: DataFrame, free: DataFrame | None = None, stage: bool = True, colors: DataFrame | None = None) -> None:
        blocks = row_blocks(a).select(F.col("block").alias("block_id"), "i")
        blocks = blocks if free is None else blocks.join(free.select("i"), "i", "left_semi")
        super().__init__(a, staged(blocks, "blocks") if stage else blocks, stage=stage, colors=colors)


def check_parts(part: DataFrame, most: int) -> None:
    """Raise if a part has more rows than one task is to hold."""
    largest = part.groupBy("p").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most:
        raise ValueError(f"a part has {largest} rows; the limit is {most}")


def sweep(i: np.ndarray, j: np.ndarray, v: np.ndarray, b: np.ndarray, backward: bool) -> np.ndarray:
    """The solution of the lower (or upper) triangle of a matrix given by its entries, row by row."""
    n = len(b)
    order = np.lexsort((j, i))
    i, j, v = i[order], j[order], v[order]
    first = np.searchsorted(i, np.arange(n + 1))
    x = np.zeros(n)
    for r in range(n - 1, -1, -1) if backward else range(n):
        cols, vals = j[first[r] : first[r + 1]], v[first[r] : first[r + 1]]
        known = cols > r if backward else cols < r
        d = vals[cols == r]
        x[r] = (b[r] - vals[known] @ x[cols[known]]) / d[0] if len(d) else 0.0
    return x


class HybridGaussSeidel(Smoother):
    """Gauss-Seidel inside each part on A's inner entries, all parts at once, with the larger diagonal; part is (i, p).

    A part is one task, of at most ``MOST`` rows; the rest of the matrix enters through the residual, which is exact on return.
    """

    MOST = 2_000_000

    def __init__(self, a: DataFrame, part: DataFrame, stage: bool = True, backward: bool = False) -> None:
        super().__init__(a, stage)
        check_parts(part, self.MOST)
        inner, _ = split_by_part(a, part)
        d = hybrid_diagonal(a, part)
        self.part, self.backward = part, backward
        inner = inner.where("i <> j").unionByName(d.select("i", F.col("i").alias("j"), F.col("d").alias("v"))).join(part, "i")
        self.inner = self.hold(inner.select(F.col("p").alias("p"), F.col("i").alias("i"), F.col("j").alias("j"), F.col("v").alias("v")))

    of_part = staticmethod(sweep)

    def update(self, res: DataFrame) -> DataFrame:
        solve_part, backward = type(self).of_part, self.backward

        def run(key: tuple, m: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            ids = np.unique(r["i"]) if len(r) else np.zeros(0, np.int64)
            m = m[m["i"].isin(ids) & m["j"].isin(ids)]
            b = np.zeros(len(ids))
            b[np.searchsorted(ids, r["i"])] = r["x"]
            x = solve_part(np.searchsorted(ids, m["i"]), np.searchsorted(ids, m["j"]), m["v"].to_numpy(), b, backward) if len(ids) else b
            return pd.DataFrame({"i": ids, "x": x})

        r = res.join(self.part, "i").select(F.col("p").alias("p"), F.col("i").alias("i"), F.col("x").alias("x"))
        return self.inner.groupBy("p").cogroup(r.groupBy("p")).applyInPandas(run, "i long, x double")


def dense_solve(i: np.ndarray, j: np.ndarray, v: np.ndarray, b: np.ndarray, backward: bool = False) -> np.ndarray:
    """The solution of the whole matrix, whichever way a sweep would go."""
    full = np.zeros((len(b), len(b)))
    full[i, j] = v
    return np.linalg.solve(full, b)


class HybridDirect(HybridGaussSeidel):
    """The same with the inverse of each part's inner matrix instead of a sweep; parts of at most ``MOST`` rows."""

    MOST = 4000

    of_part = staticmethod(dense_solve)


class Proxy(Smoother):
    """``steps`` of another smoother, or with ``symmetric`` a forward and a backward sweep for each."""

    def __init__(self, inner: Smoother, steps: int = 1, symmetric: bool = False) -> None:
        super().__init__(inner.a, inner.stage)
        self.inner, self.steps, self.symmetric = inner, steps, symmetric

    def _run(self, back: bool, x: DataFrame, b: DataFrame, res: DataFrame | None, res_updated: bool, x_zero: bool) -> Vectors:
        now = res
        for k in range(self.steps):
            for way in ([back, not back] if self.symmetric else [back]):
                f = self.inner.smooth_back if way else self.inner.smooth
                first = k == 0 and way == back
                x, now = f(x, b, now, res_updated or not first, True, x_zero and first)
        return x, now

    def smooth(self, x: DataFrame, b: DataFrame, res: DataFrame | None = None, res_updated: bool = False, update_res: bool = True, x_zero: bool = False) -> Vectors:
        return self._run(False, x, b, res, res_updated, x_zero)

    def smooth_back(self, x: DataFrame, b: DataFrame, res: DataFrame | None = None, res_updated: bool = False, update_res: bool = True, x_zero: bool = False) -> Vectors:
        return self._run(True, x, b, res, res_updated, x_zero)


class Hiptmair(Smoother):
    """First in the potential space, reached through D, then in the range space; backwards in the reverse order."""

    def __init__(self, a: DataFrame, d: DataFrame, potential: Smoother, range_: Smoother, stage: bool = True) -> None:
        super().__init__(a, stage)
        self.d, self.dt, self.potential, self.range = d, transpose(d), potential, range_

    def _potential(self, x: DataFrame, b: DataFrame, res: DataFrame, back: bool) -> Vectors:
        small = spmv(self.dt, res)
        f = self.potential.smooth_back if back else self.potential.smooth
        y, _ = f(small, small, small, True, False, True)
        step = self.hold(spmv(self.d, y))
        return self.hold(correct(x, step)), self.hold(residual(self.a, step, res))

    def smooth(self, x: DataFrame, b: DataFrame, res: DataFrame | None = None, res_updated: bool = False, update_res: bool = True, x_zero: bool = False) -> Vectors:
        now = res if res_updated and res is not None else residual(self.a, x, b)
        x, now = self._potential(x, b, now, False)
        return self.range.smooth(x, b, now, True, update_res)

    def smooth_back(self, x: DataFrame, b: DataFrame, res: DataFrame | None = None, res_updated: bool = False, update_res: bool = True, x_zero: bool = False) -> Vectors:
        x, now = self.range.smooth_back(x, b, res, res_updated, True)
        return self._potential(x, b, now, True)


@dataclass(frozen=True)
class LocalMatrix:
    """A small matrix in numpy on the driver; ``ids`` are its rows in order."""

    ids: np.ndarray
    dense: np.ndarray

    #: Rows up to which a matrix may come to the driver.
    LIMIT = 4000

    @classmethod
    def of(cls, a: DataFrame, limit: int = LIMIT) -> LocalMatrix:
        n = a.select("i").distinct().count()
        if n > limit:
            raise ValueError(f"{n} rows are too many for the driver; the limit is {limit}")
        got = a.toPandas()
        ids = np.unique(np.concatenate([got["i"], got["j"]])) if len(got) else np.zeros(0, np.int64)
        dense = np.zeros((len(ids), len(ids)))
        np.add.at(dense, (np.searchsorted(ids, got["i"]), np.searchsorted(ids, got["j"])), got["v"])
        return cls(ids, dense)

    def solve(self, b: DataFrame) -> DataFrame:
        got = b.toPandas()
        rhs = np.zeros(len(self.ids))
        keep = got["i"].isin(self.ids)
        rhs[np.searchsorted(self.ids, got["i"][keep])] = got["x"][keep]
        x = np.linalg.lstsq(self.dense, rhs, rcond=None)[0] if len(rhs) else rhs
        return b.sparkSession.createDataFrame(pd.DataFrame({"i": self.ids, "x": x}), "i long, x double")
