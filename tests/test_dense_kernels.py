"""kernels over tables of cells are those by sorting, and what isn't needed isn't summed or scanned again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.operators import packed
from gridweave.options import Options
from gridweave.plans import bulk


def made(n, columns, each, seed=1):
    """A block of n rows with stored zeros, and a prolongation with up to 3 entries in a row."""
    r = np.random.default_rng(seed)
    row, col, val = packed.summed(np.repeat(np.arange(n), each), r.integers(0, n, n * each), r.integers(-2, 3, n * each).astype(float), n)
    count = r.integers(0, 4, n)
    pc = np.concatenate([np.sort(r.choice(columns, c, replace=False)) for c in count])
    return packed.block_of_rows(row, col, val, 0, n), (np.concatenate([[0], np.cumsum(count)]), pc, r.integers(1, 4, len(pc)).astype(float))


def same(a, b):
    assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]) and np.allclose(a[2], b[2], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("each", [3, 40, 400])
def test_products(each, monkeypatch):
    b, p = made(90, 20, each)
    s = {"p": p, "columns": 20, "bounds": np.array([0, 7, 20])}
    row, col, val = b.rows(), b.cols, b.vals
    same(packed.times(row, col, val, p, 20), packed.summed(*packed.product(row, col, val, p), 20))
    parts = {}
    for part in (packed.Block(0, b.ends[:50], b.cols[: b.ends[49]], b.vals[: b.ends[49]]), packed.Block(50, b.ends[50:] - b.ends[49], b.cols[b.ends[49] :], b.vals[b.ends[49] :])):
        for to, x in packed.ship(part, s):
            parts.setdefault(to, []).append(x)
    got = [packed.galerkin(to, parts[to], s) for to in (0, 1)]
    dense = np.zeros((90, 20))
    dense[np.repeat(np.arange(90), np.diff(p[0])), p[1]] = p[2]
    a = np.zeros((90, 90))
    a[row, col] = val
    whole = np.zeros((20, 20))
    for x in got:
        whole[x.rows(), x.cols] = x.vals
    assert np.allclose(whole, dense.T @ a @ dense)
    monkeypatch.setattr(packed, "CELLS", -1)
    for x, y in zip(got, [packed.galerkin(to, parts[to], s) for to in (0, 1)], strict=True):
        assert np.array_equal(x.ends, y.ends)
        same(x[1:], y[1:])


def test_rows_of_many_clusters_are_not_summed(monkeypatch):
    b, _ = made(90, 20, 40)
    c = np.arange(90) % 20
    state = {"c": c, "columns": 20, "omega": 0.9, "most": 5}
    cut = np.zeros(90, bool)
    cut[:4] = True  # rows of one entry
    keep = np.where(cut[b.rows()], b.rows() == b.cols, True)
    some = packed.block_of_rows(b.rows()[keep], b.cols[keep], b.vals[keep] + 5, 0, 90)
    want, met, before = np.flatnonzero(np.array([0 < len(set(c[some.cols[some.rows() == i]])) <= 5 for i in range(90)])), [], packed.summed
    monkeypatch.setattr(bulk, "summed", lambda row, *x: met.append(len(row)) or before(row, *x))
    got = bulk.classic_rows(some, state)
    assert np.array_equal(got[3], want) and set(got[0]) <= set(want) and met[0] < len(some.cols) / 10


def test_one_scan_for_sizes(spark, sf_dir, monkeypatch):
    """The estimate of the groups comes with the counts of the members, without a job of its own."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))

    def no(*_):
        raise AssertionError("a job of its own")

    monkeypatch.setattr(type(lines), "first", no)
    assert bulk.copurchase(lines, 1, 1.0, Options()).a.nnz > 0
