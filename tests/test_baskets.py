"""matrices of shared groups straight to blocks, and hierarchies of them, are those of a table of pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.operators import baskets, packed
from gridweave.options import Options
from gridweave.plans import bulk, solve, vectorial
from gridweave.plans import hierarchy as hier
from gridweave.queries import vector_queries
from gridweave.queries.graph_queries import vector_of
from gridweave.session import staged
from gridweave.sources import graphs
from tests.test_bulk import entries, same, where  # noqa: F401


@pytest.fixture(scope="module")
def lines(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))


def table_of(lines, least=1, shift=1.0, copies=1):
    e = graphs.copurchase(lines.select(F.col("o").alias("l_orderkey"), F.col("p").alias("l_partkey")), least)
    a = graphs.laplacian(e, shift)
    return staged(vectorial.repeated(a, copies) if copies > 1 else a, "a")


@pytest.mark.parametrize(("least", "copies"), [(1, 1), (2, 1), (1, 3)])
def test_matrix(where, lines, least, copies, monkeypatch):  # noqa: F811
    """Members that share nothing, or too little, aren't rows; lines are repeated and have nulls."""
    monkeypatch.setattr(baskets, "AT_ONCE", 500)
    spark = lines.sparkSession
    more = spark.createDataFrame([(-5, 7), (-5, 7), (-6, -9), (-7, -8), (-7, 3), (-7, 3), (None, 1), (None, 2)], "o long, p long").unionByName(spark.createDataFrame([(-7, None)], "o long, p long"))
    lines = lines.unionByName(more)
    s = bulk.copurchase(lines, least, 1.0, Options(), copies)
    got, want = entries(s.matrix, "i", "j"), entries(table_of(lines.where("o is not null"), least, copies=copies), "i", "j")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert (s.a.local is None) == (where == "jobs") and (least > 1 or -8 in s.ids) and -9 not in s.ids


def test_no_rows(lines):
    assert bulk.copurchase(lines.where("false"), 1, 1.0, Options()) is None
    assert bulk.copurchase(lines.select(F.monotonically_increasing_id().alias("o"), "p"), 1, 1.0, Options()) is None
    assert bulk.copurchase(lines, 1, 1.0, Options(held_vertices=10)) is None


@pytest.mark.parametrize("kind", ["semi_aux_smoothed", "piecewise"])
def test_levels(where, lines, kind):  # noqa: F811
    o = {"max_coarse_size": 10, "max_levels": 3, "prol_type": kind}
    s = bulk.copurchase(lines, 1, 1.0, Options())
    same(hier.build(s, Options.of(**o)), hier.build(table_of(lines), Options.of(held_vertices=0, **o)))


def test_components(where, lines):  # noqa: F811
    """Components that don't mix are one matrix of a component; ``test_bulk`` holds the other blocks against joins."""
    o = {"max_coarse_size": 10, "max_levels": 2}
    s = bulk.copurchase(lines, 1, 1.0, Options(), 2)
    got, want = (hier.build_hierarchy(a, "h1_2d", options=Options.of(**o)) for a in (s, table_of(lines, copies=2)))
    assert [(x.nv, x.ne, x.nnz) for x in got.levels] == [(x.nv, x.ne, x.nnz) for x in want.levels]
    assert got.block == 2 and got.levels[0].nnz == 2 * got.levels[0].a.nnz
    for x, y in [(got.levels[1].matrix, want.levels[1].matrix), (got.levels[0].p, want.levels[0].p)]:
        x, y = entries(x, "i", "j"), entries(y, "i", "j")
        assert x.keys() == y.keys() and np.allclose([x[k] for k in x], [y[k] for k in x], rtol=1e-9, atol=1e-9)


def test_kernel_and_cg(where, lines):  # noqa: F811
    o = {"max_coarse_size": 10, "max_levels": 2, "prol_type": "piecewise"}
    got, want = (hier.build(a, Options.of(**o)) for a in (bulk.copurchase(lines, 1, 0.0, Options()), table_of(lines, shift=0.0)))
    x = got.vector(0).select("i", (F.col("i") % 3).cast("double").alias("x"))
    a, b = ([r.err for r in k.kernel_errors(x).collect()] for k in (got, want))
    assert np.allclose(a, b, atol=1e-9) and max(a) > 0.1
    s, table = bulk.copurchase(lines, 1, 1.0, Options()), table_of(lines)
    a, b = (solve.cg_cycles(hier.build(m, Options.of(max_coarse_size=10, max_levels=2)), vector_of(table), 1e-6, 2) for m in (s, table))
    assert len(a) > 1 and np.allclose(a, b, rtol=1e-9)


def test_queries_make_no_pairs(spark, sf_dir, monkeypatch):
    """The queries of the findings don't list pairs of parts in a table (they did)."""

    def no(*_):
        raise AssertionError("a table of pairs")

    monkeypatch.setattr(graphs, "copurchase", no)
    for name in ("h1_2d_summary", "kernel_errors", "cg_history"):
        assert vector_queries.QUERIES[name](spark, sf_dir).count()


def test_whole_numbers():
    """Sums of whole numbers by one sort are those of others."""
    r = np.random.default_rng(1)
    row, col, val = np.sort(r.integers(5, 900, 3000)), r.integers(0, 4000, 3000), r.integers(-300, 300, 3000).astype(float)
    got, want = packed.summed(row, col, val, 4000), packed.summed(row, col, val + 0.0 + 1e-13, 4000)
    assert all(np.array_equal(a, b) for a, b in zip(got[:2], want[:2], strict=True)) and np.allclose(got[2], want[2], atol=1e-9)
    assert packed.slim(val).dtype == np.int16 and packed.slim(val / 2) is not None and (packed.slim(val) == val).all()
