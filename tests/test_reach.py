"""products by blocks of rows; nothing is joined pair by pair."""

import pytest

from gridweave.operators import cluster, linalg, packed, reach, weights
from gridweave.queries.graph_queries import QUERIES, edges_of, graph_of, matrix_of
from gridweave.session import staged
from tests.test_scale import plan


@pytest.mark.parametrize("small", [False, True])
def test_against_joins(small, spark, sf_dir, monkeypatch):
    if small:
        for m, name, n in ((packed, "LOCAL", 0), (packed, "BLOCK", 1500), (reach, "ROWS", 1100), (reach, "NEIGHBOURS", 1100), (reach, "AT_ONCE", 500)):
            monkeypatch.setattr(m, name, n)
    e = staged(edges_of(spark, sf_dir, 1), "e")
    a = matrix_of(e)
    got = reach.squared(a).collect()
    want = {(r.i, r.j): r.v for r in linalg.spgemm(a, a).collect()}
    assert len(got) == len(want) and {(r.i, r.j): r.v for r in got} == want
    near = {}
    for r in e.collect():
        near.setdefault(r.src, set()).add(r.dst)
        near.setdefault(r.dst, set()).add(r.src)
    got = reach.common_neighbours(e).collect()
    assert {(r.src, r.dst): r.common for r in got} == {(x, y): len(near[x] & near[y]) for x in near for y in near[x] if x < y} and len(got) == e.count()


def test_lists_are_not_joined(spark, sf_dir):
    assert "Join" not in plan(QUERIES["common_neighbours_whole"](spark, sf_dir))


def test_blocks_straight_from_lines(spark, sf_dir, monkeypatch):
    """F4 F7 F8 of the third round: no table of pairs or of products is written, and nothing is joined."""
    for m, name, n in ((packed, "LOCAL", 0), (packed, "BLOCK", 1500), (reach, "ROWS", 1100), (reach, "NEIGHBOURS", 1100), (reach, "AT_ONCE", 500)):
        monkeypatch.setattr(m, name, n)
    e = staged(edges_of(spark, sf_dir, 1), "e")
    a = staged(matrix_of(e), "a")
    df = QUERIES["spgemm_whole"](spark, sf_dir)
    assert "Join" not in plan(df)
    got = df.collect()
    assert {(r.i, r.j): r.v for r in got} == {(r.i, r.j): r.v for r in linalg.spgemm(a, a).collect()} and len(got) == len({(r.i, r.j) for r in got})
    df = QUERIES["soc_robust_whole"](spark, sf_dir)
    assert "Join" not in plan(df)
    got, want = ({(r.src, r.dst): r.soc for r in x.collect()} for x in (df, cluster.robust_soc_scalar(e, weights.aux_diagonal(graph_of(e)))))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    got = QUERIES["common_neighbours_whole"](spark, sf_dir).collect()
    assert {(r.src, r.dst): r.common for r in got} == {(r.src, r.dst): r.common for r in reach.common_neighbours(e).collect()} and len(got) == e.count()
