"""What keeps the queries within their limits on larger tables, and that results are the same."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from gridweave.operators import shared, weights
from gridweave.queries.graph_queries import QUERIES
from gridweave.sources.graphs import Graph


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("side, many", [(7, 40), (2000, 40), (7, 4000)])
def test_shared_slots_by_brute_force(side, many, spark, monkeypatch):
    """blocks of few members, one block, and slots that hardly anybody shares; one slot is everybody's in the first two."""
    monkeypatch.setattr(shared, "SIDE", side)
    rng = np.random.default_rng(side + many)
    rows = {(int(m) - 30, f"s{s}") for m, s in zip(rng.integers(0, 60, 300), rng.integers(0, many, 300), strict=True)}
    rows |= {(m, "all") for m in range(-30, 30) if many == 40}
    slots = {}
    for m, s in sorted(rows):
        slots.setdefault(s, []).append(m)
    want = Counter(p for ms in slots.values() for p in combinations(ms, 2))
    got = shared.sharing(spark.createDataFrame(sorted(rows), "member long, slot string")).collect()
    assert len(got) == len(want) and {(r.src, r.dst): r.w for r in got} == want


def test_user_pairs_are_not_shuffled(spark, sf_dir):
    """pairs by a join of the slots with themselves were shuffled once for each slot that they share."""
    assert "Join" not in plan(QUERIES["g_user_edges"](spark, sf_dir))


def test_isolated_never_broadcasts_the_ends(spark, sf_dir):
    """Catalyst takes the ends for as small as the columns of their files; there are as many as pairs in the orders."""
    assert "BroadcastHashJoin" not in plan(QUERIES["drop_isolated_whole"](spark, sf_dir))
    v = spark.createDataFrame([(k,) for k in (1, 2, 2, 3, 4, 4)], "vid long")
    e = spark.createDataFrame([(1, 3, 1.0), (1, 3, 2.0)], "src long, dst long, w double")
    assert sorted(r.vid for r in weights.isolated(Graph(v, e)).collect()) == [2, 2, 4, 4]
