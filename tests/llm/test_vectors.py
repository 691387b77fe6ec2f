import math

import numpy as np
import pytest

from gridweave.llm import lsh, vafile
from gridweave.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, k, every, measure):
    ids = np.array([r[0] for r in rows])
    out = {}
    for i, (q, v) in enumerate(rows):
        if q % every == 0:
            s = [(-measure(v, u), c) for c, u in rows if c != q]
            out[q] = [(c, -x) for x, c in sorted(s)[:k]]
    return out, ids


def test_exact_search_with_ties_and_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-8, 8, 6) / 16).tolist()) for i in range(300)] + [(400 + i, [0.25] * 6) for i in range(60)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    vectors = vafile.integer_vectors(df)
    floors = [(i, np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in rows]
    want, _ = brute(floors, 20, 20, lambda a, b: int(a @ b))
    # cells of one integer, of four, and of a third of all values
    for levels in (256, 16, 3):
        got = vafile.search(vectors.where("vec_id % 20 = 0"), vectors, 20, query_block=5, candidate_block=40, levels=levels).collect()
        found = {}
        for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
            found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert found == want


def test_scan_keeps_what_may_be_best():
    rng = np.random.default_rng(4)
    for levels, values in ((256, 900), (64, 70), (8, 5000)):
        c, q = rng.integers(-values, values, (500, 12)), rng.integers(-values, values, (9, 12))
        low, width = int(c.min()), vafile.cell_width(int(c.min()), int(c.max()), levels)
        cells = vafile.approximations(c, low, width)
        assert cells.dtype == np.uint8 and int(cells.max()) < levels
        i, j, lower, upper = vafile.scan(q, cells, low, width, 10)
        exact = q @ c.T
        assert (lower <= exact[i, j]).all() and (exact[i, j] <= upper).all() and len(i) < 9 * 500
        for row in range(9):
            assert set(np.argsort(-exact[row], kind="stable")[:11].tolist()) <= set(j[i == row].tolist())


def test_rows_that_share_an_id_and_lengths(spark):
    """Rows of one id with other vectors are candidates for one another; vectors of other lengths are not compared."""
    rows = [(100, [1.0, 0.0], 0), (100, [0.5, 0.5], 0), (100, [0.5, 0.5], 0), (7, [1.0, 1.0], 0), (8, [1.0, 1.0, 1.0], 0), (200, [1.0, 0.0, 2.0], 0), (300, [1.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    exact = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in vafile.top_k(df, 20, 20).collect())
    assert exact == sorted([(100, 1, 7, 4096), (100, 2, 100, 2048), (100, 1, 7, 4096), (100, 2, 100, 2048), (200, 1, 8, 3 * 4096)])
    near = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in lsh.neighbours(df).collect())
    half = round(math.sqrt(0.5), 6)
    assert near == sorted([(100, 1, 7, half), (100, 2, 100, half), (100, 1, 7, 1.0), (100, 2, 100, half), (200, 1, 8, round(3 / math.sqrt(15), 6))])


ODD = [(0, None, 1), (20, [1.0, None], 1), (40, [float("nan"), 1.0], 1), (60, [float("inf"), 0.0], 1), (100, [0.0, 0.0], 1), (None, [1.0, 1.0], 1), (50, [1.0, 0.5], 1), (50, [1.0, 0.5], 1), (3, [2.0, 1.0], None), (4, [-1.0, 0.0], 1)]


def test_odd_vectors(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    got = {r.query_id: r for r in vafile.top_k(df, 20, 20).orderBy("rank").collect()}
    assert set(got) == {100}
    near = sorted((r.query_id, r.rank, r.vec_id) for r in lsh.neighbours(df).collect())
    assert near == [(50, 1, 3), (50, 2, 4)]
    for empty in (df.limit(0), df.where("vec_id < 0")):
        assert vafile.top_k(empty).count() == 0 and lsh.neighbours(empty).count() == 0


def test_copies_in_one_class(spark):
    """A third of all vectors are the same."""
    rng = np.random.default_rng(2)
    hot = rng.normal(size=8)
    rows = [(i, (hot if i % 3 == 0 else rng.normal(size=8)).astype(np.float32).tolist(), 0) for i in range(600)]
    got = {}
    for r in lsh.neighbours(spark.createDataFrame(rows, SCHEMA)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert all(len(v) == 5 for v in got.values()) and set(got) == set(range(0, 600, 50))
    assert got[0] == [3, 6, 9, 12, 15] and got[150] == [0, 3, 6, 9, 12]


def test_fewer_probes_where_vectors_have_structure(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 24))
    clustered = [(i, (centres[i % 60] + 0.05 * rng.normal(size=24)).astype(np.float32).tolist(), 0) for i in range(1500)]
    loose = [(i, rng.normal(size=24).astype(np.float32).tolist(), 0) for i in range(1500)]
    used = []
    for rows in (clustered, loose):
        classes, _ = lsh.classes_of(lsh.distinct_rows(lsh.valid_vectors(spark.createDataFrame(rows, SCHEMA))), 5)
        used.append(lsh.calibrated(classes, classes.where("least % 50 = 0"), 5, 1500))
    assert used[0][1] < used[1][1] / 4 and used[0][0] == 8


def test_one_bucket_and_many_visits(spark, monkeypatch):
    """Pieces, blocks of visitors, and the search of what found too little, held against all pairs."""
    for name, value in (("PIECE", 16), ("GROUP", 64), ("VISITORS", 7)):
        monkeypatch.setattr(lsh, name, value)
    rng = np.random.default_rng(8)
    rows = [(i, (np.ones(6) + 0.01 * rng.normal(size=6)).astype(np.float32).tolist(), 0) for i in range(400)]
    rows += [(1000 + 50 * i, (10.0 ** rng.integers(-3, 3) * rng.normal(size=6)).astype(np.float32).tolist(), 0) for i in range(20)]
    got = {}
    for r in lsh.neighbours(spark.createDataFrame(rows, SCHEMA), 5, 50, probes=40, hashes=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    v = [(i, np.array(x, float)) for i, x, _ in rows]
    want, _ = brute(v, 5, 50, lambda a, b: float(a @ b) / math.sqrt(float(a @ a) * float(b @ b)))
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    assert sum(c in got[q] for q, w in want.items() for c, _ in w) >= 0.9 * 5 * len(want)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1", "check_l"])
def test_recall(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = sorted((r.vec_id, np.array(r.embedding, dtype=float)) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect())
    ids, v = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        s[q] = -2
        want[int(ids[q])] = [(int(ids[c]), s[c]) for c in np.argsort(-s, kind="stable")[:5]]
    got = {}
    for r in QUERIES["op10_neighbours"](spark, d).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = (r.rank, r.score)
    assert set(got) == set(want)
    hits = sum(c in got[q] for q, w in want.items() for c, _ in w)
    assert hits >= 0.9 * sum(map(len, want.values()))
    by_id = dict(rows)
    for q, found in got.items():
        ranked = sorted(found.items(), key=lambda x: x[1][0])
        assert [x[1][1] for x in ranked] == sorted((x[1][1] for x in ranked), reverse=True)
        for c, (_, s) in ranked:
            a, b = by_id[q], by_id[c]
            assert abs(s - float(a @ b) / math.sqrt(float(a @ a) * float(b @ b))) < 1e-12
