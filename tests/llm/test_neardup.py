"""The near-duplicate stage against brute force and planted copies."""

import numpy as np
import pytest

import corpus_pipeline
from gridweave.llm import neardup

SCHEMA = "doc_id long, text string"


def grams(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}


def jaccard(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def slow_kept(rows):
    """The smallest id of each group, by all pairs."""
    root = {i: i for i, _ in rows}
    sets = [grams(t) for _, t in rows]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, _) in enumerate(rows):
        for j in range(k):
            x, y = sets[k], sets[j]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and len(x & y) / len(x | y) >= 0.8:
                a, b = sorted((find(i), find(rows[j][0])))
                root[b] = a
    return sorted({find(i) for i, _ in rows})


def planted(n=40, copies=5):
    """Texts with copies of similarity 0.8 to 0.95, and some just below 0.8."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(n):
        words = [f"w{x}" for x in rng.integers(0, 4000, rng.integers(150, 400))]
        rows.append((1000 * k, " ".join(words)))
        for c in range(copies):
            near = list(words)
            # a replaced word changes five shingles
            for at in rng.choice(len(near), max(1, int(len(near) * (0.005, 0.01, 0.015, 0.02, 0.035)[c])), replace=False):
                near[at] = f"new{k}x{at}x{c}"
            rows.append((1000 * k + c + 1, " ".join(near)))
    return rows


def test_planted_copies(spark):
    rows = planted()
    of = [jaccard(t, rows[k - k % 6][1]) for k, (_, t) in enumerate(rows)]
    assert sum(0.8 <= x < 0.95 for x in of) >= 80 and sum(x < 0.8 for x in of) >= 20
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    assert got == slow_kept(rows)


@pytest.mark.parametrize("tile", [3, 16, 4096])
def test_tiles_lose_no_link(spark, tile):
    """A chain of texts whose ends aren't similar, a large group, and texts at the edge of the similarity, in tiles of any size."""
    base = [f"b{x}" for x in range(120)]
    rows = [(k, " ".join([*(f"x{k}y{x}" for x in range(k)), *base[k:]])) for k in range(30)]
    rows += [(100 + k, " ".join([*(f"c{x}" for x in range(k % 7 + 60)), f"end{k}"])) for k in range(40)]
    rows += [(200 + k, " ".join(f"s{x}" for x in range(k))) for k in range(30)]
    got = neardup.groups(spark.createDataFrame(rows, SCHEMA), tile, 700 if tile == 16 else neardup.HASHES).collect()
    want = slow_kept(rows)
    assert len({r.root for r in got}) == len(want) < len(rows)


def test_places_against_all_pairs(spark):
    rows = planted(12, 5)
    sets = {i: neardup.shingle_set(t.encode()) for i, t in rows}
    fps = {i: neardup.wide_fingerprint(s) for i, s in sets.items()}
    nodes = spark.createDataFrame([(i, len(sets[i]), *(int(w) for w in fps[i].view(np.int64))) for i in sets], "node long, size long, w0 long, w1 long, w2 long, w3 long")
    near = lambda a, b: int(np.bitwise_count(fps[a] ^ fps[b]).sum()) <= neardup.RADIUS and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b]))
    pairs = [(a, b) for a in sets for b in sets if a < b and near(a, b)]
    for tile, hashes in ((7, 1 << 30), (4096, 1500), (4096, 1 << 30)):
        home = {r.node: r.tile for r in neardup.layout(nodes, tile, hashes)[0].collect()}
        got = {(r.tile, r.role, r.node) for r in neardup.located(nodes, tile, hashes)[0].collect()}
        met = {frozenset((n, m)) for t, r, n in got if r == 0 for u, _, m in got if u == t and m != n}
        assert all(frozenset(p) in met for p in pairs) and {n for _, _, n in got} == {n for p in pairs for n in p}
        assert all((home[n] == t) == (r == 0) for t, r, n in got)
        at_home = {n: len([m for m in home if home[m] == home[n]]) for n in home}
        assert all(at_home[n] <= tile and (at_home[n] - 1) * len(sets[n]) <= hashes for n in home)


def test_links_against_all_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(40, 60), replace=False), rng.integers(0, 2**63, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(60)]
    i, j = np.triu_indices(60, 1)
    true = [(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
    label = np.arange(60)
    x, y = neardup.links_of(sets, i, j, label)
    assert set(zip(x.tolist(), y.tolist(), strict=True)) <= set(true) and len(x) == 60 - len(set(label.tolist())) and 2 < len(x) < len(true)
    assert all(label[a] == label[b] for a, b in true)


def test_fingerprint_bits():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 254, 255, 256, 700, 5000):
        h = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        words = np.stack([h, *(neardup.mix(h + s) for s in neardup._SHIFT)], axis=1)
        want = [sum(1 << b for b in range(64) if 2 * int((words[:, w] >> np.uint64(b) & np.uint64(1)).sum()) > len(h)) for w in range(4)]
        assert [int(x) for x in neardup.wide_fingerprint(h)] == want


def test_edge_cases(spark):
    rows = [(None, "alone here", "en"), (None, "alone here", "en"), (5, "Same text here now", "en"), (4, "same  text here now", "en"), (4, "same text here", "en"), (9, None, "en"), (8, "", "en"), (7, " \n", None)]
    got = sorted(map(tuple, neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()), key=repr)
    assert got == sorted([(None, "alone here", "en"), (4, "same  text here now", "en"), (4, "same text here", "en"), (7, " \n", None)], key=repr)
    assert neardup.keep_one(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
