import numpy as np
import pytest
import xxhash

from gridweave.llm import simhash
from gridweave.llm.queries import QUERIES

DOCS = "doc_id long, text string, doc_id2 string"


def slow_fp(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps, radius=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    group = {}
    for i in range(len(ids)):
        group.setdefault(find(i), []).append(ids[i])
    return [min((x for x in group[find(i)] if x is not None), default=None) for i in range(len(ids))]


def test_query_against_brute_force(spark, sf_dir):
    got = sorted(QUERIES["op1_simhash"](spark, sf_dir).collect())
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    fps = [slow_fp(d.text) for d in docs]
    want = [(d.doc_id, f"{fp:016x}", c) for d, fp, c in zip(docs, fps, slow_components([d.doc_id for d in docs], fps), strict=True)]
    assert [tuple(r)[:3] for r in got] == want


def test_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "one", "x"), (4, "one", "x"), (5, "ONE", None), (None, "one", "x"), (6, "two words", "x"), (7, "w " * 30_000, "x")]
    got = simhash.dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r.component_id for r in got}
    assert of[1] == of[2] == of[3] == 1 and of[4] == of[5] == of[None] == 4 and of[6] == 6 and of[7] == 7
    assert {r.doc_id: r.fp for r in got}[2] == 0
    assert simhash.dedup(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("tile", [4, 64])
def test_tiles_lose_no_link(spark, tile):
    """Fingerprints around a few centres, so that cells are full and many are cut into tiles."""
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, 6, dtype=np.int64)
    fps = {int(centres[k % 6]) ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for k, (a, b, c) in enumerate(rng.integers(0, 63, (300, 3)))}
    fps = sorted(fps | {int(x) for x in rng.integers(-(2**63), 2**63, 100, dtype=np.int64)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, 2, tile)).collect()}
    want = slow_components(fps, [x & (2**64 - 1) for x in fps])
    assert [roots.get(x, x) for x in fps] == want
