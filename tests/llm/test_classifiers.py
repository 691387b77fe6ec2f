import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridweave.llm import quality, toxicity
from gridweave.llm.queries import QUERIES

D = "/root/testdata/sf0.1"


def judged(spark, name, label):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    got = QUERIES[name](spark, D).collect()
    assert len(got) == spark.read.parquet(f"{D}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(labels[r.doc_id], r.predicted, r.score) for r in got if r.held_out and r.doc_id in labels]
    return np.array(held)


def auc(held):
    order = held[:, 2].argsort().argsort() + 1
    y = held[:, 0] == 1
    return (order[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def test_quality_on_held_out_labels(spark):
    held = judged(spark, "op9_quality", "quality")
    assert (held[:, 0] == held[:, 1]).mean() > 0.98 and auc(held) > 0.98


def test_toxicity_on_held_out_labels(spark):
    held = judged(spark, "op5_toxicity", "toxic")
    clean = held[:, 0] == 0
    assert held[clean, 1].mean() < 0.01 and held[~clean, 1].mean() > 0.85 and auc(held) > 0.95


def test_quality_query_against_one_by_one(spark, sf_dir):
    """Every document's score from its statistics alone, tree by tree."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in QUERIES["op9_quality"](spark, sf_dir).collect()}
    for d in docs.select("doc_id", "text").collect():
        row = quality.batch_stats(pa.array([d.text], pa.string()))[0]
        total = m.base
        for f, t, leaf in zip(m.feature, m.threshold, m.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + (row[f[at]] > t[at])
            total += leaf[at - len(f)]
        assert abs(got[d.doc_id] - 1 / (1 + math.exp(-total))) < 1e-12


def test_toxicity_query_against_one_by_one(spark, sf_dir):
    """Every document's severity from the weights of its words' slots, without caches or batches."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.fit(docs.select("doc_id", "text"), labels)
    got = {r.doc_id: r for r in QUERIES["op5_toxicity"](spark, sf_dir).collect()}
    for d in docs.select("doc_id", "text").collect():
        eta = sum(m.weights.get(s, 0.0) for s in {s for w in toxicity.words(d.text) for s in toxicity.slots(w, m.bits)})
        above = [1 / (1 + math.exp(-(eta - t))) for t in m.thresholds]
        r = got[d.doc_id]
        assert abs(r.severity - sum(above)) < 1e-9 and abs(r.score - above[0]) < 1e-9 and r.predicted == (above[0] >= 0.5)


def test_trees_walk_as_one_by_one():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality.fit_trees(x, y, trees=20, depth=3)
    slow = []
    for row in x:
        total = m.base
        for f, t, leaf in zip(m.feature, m.threshold, m.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + (row[f[at]] > t[at])
            total += leaf[at - len(f)]
        slow.append(total)
    assert np.allclose(m.raw(x), slow) and ((m.raw(x) > 0) == y).mean() > 0.95


def test_ordinal_shares_weights_and_orders_thresholds():
    rng = np.random.default_rng(0)
    rows = [sorted(set(rng.integers(0, 20, rng.integers(0, 6)).tolist())) for _ in range(2000)]
    grades = np.array([min(2, sum(x < 5 for x in r)) for r in rows])
    m = toxicity.fit_ordinal(rows, grades, 3, list(range(20)))
    eta = np.array([sum(m.weights.get(x, 0) for x in r) for r in rows])
    p = m.exceedance(eta)
    assert m.thresholds[0] < m.thresholds[1] and (p[:, 0] >= p[:, 1]).all()
    assert ((p.sum(axis=1).round()).astype(int) == grades).mean() > 0.95


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (None, "x", 5.0), (3, "idiot " * 30_000, 5.0), (3, "idiot", None)], "doc_id long, text string, quality_score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    q, t = quality.fit(docs, none), toxicity.fit(docs, none)
    got = quality.score(docs, q).collect()
    assert len(got) == 5 and all(0 <= r.quality_score <= 1 for r in got) and all(0 <= r.toxic_score <= 1 for r in toxicity.score(docs, t).collect())
    one = spark.createDataFrame([(1, 1, 1), (1, 0, None), (2, None, 0), (3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    quality.fit(docs, one)
    toxicity.fit(docs, one)
    assert quality.score(docs.limit(0), q).count() == 0 and toxicity.score(docs.limit(0), t).count() == 0
    assert quality.training_rows(docs, one, "quality", 1).select(F.countDistinct("doc_id")).first()[0] <= 1
