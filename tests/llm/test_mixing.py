import math
from hashlib import md5

import pytest
import regex
from pyspark.sql import functions as F

from gridweave.llm import mixing

SCHEMA = "doc_id long, source string, text string, size long"


def slow_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, full, left = {}, set(), float(sum(sizes.values()))
    while True:
        rest = [s for s in names if s not in full]
        total = sum(w[s] for s in rest)
        over = [s for s in rest if left * w[s] / total > cap * sizes[s]]
        if not over:
            return target | {s: left * w[s] / total for s in rest}
        for s in over:
            target[s] = cap * sizes[s]
        full |= set(over)
        left = sum(sizes.values()) - sum(target[s] for s in full)
        if len(full) == len(names):
            return target


def slow_mix(rows):
    size = lambda t: len(regex.findall(r"[^\x20\x09-\x0D]+", t or ""))
    weight = lambda t: 0.1 + (len(regex.findall(r"[\p{Ll}\p{Lo}\p{M}]", t)) / len(t)) ** 3 if t else 0.1
    sizes = {}
    for _, s, t, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    out = []
    for s, target in slow_targets(sizes).items():
        epochs = int(target // sizes[s]) if sizes[s] else 0
        key = lambda r: (-math.log((int(md5(str(r[0] if r[0] is not None else "").encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weight(r[2]), r[0] is not None, r[0] or 0, size(r[2]))
        run = 0
        for r in sorted((r for r in rows if r[1] == s), key=key):
            run += size(r[2])
            out.append((r[0], s, size(r[2]) * (epochs + (epochs < 3 and run <= target - epochs * sizes[s]))))
    return out, sizes


@pytest.fixture(scope="module")
def rows():
    r = [(k, f"s{k % 5}", " ".join(["word"] * (k % 17)) + "X" * (k % 3), 1) for k in range(400)]
    r += [(1000 + k, "hot", "a b c\td " * (k % 9), 1) for k in range(300)] + [(None, None, None, 1), (7, "s2", "", 1), (7, "s2", "", 1), (2000, "zero", " ", 1), (2001, "long", "w " * 50_000, 1)]
    return r


def test_against_brute_force(spark, rows):
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    want, sizes = slow_mix(rows)
    key = lambda x: tuple((y is None, y) for y in x)
    assert sorted(((r.doc_id, r.source, r.taken) for r in got), key=lambda x: repr(x)) == sorted(want, key=lambda x: repr(x)) and key
    target = slow_targets(sizes)
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source] and r.taken <= 3 * r.size
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6


def test_rows_repeat_as_decided(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("size", "taken").withColumn("mix_size", F.lit(1)).withColumn("bucket", F.lit("b"))
    got = mixing.mixed_rows(df)
    assert got.columns == df.columns
    counts = {(r.doc_id, r.source): r["n"] for r in got.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n")).collect()}
    decided = {}
    for r in mixing.mix(df).collect():
        decided[r.doc_id, r.source] = decided.get((r.doc_id, r.source), 0) + r.copies
    assert counts == {k: v for k, v in decided.items() if v}


def test_weights_rank_quality_not_languages(spark):
    texts = ["plain words in a row here", "простые слова в одном ряду", "这里有一些普通的文字", "SHOUTED WORDS IN A ROW", "0.1 0.2 | 33 -- ;; 9"]
    w = [r.w for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.quality_weight(F.col("t")).alias("w")).collect()]
    assert min(w[:3]) > 0.5 and max(w[3:]) < 0.2


@pytest.mark.parametrize("weight", [1e-6, 0.1, 0.3, 1.0, 50.0])
def test_no_range_is_hot(spark, weight):
    n = 60_000
    df = spark.range(n).select("id", F.lit(1).alias("mix__size"), F.lit(weight).alias("mix__w")).select(*mixing._placed("id"))
    most = df.groupBy("bucket").count().agg(F.max("count")).first()[0]
    # 1 / (e * STEPS) of the rows, with room for chance
    assert most <= n / (math.e * mixing.STEPS) + 6 * math.sqrt(n / (math.e * mixing.STEPS))
    assert df.where("bucket <> floor(ln(key) * 1024)").count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(df).count() == 0 and mixing.mixed_rows(df).count() == 0
