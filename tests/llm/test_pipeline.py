"""Each stage against brute force on its own input."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
pipeline = pytest.importorskip("corpus_pipeline")

from gridweave.llm import mixing, quality, simhash, toxicity  # noqa: E402
from tests.llm.test_neardup import slow_kept  # noqa: E402


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_duplicates", "mixture", "pieces"]
    kept = {}
    now = docs
    for name, stage in pipeline.STAGES:
        now = stage(spark, now, sf_dir).cache()
        kept[name] = now
        if name != "pieces":
            assert now.columns == docs.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    good = quality.score(docs, quality.fit(docs, labels)).where("quality_predicted = 1")
    assert ids(kept["quality"]) == ids(good)
    assert ids(kept["toxicity"]) == ids(toxicity.score(kept["quality"], toxicity.fit(docs, labels)).where("toxic_predicted = 0"))
    rows = sorted(kept["toxicity"].select("doc_id", "text").collect())
    assert ids(kept["near_duplicates"]) == slow_kept([(r.doc_id, r.text) for r in rows])
    copies = mixing.mix(kept["near_duplicates"]).where("copies > 0").select(F.explode(F.array_repeat("doc_id", F.col("copies").cast("int"))).alias("doc_id"))
    assert ids(kept["mixture"]) == ids(copies) == ids(kept["pieces"])
    assert sorted(map(repr, pipeline.run(spark, sf_dir).collect())) == sorted(map(repr, kept["pieces"].collect()))


def test_one_of_each_group_is_left(spark):
    rows = [(None, "alone", "en"), (None, "alone", "en"), (5, "same text here now", "en"), (4, "same text here now", "en"), (4, "same text here now", "en"), (4, "another text that is not like it", "en"), (9, None, "en"), (8, "", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(map(tuple, simhash.keep_one(df).collect()), key=repr)
    assert got == sorted([(None, "alone", "en"), (4, "same text here now", "en"), (4, "another text that is not like it", "en"), (8, "", "en")], key=repr)
    assert simhash.keep_one(df.limit(0)).count() == 0
