"""The thin queries over the synthetic tables: one for each operator, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import lsh, mixing, pieces, quality, simhash, tokens, toxicity, urls, vafile, wrappers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every 20th vector, exactly."""
    return vafile.top_k(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and samples, by count, CRC-32, log probability and inclusion probability."""
    import public_tokenizers

    return pieces.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


OP2_SQL = """
WITH e AS (
  SELECT DISTINCT vec_id, embedding, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.embedding AS q, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND len(q.v) = len(c.v) AND (q.vec_id <> c.vec_id OR q.embedding <> c.embedding)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) <= 20
"""


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found of every 50th vector, by cosine."""
    return lsh.neighbours(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes from it."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH r AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         length(regexp_replace(text, '[^\p{Ll}\p{Lo}\p{M}]+', '', 'g')) / nullif(length(text), 0)::DOUBLE AS share,
         (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), d AS (SELECT *, coalesce(0.1::DOUBLE + share * share * share, 0.1::DOUBLE) AS w FROM r
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM d GROUP BY source
), c AS (SELECT *, 3.0::DOUBLE * source_size AS cap FROM s
), f AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level,
         row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS k
  FROM c WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT level FROM f WHERE level * weight <= cap ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size, least(cap, (SELECT level FROM l) * weight) AS target,
         CASE WHEN source_size > 0 THEN floor(least(cap, (SELECT level FROM l) * weight) / source_size) ELSE 0 END AS epochs
  FROM c
), p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.epochs,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / w, d.doc_id ROWS UNBOUNDED PRECEDING) AS prefix
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
       CAST(size * (epochs + CASE WHEN epochs < 3 AND prefix <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity (0 to 2), P(toxic) and the decision for every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "severity", F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL.

    The last number in a URL's path is the document that the page shows; its labels mark the URL: bad if that document is of
    low quality or toxic.
    """
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    shown = F.regexp_extract(urls.path_of(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    labelled = pages.select("url", F.when(shown != "", shown.cast("long")).alias("doc_id")).join(labels, "doc_id").select("url", "bad")
    return urls.judge(pages, urls.mine(labelled))


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return wrappers.extract(_table(spark, sf_dir, "pages"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids as read back from the ORC files."""
    import public_tokenizers

    return tokens.write_and_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score and decision for every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_top_k": op2_top_k,
    "op3_pieces": op3_pieces,
    "op4_mix_sources": op4_mix_sources,
    "op5_toxicity": op5_toxicity,
    "op6_url_rules": op6_url_rules,
    "op7_token_ids": op7_token_ids,
    "op8_page_text": op8_page_text,
    "op9_quality": op9_quality,
    "op10_neighbours": op10_neighbours,
}
ORACLE_SQL: dict[str, str] = {
    "op2_top_k": OP2_SQL,
    "op4_mix_sources": OP4_SQL,
}
