"""URL filters: given rules, and association rules mined from labelled URLs.

A URL is a set of tokens (host labels, path words, extension, query keys, ...). Spark's FP-growth mines token sets that come
with the label "bad" often enough (support) and reliably enough (confidence); rules with a more general rule of no lower
confidence are pruned. Mined rules match by inverted index: a rule waits under its rarest token, a URL asks with each of its
tokens, and what meets is verified. Given rules come first: the longest that fits decides.

Scale: only the URL is read. Parsing is native. URLs meet rules once for each distinct URL, in a join on the token; the mined
rules are few by construction (support), and Catalyst may broadcast them by their size.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.session import staged

#: (verdict, host/path); a rule fits its host and all subdomains if the path starts with its own.
GIVEN_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.75
LEAST = 20
BAD = "label:bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # the longest ends up outermost
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL: whole host, its labels, path words (numbers as one token), extension, query keys, fragment."""
    host, path = host_of(url), path_of(url)
    part = lambda prefix, items: F.transform(items, lambda x: F.concat(F.lit(prefix), x))
    full = lambda items: F.filter(items, lambda x: x != "")
    words = F.transform(full(F.split(path, "[/.]")), lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("0")).otherwise(F.lower(x)))
    keys = full(F.split(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), "&"))
    return F.array_distinct(F.concat(
        part("host:", full(F.array(host))), part("label:host:", full(F.split(host, r"\."))), part("path:", words),
        part("query:", F.transform(keys, lambda x: F.substring_index(x, "=", 1))), F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    ))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, least: int = LEAST, held_out: bool = True) -> DataFrame:
    """(tokens, rarest, confidence, support) of the rules tokens -> bad, from ``labelled`` (url, bad 0/1).

    Null URLs and labels don't count; a URL counts once, as bad if any of its labels is. With ``held_out``, a third of the URLs (by
    CRC-32) is kept from mining, and rules whose confidence on it is lower than ``min_confidence``, or that it doesn't show, go.
    With nothing to learn from there are no rules.
    """
    once = labelled.where("url is not null and bad is not null").groupBy("url").agg(F.max("bad").alias("bad"))
    once = once.select("url", tokens_of(F.col("url")).alias("t"), (F.col("bad") > 0).cast("int").alias("bad"), ((F.crc32(F.col("url").cast("binary")) % 3 == 1) & F.lit(held_out)).alias("out"))
    once = staged(once, "url-labelled")
    known = once.where("not out")
    n = known.count()
    support = max(min_support, least / max(n, 1))
    # only tokens of enough bad URLs can be in a rule; of those in the same URLs the first stands for all
    each = known.select("bad", F.xxhash64("url").cast("decimal(38,0)").alias("h"), F.explode("t").alias("token")).groupBy("token")
    each = each.agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n"), F.sum("h").alias("h")).where(F.col("bad") >= F.lit(support * n - 1e-9))
    used = staged(each.groupBy("n", "h").agg(F.min("token").alias("token")).select("token"), "url-tokens")
    items = known.select("url", "bad", F.explode("t").alias("token")).join(used, "token").groupBy("url").agg(F.max("bad").alias("bad"), F.array_sort(F.collect_set("token")).alias("t"))
    items = known.select("url", "bad").join(items.select("url", "t"), "url", "left").select(F.coalesce("t", F.array().cast("array<string>")).alias("t"), "bad")
    items = staged(items.select(F.when(F.col("bad") > 0, F.concat("t", F.array(F.lit(BAD)))).otherwise(F.col("t")).alias("items")), "url-items")
    empty = "tokens array<string>, rarest string, confidence double, support double"
    if support > 1 or used.limit(1).count() == 0:
        return labelled.sparkSession.createDataFrame([], empty)
    model = FPGrowth(itemsCol="items", minSupport=min(support, 1.0), minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD)).select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    rules = staged(rules, "url-rules")
    if held_out:
        seen = once.where("out").select("url", "bad", "t", F.explode("t").alias("first")).join(rules.select("tokens", F.col("tokens")[0].alias("first")), "first")
        seen = seen.where(F.size(F.array_except("tokens", "t")) == 0).groupBy("tokens").agg(F.avg("bad").alias("share")).where(F.col("share") >= min_confidence)
        rules = rules.join(seen.select("tokens"), "tokens", "left_semi")
    # a rule goes if a proper subset of its tokens is a rule of no lower confidence
    wide = rules.select("tokens", "confidence", F.explode("tokens").alias("t"))
    small = rules.select(F.col("tokens").alias("s"), F.col("confidence").alias("c"), F.col("tokens")[0].alias("t"))
    covered = wide.join(small, "t").where((F.size("s") < F.size("tokens")) & (F.size(F.array_except("s", "tokens")) == 0) & (F.col("c") >= F.col("confidence")))
    kept = rules.join(covered.select("tokens").distinct(), "tokens", "left_anti")
    often = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("t"), F.col("freq"))
    rarest = kept.select("tokens", F.explode("tokens").alias("t")).join(often, "t").groupBy("tokens").agg(F.min(F.struct("freq", "t"))["t"].alias("rarest"))
    return kept.join(rarest, "tokens").select("tokens", "rarest", "confidence", "support")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url): the distinct URLs that a mined rule fits."""
    asked = urls.where("url is not null").select("url").distinct().select("url", tokens_of(F.col("url")).alias("has"))
    met = asked.select("url", "has", F.explode("has").alias("rarest")).join(rules.select("tokens", "rarest"), "rarest")
    return met.where(F.size(F.array_except("tokens", "has")) == 0).select("url").distinct()


def judge(pages: DataFrame, mined: DataFrame, rules: tuple[tuple[str, str], ...] = GIVEN_RULES, id_col: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url).

    A null URL, or one without ``://``, has an empty host and path, and no rule fits it. Where no given rule fits, a URL is
    blocked if a mined one does and else allowed. Repeated rows stay repeated.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), "url", host.alias("host"), path.alias("path"))
    hits = matched(rows, mined).withColumn("hit", F.lit(True))
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("hit"), "block").otherwise("allow")
    return rows.join(hits, "url", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"))
