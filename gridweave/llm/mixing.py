"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every document gets the exponential key ``-ln(u) / w`` (``u`` uniform from the document id, ``w`` its quality weight); within
a source, documents are taken in ascending key order, which is weighted sampling without replacement. A source's target is
spent on complete epochs first (every document once per epoch); the rest of the target is a fractional epoch: the documents
whose prefix sum of sizes, in key order, stays within the remaining budget.

Scale: the text is read once and never shuffled; only (id, source, size, key) is. A source may hold a third of all rows, so
its prefix sums are taken in two steps: sums over ranges of the key (partial aggregation), their running sum, and running
sums inside one range of one source. A range is a ``STEPS``-th of a unit of the key's logarithm. The logarithm of an
exponential variable has a density of at most 1 / e, and a weight only shifts it, so that whatever the weights are a range is
expected to hold no more than 1 / (e * STEPS) of its source's rows, and a source has a few ten thousand ranges at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.session import staged

#: Ranges of the key to a unit of its logarithm.
STEPS = 1024
#: No source takes more than this many times its size.
MAX_EPOCHS = 3
#: Weights of the sources in code point order, repeating.
SOURCE_WEIGHTS = (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"
#: What isn't a letter in lower case, or of a script without case.
LETTERS = r"[^\p{Ll}\p{Lo}\p{M}]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Weight of a document from 0.1 to 1.1: 0.1 plus the cube of its share of letters that are not capitals, of any script.

    In the labelled tables the share is 0.8 in documents of high quality and 0 to 0.7 in most others, in every language.
    Null and empty texts weigh 0.1. Native; any other positive column may be used in its place.
    """
    share = F.length(F.regexp_replace(text, LETTERS, "")) / F.nullif(F.length(text), F.lit(0)).cast("double")
    return F.coalesce(F.lit(0.1) + share * share * share, F.lit(0.1))


def uniform(key: Column) -> Column:
    """A uniform number in (0, 1) from the first 52 bits of the key's MD5; null keys count as an empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of the sources; ``sizes`` has (source, source_size), one row for each source.

    The sources, by code point and null last, weigh ``weights``, repeating, and share the sum of all sizes. A target stops at
    ``max_epochs`` times its source's size; what is above goes to the others by weight until none is above. That fixed point
    is min(cap, level * weight) for one level, found here with prefix sums over the sources in the order of cap / weight. The
    windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    leveled = ranked.withColumn("level", left / rest)
    # sources in fill order are at their caps until the level fits; from the first that fits, the level is that source's
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(everything.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()))
    return leveled.withColumn("level", level).select(
        "source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")).alias("target")
    )


def _drawn(id_col: str, size: Column | None, weight: Column | None) -> list[Column]:
    size = word_count(F.col("text")) if size is None else size
    weight = quality_weight(F.col("text")) if weight is None else weight
    return [size.alias("mix__size"), weight.cast("double").alias("mix__w")]


def _placed(id_col: str) -> list[Column]:
    """size, w, key and bucket, from size and w; the bucket is a monotone map of the key."""
    w = F.when((F.col("mix__w") > 0) & ~F.isnan("mix__w"), F.col("mix__w")).otherwise(F.lit(0.1))
    key = -F.ln(uniform(F.col(id_col))) / w
    bucket = F.floor(F.ln(key) * F.lit(float(STEPS))).cast("int")
    return [F.col("mix__size").alias("size"), w.alias("w"), key.alias("key"), bucket.alias("bucket")]


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, weight: Column | None = None,
        weights: tuple[int, ...] = SOURCE_WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, source, size, weight, source_size, target, epochs, taken): how often each row of ``docs`` is taken.

    ``size`` is a column expression over ``docs`` (words of ``text`` by default), ``weight`` a positive one
    (``quality_weight`` by default; null, non-positive and NaN weights count as 0.1). Rows with null or equal ids are rows
    like any other: equal ids share a key and are ordered by size, so reruns agree. ``taken`` counts words: size times
    (complete epochs + 1 if the fractional epoch selects the row). Empty tables give an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *_drawn(id_col, size, weight)).select("doc_id", "source", *_placed("doc_id"))
    rows = staged(rows, "mix")
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    start = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("start", F.coalesce(F.sum("bucket_size").over(start), F.lit(0))).alias("b")
    t = targets.alias("t")
    starts = starts.join(t, F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        F.col("b.source").alias("s"), F.col("bucket").alias("k"), "start", "source_size", "target")
    r = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("k")))
    inside = Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("prefix", F.col("start") + F.sum("size").over(inside))
    r = r.withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long"))
    chosen = F.col("prefix") <= F.col("target") - F.col("epochs") * F.col("source_size")
    copies = F.col("epochs") + F.when(chosen & (F.col("epochs") < max_epochs), 1).otherwise(0)
    return r.select("doc_id", "source", "size", F.col("w").alias("weight"), "source_size", "target", "epochs",
                    copies.cast("long").alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows of ``docs`` (doc_id, source, text, ...), all columns, each as often as the mix takes it; the order has no meaning.

    The decisions are those of ``mix``. Sizes and keys are found in one pass that stages them beside the rows, whose columns
    may have any names. No text is shuffled but that of the one range of keys of each source in which its budget ends: ranges
    below it are taken whole and those above it aren't, which a table of one row per source tells.
    """
    own = ["size", "w", "key", "bucket"]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(whole, *_drawn("doc_id", None, None), F.col("doc_id").alias("mix__id")).select("doc", "mix__id", *_placed("mix__id"))
    rows = staged(rows.select("doc", *own), "mix-rows").select("doc", *own, F.col("doc.source").alias("source"), F.col("doc.doc_id").alias("doc_id"))
    sums = staged(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs).alias("t")
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("end", F.sum("bucket_size").over(up_to)).alias("b")
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    plan = ends.join(targets, F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        F.col("b.source").alias("of"), "bucket", "bucket_size", "end", epochs.alias("epochs"), (F.col("target") - epochs * F.col("source_size")).alias("budget"))
    # the first range that isn't taken whole, and where it starts
    cut = F.min(F.when(F.col("end") > F.col("budget"), F.struct("bucket", (F.col("end") - F.col("bucket_size")).alias("start"))))
    plan = staged(plan.groupBy("of").agg(F.first("epochs").alias("epochs"), F.first("budget").alias("budget"), cut.alias("cut")).select(
        "of", "epochs", "budget", F.coalesce("cut.bucket", F.lit(2**31 - 1)).alias("last"), F.coalesce("cut.start", F.lit(0)).alias("start")), "mix-plan")
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    open_ = F.col("epochs") < max_epochs
    settled = joined.where("bucket <> last").select("doc", (F.col("epochs") + F.when(open_ & (F.col("bucket") < F.col("last")), 1).otherwise(0)).alias("taken"))
    inside = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    last = joined.where("bucket = last").withColumn("prefix", F.col("start") + F.sum("size").over(inside))
    last = last.select("doc", (F.col("epochs") + F.when(open_ & (F.col("prefix") <= F.col("budget")), 1).otherwise(0)).alias("taken"))
    every = settled.unionByName(last).where("taken > 0")
    return every.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken").cast("long"))).alias("copy")).select("doc.*")
