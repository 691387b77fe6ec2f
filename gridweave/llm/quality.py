"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are taken from the bytes of the whole text in one pass (``document_stats``). Trees grow level by level from
histograms of binned statistics; a fitted model is three flat arrays (feature, threshold, leaf value), one row per tree in
heap order, so that numpy walks all trees and all documents of a batch at once.

Scale: scoring is one narrow pass with Arrow batches and a model of a few kB. Fitting collects at most ``max_train`` labelled
rows of statistics (a documented bound, chosen by a hash of the id) to the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound on the labelled rows used for fitting.
MAX_TRAIN = 20_000
#: Texts that a worker copies out of a batch at a time.
SLICE = 256

STATS = (
    "log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "adjacent_repeats", "log_lines", "distinct_lines", "line_words",
    "upper", "lower", "digits", "spaces", "high_bytes", "pipes", "exclamations", "symbols", "stops_commas", "other_punctuation", "distinct_x_words",
)


def _byte_classes() -> np.ndarray:
    """A 0/1 matrix from byte values to classes, in the order of the shares in STATS from "upper" on."""
    table = np.zeros((256, 9))
    for value in range(256):
        c = chr(value)
        kind = (
            0 if "A" <= c <= "Z" else 1 if "a" <= c <= "z" else 2 if "0" <= c <= "9" else 3 if c in " \t\n\r\x0b\x0c" else 4 if value >= 128
            else 5 if c == "|" else 6 if c == "!" else 7 if c in "#$%&*@^~<>{}[]\\=+_/" else 8 if c in ".," else None
        )
        if kind is not None:
            table[value, kind] = 1
    return table


_CLASSES = _byte_classes()


def document_stats(text: bytes) -> list[float]:
    """The statistics of one text (UTF-8 bytes); an empty text has zeros."""
    n = len(text)
    if not n:
        return [0.0] * len(STATS)
    words = text.split()
    k = max(len(words), 1)
    counts = Counter(words)
    lines = text.split(b"\n")
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASSES / n
    repeats = sum(map(eq, words, words[1:])) / k
    distinct = len(counts) / k
    other = max(0.0, 1.0 - float(shares.sum()))
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), (1 - float(shares[3])) * n / k, distinct, max(counts.values(), default=0) / k, repeats,
        float(np.log1p(len(lines))), len(set(lines)) / len(lines), len(words) / len(lines), *map(float, shares), other, distinct * float(np.log1p(len(words))),
    ]


def utf8_values(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """The texts of an Arrow string column as bytes, nulls as empty, without decoding them; few are copied at a time."""
    for at in range(0, len(column), SLICE):
        for x in column.slice(at, SLICE).cast(pa.binary()).to_pylist():
            yield x or b""


def texts_of(column: pa.Array | pa.ChunkedArray) -> Iterator[str | None]:
    """The texts of an Arrow string column, few at a time."""
    for at in range(0, len(column), SLICE):
        yield from column.slice(at, SLICE).to_pylist()


def batch_stats(texts: pa.Array) -> np.ndarray:
    rows = [document_stats(t) for t in utf8_values(texts)]
    return np.array(rows, dtype=np.float64).reshape(len(rows), len(STATS))


@dataclass(frozen=True)
class Trees:
    """Boosted trees of one depth in heap order: node i has the children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray  # the same; a value above it goes right
    leaf: np.ndarray  # (trees, 2**depth)

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), dtype=np.int64)
        row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        for _ in range((inner + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return self.base + self.leaf[tree, at - inner].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0, least: int = 10) -> Trees:
    """Logistic gradient boosting with histograms.

    With no rows, or one class only, there are no useful splits: the model gives the smoothed share of ones everywhere.
    """
    n, features = x.shape
    share = (float(y.sum()) + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**depth))
    if n == 0 or y.min() == y.max():
        return Trees(base, feature, threshold, leaf)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(features)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(features)], axis=1)
    offset = np.arange(features) * bins
    score = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            cell = ((at - first)[:, None] * (features * bins) + offset + binned).ravel()
            shape = (nodes, features, bins)
            gs = np.bincount(cell, np.repeat(g, features), nodes * features * bins).reshape(shape).cumsum(axis=2)
            hs = np.bincount(cell, np.repeat(h, features), nodes * features * bins).reshape(shape).cumsum(axis=2)
            cs = np.bincount(cell, minlength=nodes * features * bins).reshape(shape).cumsum(axis=2)
            ga, ha, ca = gs[:, :, -1:], hs[:, :, -1:], cs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (ga - gs) ** 2 / (ha - hs + l2) - ga**2 / (ha + l2)
            gain[(cs < least) | (ca - cs < least)] = -1
            best = gain.reshape(nodes, -1).argmax(axis=1)
            f, b = np.divmod(best, bins)
            good = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-6
            for k in np.flatnonzero(good):
                feature[t, first + k], threshold[t, first + k] = f[k], edges[f[k]][b[k]]
            at = 2 * at + 1 + (good[at - first] & (binned[np.arange(n), f[at - first]] > b[at - first]))
        at -= inner
        leaf[t] = -rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + l2)
        score += leaf[t][at]
    return Trees(base, feature, threshold, leaf)


def held_out(id_col: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether the CRC-32 of the id as text leaves this remainder; false for null ids."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_train: int) -> DataFrame:
    """(doc_id, text, y) of at most ``max_train`` labelled ids that are not held out.

    The ids are those first in the order of a hash, so the choice depends on no partitioning. Ids with several labels get
    their rounded mean; null labels and ids don't count. The id list is bounded, and so it may be broadcast.
    """
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    y = y.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id", F.lit("train")), "doc_id").limit(max_train)
    return docs.select("doc_id", "text").join(F.broadcast(y), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees:
    """Fit on (doc_id, quality) labels outside the held-out fold. Repeated documents of an id count once."""

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = batch_stats(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = training_rows(docs, labels, "quality", max_train).select(F.col("doc_id").cast("long"), "text", "y").mapInArrow(stats, "doc_id long, y int, x array<double>")
    # of equal ids the smallest statistics are kept: bounded, and the same on every run
    got = sorted(rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("x").alias("x")).collect())
    x = np.array([r.x for r in got], dtype=np.float64).reshape(len(got), len(STATS))
    return fit_trees(x, np.array([r.y for r in got], dtype=np.float64))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """All columns of ``docs`` but those named like the new ones, with quality_score (0 to 1) and quality_predicted (0 or 1).

    Null and empty texts are scored too (by statistics of zero). Only ``text`` is an input. Other columns pass through.
    """
    own = ["quality_score", "quality_predicted"]
    schema = docs.drop(*own).schema.add("quality_score", "double").add("quality_predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.probability(batch_stats(b.column("text")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*b.schema.names, *own])

    return docs.drop(*own).mapInArrow(run, schema)
