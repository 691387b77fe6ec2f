"""Toxicity: cumulative-link ordinal regression on sparse text features.

Grades are ordered, 0 (clean) to G - 1. One weight vector is shared by all thresholds: P(grade > j) = sigmoid(w.x - theta_j)
with increasing theta_j, and the output is the expected grade, sum over j of P(grade > j).

Features are binary: for each distinct word (letters only, lower case) the word itself and its prefixes of 4 to 7 letters,
hashed to ``2**bits`` slots. Screening keeps the ``max_features`` slots most over-represented in other than clean documents
(chi-square over the training rows); all others have weight zero, so that scoring a text is one look-up for each distinct
word.

The tables mark toxic documents with 0 or 1 only. Grades come from them by ``grade_binary``: a marked document is severe (2)
if it has more distinct words with toxic features than the median of the marked documents, else mild (1).

Scale: scoring is one narrow pass; the model is bounded by ``max_features``. Fitting uses at most ``max_train`` labelled
documents (a documented bound, chosen by a hash of the id); their features are counted on the executors, and only the
screened features of each training row reach the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.quality import texts_of, training_rows
from gridweave.llm.runs import release
from gridweave.session import staged

MAX_TRAIN = 12_000
MAX_FEATURES = 4096
BITS = 22
PREFIXES = (4, 5, 6, 7)
#: Words that a worker remembers; beyond it the memory is cleared.
CACHE = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def slots(word: str, bits: int = BITS) -> tuple[int, ...]:
    """The slots of a word and of its prefixes."""
    mask = (1 << bits) - 1
    data = word.encode()
    return (zlib.crc32(b"w" + data) & mask, *(zlib.crc32(b"p" + word[:k].encode()) & mask for k in PREFIXES if len(word) >= k))


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass(frozen=True)
class Ordinal:
    """weights: by slot, those that aren't zero; thresholds: increasing."""

    weights: dict[int, float]
    thresholds: np.ndarray
    bits: int = BITS

    def hits(self, text: str | None, cache: dict[str, tuple[int, ...]]) -> set[int]:
        """The slots of a text that have a weight."""
        found: set[int] = set()
        for w in words(text):
            known = cache.get(w)
            if known is None:
                if len(cache) >= CACHE:
                    cache.clear()
                known = cache[w] = tuple(s for s in slots(w, self.bits) if s in self.weights)
            if known:
                found.update(known)
        return found

    def exceedance(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > j) for each row and threshold."""
        return 1 / (1 + np.exp(-np.clip(eta[:, None] - self.thresholds[None, :], -40, 40)))


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, grade_count: int, features: list[int], l2: float = 0.2, steps: int = 400, rate: float = 0.2) -> Ordinal:
    """Maximum likelihood by full-batch Adam. rows: indexes into ``features``, for each document.

    With no rows, or one grade only, all weights are zero and the thresholds give the smoothed shares of the grades.
    """
    n, cuts = len(rows), grade_count - 1
    above = np.array([((grades > j).sum() + 0.5) / (n + 1) for j in range(cuts)]) if n else np.full(cuts, 0.5)
    theta = np.maximum.accumulate(-np.log(above / (1 - above)) + 1e-3 * np.arange(cuts))
    if n == 0 or grades.min() == grades.max() or not features:
        return Ordinal({}, theta)
    i = np.repeat(np.arange(n), [len(r) for r in rows])
    f = np.array([x for r in rows for x in r], dtype=np.int64)
    # thresholds as a first one and positive gaps, so that they stay in order
    free = np.concatenate([np.zeros(len(features)), theta[:1], np.log(np.maximum(np.diff(theta), 1e-2))])
    m, v = np.zeros_like(free), np.zeros_like(free)
    k = len(features)
    low, high = grades == 0, grades == grade_count - 1
    for step in range(1, steps + 1):
        gaps = np.exp(free[k + 1 :])
        theta = free[k] + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = np.bincount(i, free[f], n)
        s = 1 / (1 + np.exp(-np.clip(eta[:, None] - theta, -40, 40)))
        upper = np.where(low, 1.0, s[np.arange(n), np.maximum(grades - 1, 0)])
        lower = np.where(high, 0.0, s[np.arange(n), np.minimum(grades, cuts - 1)])
        p = np.maximum(upper - lower, 1e-9)
        du, dl = np.where(low, 0.0, upper * (1 - upper)) / p, np.where(high, 0.0, lower * (1 - lower)) / p
        d_eta = -(du - dl)
        d_theta = np.bincount(np.maximum(grades - 1, 0), du, cuts)[:cuts] - np.bincount(np.minimum(grades, cuts - 1), dl, cuts)[:cuts]
        tail = d_theta[::-1].cumsum()[::-1]
        grad = np.concatenate([np.bincount(f, d_eta[i], k), tail[:1], tail[1:] * gaps]) / n
        grad[:k] += l2 / n * free[:k]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        free -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    theta = free[k] + np.concatenate([[0.0], np.cumsum(np.exp(free[k + 1 :]))])
    return Ordinal({s: float(w) for s, w in zip(features, free[:k], strict=True) if abs(w) > 1e-3}, theta)


def screen(positive: np.ndarray, total: np.ndarray, positives: int, n: int, max_features: int, least: int = 3) -> np.ndarray:
    """Indexes of the features most over-represented among positives by chi-square; ties go to the smaller index.

    The bound 12 leaves few of the millions of slots by chance; features of clean documents only say nothing of severity.
    """
    a, b = positive, total - positive
    c, d = positives - a, n - positives - b
    chi = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)
    chi[(total < least) | (a * (c + d) <= c * (a + b))] = 0
    order = np.lexsort((np.arange(len(chi)), -chi))[:max_features]
    return np.sort(order[chi[order] > 12])


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES, bits: int = BITS) -> Ordinal:
    """Fit three grades on (doc_id, toxic) labels outside the held-out fold."""
    rows = training_rows(docs, labels, "toxic", max_train).select("doc_id", "text", "y")
    rows = staged(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")), "toxic-train")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positive, total = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        for b in batches:
            for text, y in zip(texts_of(b.column("text")), b.column("y").to_pylist(), strict=True):
                at = list({s for w in words(text) for s in slots(w, bits)})
                total[at] += 1
                if y:
                    positive[at] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(positive[at].astype(np.int64)), pa.array(total[at].astype(np.int64))], ["slot", "a", "n"])
        del positive, total, at
        release()

    counts = rows.mapInArrow(count, "slot long, a long, n long").groupBy("slot").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    sums = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    n, positives = int(sums[0]), int(sums[1])
    # bounded by the training rows and by 2**bits, however many documents there are
    got = counts.where((F.col("a") >= 3) & (F.col("a") * n > F.col("n") * positives)).toPandas().sort_values("slot")
    at = screen(got["a"].to_numpy(float), got["n"].to_numpy(float), positives, n, max_features)
    features = [int(x) for x in got["slot"].to_numpy()[at]]
    toxic = {s for s, a, t in zip(features, got["a"].to_numpy()[at], got["n"].to_numpy()[at], strict=True) if t >= 5 and a >= 0.8 * t}
    index = {s: k for k, s in enumerate(features)}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, strong = [], []
            for text in texts_of(b.column("text")):
                each = [slots(w, bits) for w in words(text)]
                found.append(sorted({index[s] for x in each for s in x if s in index}))
                strong.append(float(sum(any(s in toxic for s in x) for x in each)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(found, pa.list_(pa.int64())), pa.array(strong, pa.float64())], ["doc_id", "y", "x", "strong"])

    chosen = rows.select(F.col("doc_id").cast("long"), "text", "y").mapInArrow(pick, "doc_id long, y int, x array<long>, strong double")
    got_rows = sorted(chosen.collect(), key=lambda r: r.doc_id)
    grades = grade_binary(np.array([r.y for r in got_rows], np.int64), np.array([r.strong for r in got_rows]))
    return fit_ordinal([r.x for r in got_rows], grades, 3, features)


def grade_binary(y: np.ndarray, strong: np.ndarray) -> np.ndarray:
    marked = y > 0
    if not marked.any():
        return np.zeros(len(y), np.int64)
    return np.where(marked, 1 + (strong > np.median(strong[marked])), 0).astype(np.int64)


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """All columns of ``docs`` but those named like the new ones, with severity (expected grade), toxic_score = P(grade > 0)
    and toxic_predicted (1 from 0.5 on). Null and empty texts have no features and get the intercept's values.
    """
    own = ["severity", "toxic_score", "toxic_predicted"]
    schema = docs.drop(*own).schema.add("severity", "double").add("toxic_score", "double").add("toxic_predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for b in batches:
            eta = np.array([sum(model.weights[s] for s in sorted(model.hits(t, cache))) for t in texts_of(b.column("text"))], dtype=np.float64)
            p = model.exceedance(eta)
            out = [pa.array(p.sum(axis=1)), pa.array(p[:, 0].copy()), pa.array((p[:, 0] >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns, *out], [*b.schema.names, *own])
        cache.clear()
        release()

    return docs.drop(*own).mapInArrow(run, schema)
