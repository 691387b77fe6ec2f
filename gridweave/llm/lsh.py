"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length one, where the largest cosine is the smallest Euclidean distance. A table hashes a vector with
``hashes`` functions floor((a.x + b) / width), a normal and b uniform. A query visits its own bucket and then perturbed
buckets in the order of their estimated success (the sum of squared distances to the boundaries that are crossed), a number
of ``probes`` for each table. Candidates of all tables are merged and ranked by exact cosine.

Parameters: the number of functions of a table grows with the number of vectors (``hashes_for``). How many buckets a query visits
is calibrated on the table itself: a bounded sample of queries is answered exactly, and the fewest probes that find ``TARGET``
of these neighbours are taken. On vectors with structure few probes do; directions without any need most of the table, at
any parameters.

Copies: equal vectors form one class with one entry in each bucket, and queries are classes too. A class keeps its smallest
``k + 1`` ids: no other member can be among the k nearest of anything, as copies tie and ties go to the smaller id. A bucket
may still hold many classes: it is cut into pieces of at most ``PIECE`` classes, and every query that visits the bucket gets
all of its pieces - nothing is capped. Queries are cut into blocks of ``VISITORS``, so that no hot bucket meets them all at once.

Scale: indexing sends tables rows for each class, with its vector; a visit is three numbers, and a query's vector goes once to
each group of buckets. Both meet in cogroups of bounded size, each of which holds many buckets. A bucket sends on at most k + 1
classes for each visit, so that no list of candidates is ever shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.vectors import by_length, distinct_rows, matrix, valid_vectors
from gridweave.session import staged

TABLES = 8
WIDTH = 2.5
SEED = 20
#: Share of the sampled queries' neighbours that the probes must find, queries of the sample, and most probes of a table.
TARGET = 0.96
SAMPLE = 100
MOST_PROBES = 64
#: Most classes of one piece of a bucket, about; entries of one cogroup, about; queries of a cogroup, about; query vectors of one
#: matrix product.
PIECE = 512
GROUP = 16_384
VISITORS = 8192
QUERIES = 256


def hashes_for(n: int) -> int:
    """Functions of a table for n classes: half the bits of n, 8 to 16."""
    return min(16, max(8, n.bit_length() // 2))


class Family:
    """The hash functions; ``dim`` numbers make a vector."""

    def __init__(self, dim: int, tables: int = TABLES, hashes: int = 8, width: float = WIDTH, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.tables, self.hashes, self.width = tables, hashes, width
        self.a = rng.normal(size=(dim, tables * hashes))
        self.b = rng.uniform(0, width, tables * hashes)
        # odd multipliers that mix the hashes of a table into one bucket number
        self.mix = rng.integers(1, 2**62, hashes, dtype=np.int64) * 2 + 1
        # vectors of other lengths have other buckets
        self.salt = np.int64(dim) << np.int64(40)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Positions in units of the width: rows, tables, hashes."""
        return ((x @ self.a + self.b) / self.width).reshape(len(x), self.tables, self.hashes)

    def bucket(self, cell: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cell.astype(np.int64) * self.mix).sum(axis=-1) + self.salt

    def probes(self, position: np.ndarray, count: int) -> np.ndarray:
        """Buckets of one query, (tables, count): its own, then perturbed ones by estimated success.

        The perturbation sets come from a heap with the two moves shift and expand over the boundary distances in order.
        """
        out = np.zeros((self.tables, count), np.int64)
        m = 2 * self.hashes
        for t in range(self.tables):
            cell = np.floor(position[t])
            low = position[t] - cell
            gap = np.concatenate([low, 1 - low])  # to the cell below, to the cell above
            order = np.argsort(gap, kind="stable")
            cost = gap[order] ** 2
            sets: list[np.ndarray] = [cell]
            heap = [(float(cost[0]), (0,))]
            while heap and len(sets) < count:
                c, chosen = heapq.heappop(heap)
                last = chosen[-1]
                if last + 1 < m:
                    heapq.heappush(heap, (c - float(cost[last]) + float(cost[last + 1]), (*chosen[:-1], last + 1)))
                    heapq.heappush(heap, (c + float(cost[last + 1]), (*chosen, last + 1)))
                moved = [order[i] % self.hashes for i in chosen]
                if len(set(moved)) == len(moved):
                    other = cell.copy()
                    for i in chosen:
                        other[order[i] % self.hashes] += -1 if order[i] < self.hashes else 1
                    sets.append(other)
            sets += [cell] * (count - len(sets))
            out[t] = self.bucket(np.stack(sets))
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def probes_needed(family: Family, queries: np.ndarray, near: list[np.ndarray], target: float = TARGET, most: int = MOST_PROBES) -> tuple[int, float]:
    """The fewest probes of a table that find ``target`` of the neighbours (a matrix for each query), at most ``most``, and what they
    find."""
    ranks: list[np.ndarray] = []
    for position, found in zip(family.project(unit(queries)), near, strict=True):
        if len(found):
            own = family.bucket(np.floor(family.project(unit(found))))
            hit = family.probes(position, most)[None, :, :] == own[:, :, None]
            ranks.append(np.where(hit.any(axis=2), hit.argmax(axis=2), most).min(axis=1))
    if not ranks:
        return 1, 1.0
    share = np.cumsum(np.bincount(np.concatenate(ranks), minlength=most + 1))[:most] / sum(map(len, ranks))
    enough = np.flatnonzero(share >= target)
    return (int(enough[0]) + 1 if len(enough) else most), float(share[enough[0]] if len(enough) else share[-1])


def classes_of(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(cls, least, v) and (cls, vec_id) of the rows (vec_id, vh, v): equal vectors are a class, least is its smallest id.

    The members are the smallest k + 1 of each class; the rank is limited before the shuffle, so a class that holds a third
    of all rows doesn't reach one task. Numbers of classes are made once, in a staged table.
    """
    classes = staged(vectors.groupBy("v").agg(F.min("vec_id").alias("least")).withColumn("cls", F.monotonically_increasing_id()), "lsh-classes")
    ids = Window.partitionBy("v").orderBy("vec_id")
    members = vectors.withColumn("n", F.row_number().over(ids)).where(F.col("n") <= k + 1)
    return classes, members.join(classes, "v").select("cls", "vec_id")


def best_in_block(qv: np.ndarray, cls: np.ndarray, least: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, class, cosine), by position, of each query vector's k best rows of a block, ties to the smaller id.

    A matrix product picks them with a margin for its rounding; the cosines are then taken pair by pair, so that a pair has
    the same one wherever it is met.
    """
    if len(cls) > k:
        rough = unit(qv) @ unit(v).T
        floor = np.partition(rough, len(cls) - k, axis=1)[:, len(cls) - k] - 1e-9
        i, j = np.nonzero(rough >= floor[:, None])
    else:
        i, j = (x.ravel() for x in np.indices((len(qv), len(cls))))
    x, y = qv[i], v[j]
    score = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
    order = np.lexsort((cls[j], least[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.searchsorted(i, np.arange(len(qv)))
    keep = np.arange(len(i)) - first[i] < k
    return i[keep], j[keep], score[keep]


def _meet(left: DataFrame, vectors: DataFrame, right: DataFrame, k: int, groups: int, blocks: int) -> DataFrame:
    """(q, cls, least, score): for each key the best of right's rows (key, cls, least, v) for each of left's (key, q), in cogroups
    of keys and of ``blocks`` parts of the queries, whose ``vectors`` are (cls, v)."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if a.num_rows and b.num_rows:
            known = a.filter(pc.is_valid(a["v"]))
            place = {q: n for n, q in enumerate(known["q"].to_pylist())}
            a = a.filter(pc.is_null(a["v"])).sort_by("key")
            b = b.sort_by("key")
            ka, kb = np.asarray(a["key"]), np.asarray(b["key"])
            q, cls, least, bv, qv = np.asarray(a["q"]), np.asarray(b["cls"]), np.asarray(b["least"]), b["v"], known["v"]
            keys, first = np.unique(ka, return_index=True)
            last = [*first[1:].tolist(), len(ka)]
            lo, hi = np.searchsorted(kb, keys, "left"), np.searchsorted(kb, keys, "right")
            one = len(pc.list_value_length(bv).unique()) == len(pc.list_value_length(qv).unique()) == 1
            right_matrix, left_matrix = (matrix(bv), matrix(qv)) if one else (None, None)
            at_left = np.array([place[x] for x in q.tolist()], np.int64)
            for a0, a1, b0, b1 in zip(first.tolist(), last, lo.tolist(), hi.tolist(), strict=True):
                if b1 == b0:
                    continue
                v = right_matrix[b0:b1] if one else matrix(bv.slice(b0, b1 - b0))
                for at in range(a0, a1, QUERIES):
                    rows = at_left[at : min(a1, at + QUERIES)]
                    x = left_matrix[rows] if one else matrix(qv.take(pa.array(rows)))
                    i, j, score = best_in_block(x, cls[b0:b1], least[b0:b1], v, k)
                    out.append((q[at + i], cls[b0 + j], least[b0 + j], score))
        got = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.table(dict(zip(("q", "cls", "least", "score"), map(pa.array, got), strict=True)))

    g = F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")
    part = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")
    visits = left.select(g.alias("g"), part.alias("part"), "key", "q")
    kind = right.schema["v"].dataType
    asked = visits.select("g", "part", "q").distinct().join(vectors.withColumnRenamed("cls", "q"), "q").select("g", "part", F.lit(None).cast("long").alias("key"), "q", "v")
    visits = visits.withColumn("v", F.lit(None).cast(kind)).unionByName(asked)
    index = right.withColumn("g", g).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = visits.groupBy("g", "part").cogroup(index.groupBy("g", "part")).applyInArrow(run, "q long, cls long, least long, score double")
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "least", "cls")
    merged = pairs.groupBy("q", "cls", "least").agg(F.max("score").alias("score"))
    return merged.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("q", "cls", "least", "score")


def calibrated(classes: DataFrame, asked: DataFrame, k: int, n: int, target: float = TARGET, sample: int = SAMPLE) -> tuple[int, int]:
    """(hashes, probes) for the table: the fewest probes that find the target share of the exact k nearest classes of ``sample`` queries.

    If most probes don't do for so many hashes, fewer are tried. The scan for the sample is one product of each row with at most
    ``sample`` vectors; what comes back are k vectors of each.
    """
    some = asked.orderBy(F.xxhash64("cls"), "cls").limit(sample).select("cls", "v").collect()
    hashes = hashes_for(n)
    if not some:
        return hashes, 1
    number = {(r.cls, len(r.v)) for r in some}
    of = {d: ([c for c, m in sorted(number) if m == d], np.array([r.v for r in sorted(some) if len(r.v) == d], np.float64)) for d in {m for _, m in number}}

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in by_length(b.column("v")):
                part = b.take(pa.array(rows))
                dim = len(part.column("v")[0])
                if dim in of:
                    cls = np.asarray(part.column("cls"))
                    i, j, score = best_in_block(of[dim][1], cls, np.asarray(part.column("least")), matrix(part.column("v")), k + 1)
                    take = pa.array(j)
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(of[dim][0], np.int64)[i]), part.column("cls").take(take), part.column("v").take(take), pa.array(score)], ["q", "cls", "v", "score"])

    kind = classes.schema["v"].dataType.simpleString()
    found = classes.select("cls", "least", "v").mapInArrow(nearest, f"q long, cls long, v {kind}, score double").where("q <> cls")
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "cls")
    near: dict[int, list] = {}
    for r in found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("q", "v").collect():
        near.setdefault(r.q, []).append(r.v)
    dim = max(of, key=lambda d: (len(of[d][0]), d))
    lists = [np.array(near.get(c, []), np.float64).reshape(-1, dim) for c in of[dim][0]]
    while True:
        probes, share = probes_needed(Family(dim, TABLES, hashes), of[dim][1], lists, target)
        if share >= target or hashes <= 4:
            return hashes, probes
        hashes -= 2


def neighbours(vectors: DataFrame, k: int = 5, every: int = 50, tables: int = TABLES, hashes: int | None = None, probes: int | None = None, width: float = WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the k nearest found, largest cosine first.

    Ties go to the smaller id; a query never finds its own row. Invalid and zero vectors take no part; rows that are equal in id and
    vector count once, other rows of an id are rows like any other. Vectors of one length are compared with one another only. A
    query that finds fewer than k rows is searched again against all rows, in blocks. Empty tables give an empty result. ``hashes``
    and ``probes`` are calibrated if not given.
    """
    rows = staged(distinct_rows(valid_vectors(vectors, nonzero=True)), "lsh")
    classes, members = classes_of(rows, k)
    members = staged(members, "lsh-members")
    n = classes.count()
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = staged(rows.where(F.col("vec_id") % every == 0).join(classes, "v").select(F.col("vec_id").alias("query_id"), "cls"), "lsh-queries")
    asked = staged(classes.join(queries.select("cls").distinct(), "cls", "left_semi"), "lsh-asked")
    if hashes is None or probes is None:
        hashes, probes = calibrated(classes, asked, k, n)
    families: dict[int, Family] = {}

    def keyed(batches: Iterator[pa.RecordBatch], visit: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for of_length in by_length(b.column("v")) if b.num_rows else []:
                part = b.take(pa.array(of_length))
                x = matrix(part.column("v"))
                family = families.setdefault(x.shape[1], Family(x.shape[1], tables, hashes, width))
                positions = family.project(unit(x))
                found = np.stack([family.probes(p, probes) for p in positions]) if visit else family.bucket(np.floor(positions))[:, :, None]
                # the table goes into the key
                found = found + (np.arange(family.tables, dtype=np.int64) << 58)[None, :, None]
                rows_ = pa.array(np.repeat(np.arange(part.num_rows), found.shape[1] * found.shape[2]))
                names = ["cls"] if visit else ["cls", "least", "v"]
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), *(part.column(c).take(rows_) for c in names)], ["bucket", *names])

    kind = classes.schema["v"].dataType.simpleString()
    indexed = classes.select("cls", "least", "v").mapInArrow(lambda x: keyed(x, False), f"bucket long, cls long, least long, v {kind}")
    visits = asked.select("cls", "v").mapInArrow(lambda x: keyed(x, True), "bucket long, cls long").distinct()
    # buckets of more than PIECE classes are cut; a visit goes to every piece
    sizes = indexed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    sizes = staged(sizes, "lsh-sizes")
    entries = sizes.agg(F.sum("pieces")).first()[0] * 64 + n * tables
    blocks = max(1, -(-asked.count() // VISITORS))
    key = F.xxhash64("bucket", "piece").alias("key")
    right = indexed.join(sizes.where("pieces > 1"), "bucket", "left").withColumn("piece", F.pmod(F.xxhash64("cls"), F.coalesce("pieces", F.lit(1))).cast("int")).select(key, "cls", "least", "v")
    left = visits.join(sizes, "bucket").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(key, F.col("cls").alias("q"))
    best = staged(_meet(left, asked.select("cls", "v"), right, k + 1, max(1, -(-entries // GROUP)), blocks), "lsh-best")
    # what found too little is searched in blocks of all classes
    enough = best.join(members.groupBy("cls").agg(F.count(F.lit(1)).alias("m")), "cls").groupBy("q").agg(F.sum("m").alias("m")).where(F.col("m") > k)
    short = staged(asked.join(enough, F.col("cls") == F.col("q"), "left_anti").select("cls", "v"), "lsh-short")
    if short.limit(1).count():
        parts = max(1, -(-n // GROUP))
        block = lambda x: F.xxhash64(x, F.size("v")).alias("key")
        every_block = short.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(block("block"), F.col("cls").alias("q"))
        dealt = classes.withColumn("block", F.pmod(F.xxhash64("cls"), F.lit(parts)).cast("int")).select(block("block"), "cls", "least", "v")
        again = _meet(every_block, short, dealt, k + 1, parts, blocks)
        best = staged(best.join(short.select(F.col("cls").alias("q")), "q", "left_anti").select("q", "cls", "least", "score").unionByName(again), "lsh-all")
    # k + 1 classes with their smallest k + 1 ids are enough: one of them may be the query's own row
    few = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    best = best.join(members, "cls").withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1).select("q", F.col("cls").alias("of"), "vec_id", "score")
    found = queries.join(best, F.col("cls") == F.col("q")).where("not (query_id = vec_id and cls = of)")
    rank = Window.partitionBy("query_id", "cls").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
