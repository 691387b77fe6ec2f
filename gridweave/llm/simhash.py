"""SimHash near-dedup by tiled exact comparison.

A document's fingerprint has a bit set if more than half of its shingle hashes have it. Distinct fingerprints are laid out in
tiles: a cell holds the fingerprints with the same population counts of their four 16-bit words, and a cell with more than
``TILE`` of them is cut into several tiles. The sum of the differences of the word counts is a lower bound of the Hamming
distance, so tile pairs whose counts differ by more than the radius are skipped; all other pairs are compared exactly with
numpy exclusive-or and bit counts. Nothing is approximate.

Scale: copies collapse to one fingerprint before any comparison. Fingerprints travel to the (at most 41 / 2) neighbouring
cells, not to all. A tile pair emits a spanning forest of what it links, never all pairs of a group, so its output is linear
in its rows. Visitors of a tile are streamed. Components are found by alternating star contraction on staged tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.quality import utf8_values
from gridweave.llm.runs import release
from gridweave.session import staged

#: Most fingerprints of one tile, and rows of one numpy comparison.
TILE = 8192
BLOCK = 1 << 21
SEED = 42
WORDS = 4


def shingle_hashes(text: bytes, size: int = 3, seed: int = SEED) -> np.ndarray:
    """XXH64 of the word shingles of a text, repeats included; A-Z are lower-cased, white space is that of ASCII.

    A text of fewer words has one shingle, the whole sequence; a text without words has none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts[: -(size - 1)].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, len(words) - size + 1)


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many rows of a matrix of 64-bit words have each bit; in bytes, as 255 rows at most are added up in one."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    total = bits[whole:].sum(axis=0, dtype=np.uint8).astype(np.int64)
    if whole:
        total += bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, as a signed number; zero if there are no hashes."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        total += bit_sums(hashes[at : at + (1 << 14), None])
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row, and th, a hash of the text; null texts count as empty. Whole texts, one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(shingle_hashes(t, shingle)) for t in utf8_values(b.column("text"))), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fp)], ["doc_id", "th", "fp"])
        release()

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, fp long")


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest index linked to each of n nodes by the edges (i, j)."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def near_forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that span what is within the radius: left against right, or left within itself if right is None."""
    other = left if right is None else right
    nodes = left if right is None else np.concatenate([left, right])
    shift = 0 if right is None else len(left)
    label = np.arange(len(nodes))
    step = max(1, BLOCK // max(len(other), 1))
    for at in range(0, len(left), step):
        near = np.bitwise_count(left[at : at + step, None] ^ other[None, :]) <= radius
        i, j = np.nonzero(near)
        i += at
        if right is None:
            keep = i < j
            i, j = i[keep], j[keep]
        if len(i):
            known = np.flatnonzero(label != np.arange(len(nodes)))
            label = forest(np.concatenate([known, i]), np.concatenate([label[known], j + shift]), len(nodes))
    linked = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[linked], nodes[label[linked]]


def _offsets(radius: int, words: int = WORDS) -> list[list[int]]:
    """Differences of word counts with a sum of at most the radius, of each pair of opposite ones the one whose first non-zero is positive."""
    out = [d for d in product(range(-radius, radius + 1), repeat=words) if 0 < sum(map(abs, d)) <= radius]
    return [list(d) for d in out if next(x for x in d if x) > 0]


def links(fps: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """(a, b): a spanning forest, tile pair by tile pair, of the distinct fingerprints in ``fps.fp`` within the radius.

    Every pair within the radius is linked by a path of these edges. There are at most 17**4 cells, whatever the input, so
    the table of their sizes may be broadcast.
    """
    word = [F.bit_count(F.shiftrightunsigned(F.col("fp"), 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(WORDS)]
    base = 17
    at = lambda cs: sum((c * base**k for k, c in enumerate(cs)), F.lit(0)).cast("int")
    placed = fps.select("fp", F.array(*word).alias("c"))
    placed = placed.select("fp", "c", at([F.col("c")[k] for k in range(WORDS)]).alias("cell"))
    cells = F.broadcast(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")))
    home = placed.join(cells, "cell").withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    own = home.select((F.col("cell") * F.lit(1 << 20).cast("long") + F.col("sub")).alias("tile"), F.lit(0).alias("role"), "fp")
    # to the tiles before one's own in the same cell ...
    inner = home.where("sub > 0").select("cell", F.explode(F.sequence(F.lit(0), F.col("sub") - 1)).alias("sub"), "fp")
    # ... and to all tiles of the neighbouring cells on one side
    moves = F.array(*[F.array(*map(F.lit, d)) for d in _offsets(radius)])
    to = placed.select("fp", "c", F.explode(moves).alias("d")).select("fp", *[(F.col("c")[k] + F.col("d")[k]).alias(f"n{k}") for k in range(WORDS)])
    for k in range(WORDS):
        to = to.where((F.col(f"n{k}") >= 0) & (F.col(f"n{k}") <= 16))
    outer = to.select("fp", at([F.col(f"n{k}") for k in range(WORDS)]).alias("cell")).join(cells, "cell")
    outer = outer.select("cell", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("sub"), "fp")
    visit = inner.unionByName(outer).select((F.col("cell") * F.lit(1 << 20).cast("long") + F.col("sub")).alias("tile"), F.lit(1).alias("role"), "fp")
    dealt = own.unionByName(visit).repartition("tile").sortWithinPartitions("tile", "role", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home_parts: list[np.ndarray] = []
        homes, current = np.zeros(0, np.uint64), None
        for b in batches:
            t, role = np.asarray(b.column("tile")), np.asarray(b.column("role"))
            fp = np.asarray(b.column("fp")).view(np.uint64)
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (role[1:] != role[:-1])) + 1
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(t)], strict=True):
                if lo == hi:
                    continue
                if t[lo] != current:
                    current, home_parts, homes = t[lo], [], np.zeros(0, np.uint64)
                part = fp[lo:hi]
                if role[lo] == 0:
                    if len(homes):
                        out.append(near_forest(homes, part, radius))
                    if len(part) > 1:
                        out.append(near_forest(part, None, radius))
                    home_parts.append(part)
                    homes = part if len(home_parts) == 1 else np.concatenate(home_parts)
                elif len(homes):
                    out.append(near_forest(homes, part, radius))
            out = [x for x in out if len(x[0])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out]).view(np.int64)) for k in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches; a root maps to itself.

    Alternating large-star and small-star contraction; each half is a partial aggregation and a join on the node, staged in
    the shared folder. It ends when the edges are stars, after about log(n) rounds.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    seen = None
    for _ in range(rounds):
        # large star: larger neighbours go to the smallest of the neighbourhood
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and the node itself go to the smallest neighbour
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = staged(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "cc")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def dedup(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """(doc_id, th, fp, root, component_id) for every row of ``docs`` (doc_id, text): component_id is the smallest doc_id reachable.

    Documents are linked if their fingerprints differ by at most ``radius`` bits; equal ones need no comparison. Rows with
    null ids are rows like any other, but never name a component that has an id (one with null ids only gets null). Repeated
    rows stay repeated. Empty and null texts have fingerprint zero and are linked like others.
    """
    rows = staged(fingerprints(docs, shingle), "simhash")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = staged(components(links(classes.select("fp"), radius)), "simhash-roots")
    named = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = staged(named, "simhash-classes")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(smallest, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "th", "fp", "root", "component_id")


def keep_one(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, of which one is left for each component: that of the smallest id, null last.

    Rows that share that id are told apart by a hash of the text; of equal ones, one is left. Only rows that repeat an id and a text are shuffled to leave one of them.
    """
    return keep_first(docs, staged(dedup(docs, radius, shingle), "simhash-members"))


def keep_first(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """What ``keep_one`` leaves, for components given as rows (doc_id, th, root)."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th"))
    best = rows.groupBy("root").agg(first.alias("best")).select(F.col("best.doc_id").alias("k_id"), F.col("best.th").alias("k_th")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("th") == F.col("k_th"))
    keys = rows.join(best, same, "left_semi").groupBy(F.col("doc_id").alias("k_id"), F.col("th").alias("k_th")).agg(F.count(F.lit(1)).alias("n"))
    keys = staged(keys, "simhash-kept")
    hashed = F.xxhash64("text") == F.col("k_th")
    match = F.col("doc_id").cast("long").eqNullSafe(F.col("k_id")) & hashed
    kept = docs.join(keys.where("n = 1"), match, "left_semi")
    again = keys.where("n > 1")
    if again.limit(1).count():
        repeated = docs.join(again, match, "left_semi")
        kept = kept.unionByName(repeated.dropDuplicates(["doc_id", "text"]))
    return kept


def hex_digits(fp_col: str = "fp"):
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(fp_col)), 16, "0"))
