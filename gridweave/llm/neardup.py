"""SimHash near-dedup at a Jaccard similarity of word shingles: the form of ``simhash`` that the pipeline uses.

A text is the set of hashes of its five-word shingles; texts of one set are one node. A node's fingerprint has 256 bits, the
majorities of the set's hashes, because 64 can't tell a similarity of 0.8 from others. Nodes are laid out in tiles by size and
population count. Similar sets have sizes within a quarter of one another, and fingerprints within the radius have population
counts within it, so tile pairs beyond either are skipped; all others are compared with exclusive-or and bit counts. What is
within the radius is a candidate; every candidate that is used is verified with the exact sets, in whole numbers. Sets at 0.8
have fingerprints 38 bits apart on average with a deviation of 6, up to 48 and 6 for the smallest sets, and unlike ones about
128: at ``RADIUS`` a pair at 0.8 is missed with a probability below 1e-5, others with less.

Scale: a node travels as 48 bytes to the tiles of like size, never its text; the comparisons are quadratic within a quarter of
size, as the method has it. What this first pass sends on is not pairs but (node, tile) for nodes that have a candidate there.
Only these nodes get their sets, and only they go, with their sets, to these tiles, where a task verifies its candidates row by
row, leaves out what it has linked already, and sends on a spanning forest. So no group is ever listed in pairs, however large
it is and however unlike its members are. A tile holds at most ``TILE`` nodes and about ``HASHES`` hashes of sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.quality import utf8_values
from gridweave.llm.runs import mix, ragged, release
from gridweave.llm.simhash import bit_sums, components, keep_first, shingle_hashes
from gridweave.session import staged

SHINGLE = 5
#: The least similarity is LEAST[0] / LEAST[1].
LEAST = (4, 5)
#: Bits by which fingerprints of similar sets differ at most, and those of sets with fewer than ``FEW`` shingles.
RADIUS, RADIUS_FEW, FEW = 64, 76, 8
WORDS = 4
#: Nodes of a tile, hashes of their sets, and pairs that one numpy step compares.
TILE = 4096
HASHES = 2_000_000
STEP = 1 << 16
#: Size classes to a factor of 5 / 4.
CLASSES = 5
NAMES = [f"w{k}" for k in range(WORDS)]
_SHIFT = mix(np.arange(1, WORDS, dtype=np.uint64))


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(shingle_hashes(text, shingle))


def node_of(hashes: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes())).view(np.int64))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The four words of a set's fingerprint: a bit is set if more than half of the hashes (and of three remixes) have it."""
    total = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 1 << 12):
        h = hashes[at : at + (1 << 12)]
        total += bit_sums(np.stack([h, *(mix(h + s) for s in _SHIFT)], axis=1))
    return np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, th, node, size, w0 to w3) for every row; null texts count as empty. Whole texts, one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, size, words = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, WORDS), np.uint64)
            for k, text in enumerate(utf8_values(b.column("text"))):
                s = shingle_set(text)
                node[k], size[k], words[k] = node_of(s), len(s), wide_fingerprint(s)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(node), pa.array(size), *(pa.array(words[:, k].view(np.int64).copy()) for k in range(WORDS))], ["doc_id", "th", "node", "size", *NAMES])
        release()

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, node long, size long, " + ", ".join(f"{w} long" for w in NAMES))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the nodes in ``wanted`` (node, th), th the hash of one of its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t).astype("<u8").tobytes() for t in utf8_values(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], ["node", "hashes"])
        release()

    # of rows with one text, one is enough
    texts = docs.select("text", F.xxhash64("text").alias("th")).join(wanted, "th").select("node", "text")
    return texts.dropDuplicates(["node"]).mapInArrow(run, "node long, hashes binary")


def near_pairs(a: dict[str, np.ndarray], b: dict[str, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a and b (in a alone if b is None, each pair once) of what is within the radius and of like size."""
    other = a if b is None else b
    out: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, STEP // max(len(other["size"]), 1))
    for at in range(0, len(a["size"]), step):
        z = at + step
        lo = at if b is None else 0
        far = np.bitwise_count(a["w0"][at:z, None] ^ other["w0"][None, lo:])
        for w in NAMES[1:]:
            far += np.bitwise_count(a[w][at:z, None] ^ other[w][None, lo:])
        i, j = np.nonzero(far <= RADIUS_FEW)
        d = far[i, j]
        i, j = i + at, j + lo
        x, y = a["size"][i], other["size"][j]
        small, large = np.minimum(x, y), np.maximum(x, y)
        good = (LEAST[1] * small >= LEAST[0] * large) & (d <= np.where(small < FEW, RADIUS_FEW, RADIUS))
        if b is None:
            good &= i < j
        out.append((i[good], j[good]))
    return (np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links_of(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the candidates (i, j) that are similar and link what is not linked yet; ``label`` holds components and is updated."""
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    if not len(used):
        return i, j
    sizes = np.array([len(sets[k]) for k in used], np.int64)
    known, codes = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True)
    first = np.cumsum(sizes) - sizes
    mark = np.zeros(len(known), bool)
    a, b = at[: len(i)], at[len(i) :]
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    cuts = np.flatnonzero(np.diff(a, prepend=-1, append=-1))
    out: list[tuple[int, int]] = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        x = a[lo]
        ys = b[lo:hi]
        ys = ys[label[used[ys]] != label[used[x]]]
        if not len(ys):
            continue
        mine = codes[first[x] : first[x] + sizes[x]]
        mark[mine] = True
        common = np.add.reduceat(mark[codes[ragged(first[ys], sizes[ys])]], np.cumsum(sizes[ys]) - sizes[ys], dtype=np.int64)
        mark[mine] = False
        for y in ys[LEAST[1] * common >= LEAST[0] * (sizes[x] + sizes[ys] - common)].tolist():
            old, new = label[used[y]], label[used[x]]
            if old != new:
                label[label == max(old, new)] = min(old, new)
                out.append((int(used[x]), int(used[y])))
    got = np.array(out, np.int64).reshape(-1, 2)
    return got[:, 0], got[:, 1]


def _tiled(batches: Iterator[pa.RecordBatch], columns: list[str], compare: Callable[..., list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (tile, role): those at home in a tile, in parts, then its visitors, in parts. ``compare`` gets the tile, what
    is at home and a part (None: home in itself), and gives columns."""
    current, homes, carried = None, None, {}
    for b in batches:
        t, role = np.asarray(b.column("tile")), np.asarray(b.column("role"))
        cols: dict[str, Any] = {x: np.asarray(b.column(x)) for x in columns}
        cols |= {w: np.asarray(b.column(w)).view(np.uint64) for w in NAMES}
        if "hashes" in b.schema.names:
            cols["hashes"] = np.array([None, *(np.frombuffer(x.as_buffer(), "<u8") for x in b.column("hashes"))], object)[1:]
        cuts = np.flatnonzero((t[1:] != t[:-1]) | (role[1:] != role[:-1])) + 1
        out: list[list[np.ndarray]] = []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(t)], strict=True):
            if lo == hi:
                continue
            if t[lo] != current:
                current, homes, carried = t[lo], None, {}
            part = {x: v[lo:hi].copy() for x, v in cols.items()}
            if role[lo] == 0:
                if homes is not None:
                    out.append(compare(current, homes, part, carried, True))
                out.append(compare(current, part, None, carried, True))
                homes = part if homes is None else {x: np.concatenate([homes[x], part[x]]) for x in part}
            elif homes is not None:
                out.append(compare(current, homes, part, carried, False))
        out = [x for x in out if len(x[0])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out])) for k in range(len(names))], names)
    release()


def _near_tiles(tile: int, a: dict[str, np.ndarray], b: dict[str, np.ndarray] | None, carried: dict[str, Any], home: bool) -> list[np.ndarray]:
    i, j = near_pairs(a, b)
    mine, other = np.unique(a["node"][i]), np.unique((a if b is None else b)["node"][j])
    node = np.concatenate([mine, other])
    role = np.concatenate([np.zeros(len(mine), np.int32), np.full(len(other), 0 if home else 1, np.int32)])
    return [np.full(len(node), tile, np.int64), role, node]


def _links(tile: int, a: dict[str, np.ndarray], b: dict[str, np.ndarray] | None, carried: dict[str, Any], home: bool) -> list[np.ndarray]:
    i, j = near_pairs(a, b)
    nodes, sets = (a["node"], a["hashes"]) if b is None else (np.concatenate([a["node"], b["node"]]), [*a["hashes"], *b["hashes"]])
    # components of what is at home are carried on from part to part, those of visitors are not
    roots: dict[int, int] = carried
    label = np.array([roots.get(n, n) for n in nodes.tolist()], np.int64)
    x, y = links_of(list(sets), i, j if b is None else j + len(a["node"]), label)
    if home:
        moved = {n: r for n, r in zip(nodes.tolist(), label.tolist(), strict=True)}
        for n, r in list(roots.items()):
            roots[n] = moved.get(r, r)
        roots |= moved
    return [nodes[x], nodes[y]]


def layout(nodes: DataFrame, tile: int = TILE, hashes: int = HASHES) -> tuple[DataFrame, DataFrame, int]:
    """``nodes`` with the tile of each, (tile, to) with the tiles that may hold similar nodes, each pair once, and the number of tiles."""
    cls = F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(LEAST[1] / LEAST[0]) / CLASSES) + F.lit(1e-9)).cast("int")
    count = F.bit_count(F.col("w0")) + F.bit_count(F.col("w1")) + F.bit_count(F.col("w2")) + F.bit_count(F.col("w3"))
    placed = nodes.withColumn("cls", cls).withColumn("ones", count)
    # at most 257 counts of about 16 classes to each doubling of size: a bounded table
    cells = placed.groupBy("cls", "ones").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("most"))
    before = Window.partitionBy("cls").orderBy("ones").rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.lit(1), F.least(F.lit(tile), F.floor(F.lit(hashes) / F.max("most").over(Window.partitionBy("cls")))))
    cells = staged(cells.select("cls", "ones", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), room.cast("long").alias("room")), "near-cells")
    named = lambda c, s: (c.cast("long") * F.lit(1 << 32) + s)
    part = F.floor((F.col("before") + F.pmod(F.xxhash64("node"), F.col("n"))) / F.col("room")).cast("int")
    home = placed.join(F.broadcast(cells), ["cls", "ones"]).withColumn("tile", named(F.col("cls"), part)).drop("n", "before", "room", "cls", "ones")
    last = F.floor((F.col("before") + F.col("n") - 1) / F.col("room")).cast("int")
    subs = cells.select("cls", "ones", F.explode(F.sequence(F.floor(F.col("before") / F.col("room")).cast("int"), last)).alias("sub"))
    tiles = staged(subs.groupBy("cls", "sub").agg(F.min("ones").alias("lo"), F.max("ones").alias("hi")), "near-tiles")
    t, u = tiles.select("*", F.explode(F.sequence(F.lit(0), F.lit(CLASSES))).alias("d")).alias("t"), tiles.alias("u")
    near = (F.col("t.lo") - F.col("u.hi") <= RADIUS_FEW) & (F.col("u.lo") - F.col("t.hi") <= RADIUS_FEW)
    pairs = t.join(u, F.col("t.cls") + F.col("t.d") == F.col("u.cls")).where(near & ((F.col("t.d") > 0) | (F.col("t.sub") < F.col("u.sub"))))
    return home, pairs.select(named(F.col("t.cls"), F.col("t.sub")).alias("tile"), named(F.col("u.cls"), F.col("u.sub")).alias("to")), tiles.count()


def located(nodes: DataFrame, tile: int = TILE, hashes: int = HASHES) -> tuple[DataFrame, int]:
    """(tile, role, node): nodes with a candidate in a tile, role 0 if the tile is their own; and the number of tiles."""
    home, pairs, tiles = layout(nodes, tile, hashes)
    fields = ["node", "size", *NAMES]
    to = pairs.groupBy("tile").agg(F.collect_set("to").alias("to"))
    own = home.select("tile", F.lit(0).alias("role"), *fields)
    visit = home.select("tile", *fields).join(to, "tile").select(F.explode("to").alias("tile"), F.lit(1).alias("role"), *fields)
    dealt = _dealt(own.unionByName(visit), tiles)
    return dealt.mapInArrow(lambda x: _tiled(x, ["node", "size"], _near_tiles, ["tile", "role", "node"]), "tile long, role int, node long").distinct(), tiles


def _dealt(rows: DataFrame, tiles: int) -> DataFrame:
    """Tasks by tiles, not by bytes: what takes time is the comparisons."""
    spread = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), tiles)
    return rows.repartition(spread, "tile").sortWithinPartitions("tile", "role", "node")


def groups(docs: DataFrame, tile: int = TILE, hashes: int = HASHES) -> DataFrame:
    """(doc_id, th, root) for every row: rows of one root are linked by similar pairs. Texts without words are one group."""
    rows = staged(members(docs), "near-rows")
    nodes = rows.where("size > 0").groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", *NAMES)], F.min("th").alias("th"))
    nodes = staged(nodes, "near-nodes")
    places, tiles = located(nodes.drop("th"), tile, hashes)
    places = staged(places, "near-places")
    live = nodes.join(places.select("node").distinct(), "node", "left_semi")
    sets = staged(live.drop("th").join(sets_of(docs, live.select("node", "th")), "node"), "near-sets")
    found = _dealt(places.join(sets, "node"), tiles).mapInArrow(lambda x: _tiled(x, ["node", "size"], _links, ["a", "b"]), "a long, b long")
    roots = staged(components(staged(found, "near-links")), "near-roots")
    return rows.join(roots, "node", "left").select("doc_id", "th", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of which one is left for each group of near-duplicates (``simhash.keep_first``).

    It is that of the smallest id, null last; of texts without words one is left. Empty tables stay empty.
    """
    return keep_first(docs, staged(groups(docs), "near-members"))
