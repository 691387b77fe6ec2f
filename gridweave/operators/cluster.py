"""Strength of connection and clustering.

Sequential greedy orders are replaced by rounds of deterministic parallel choices: results are the same for every
partitioning. Ties are broken by an integer hash of the pair before its ids, without which uniform weights would serialise
the rounds. Each round is two aggregations by vertex and equi-joins on it; rounds are staged in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.columns import average, tie_hash, vertex_hash
from gridweave.functions.dense import semi_definite
from gridweave.session import staged
from gridweave.sources.graphs import adjacency


def soc(edges: DataFrame, data: DataFrame, kind: str = "geom") -> DataFrame:
    """(src, dst, w, soc): w / average(max_od of both ends); data is (vid, max_od, ...). 0 where the average is 0."""
    a, b = data.select(F.col("vid").alias("src"), F.col("max_od").alias("ma")), data.select(F.col("vid").alias("dst"), F.col("max_od").alias("mb"))
    m = average(kind, F.col("ma"), F.col("mb"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", "w", F.when(m > 0, F.col("w") / m).otherwise(0.0).alias("soc"))


def soc_join(edges: DataFrame, data: DataFrame) -> DataFrame:
    """(src, dst, w, soc): for an orphan src, w / max_od of src; every edge from both ends."""
    return adjacency(edges).join(data.select(F.col("vid").alias("src"), "max_od"), "src").select("src", "dst", "w", F.when(F.col("max_od") > 0, F.col("w") / F.col("max_od")).otherwise(0.0).alias("soc"))


def robust_soc_scalar(edges: DataFrame, data: DataFrame, boost: bool = True) -> DataFrame:
    """(src, dst, soc): E / (Di Dj / (Di + Dj)) with, in E, the half-harmonic means of the edges to common neighbours.

    data is (vid, d, ...). Common neighbours come from joining the two adjacency lists of an edge's ends.
    """
    strength = edges.select("src", "dst", F.col("w").alias("e"))
    if boost:
        adj = adjacency(edges)
        x = adj.select("src", F.col("dst").alias("n"), F.col("w").alias("wi"))
        y = adj.select(F.col("src").alias("dst"), F.col("dst").alias("n"), F.col("w").alias("wj"))
        common = edges.select("src", "dst").join(x, "src").join(y, ["dst", "n"]).groupBy("src", "dst").agg(F.sum(F.col("wi") * F.col("wj") / (F.col("wi") + F.col("wj"))).alias("b"))
        strength = strength.join(common, ["src", "dst"], "left").select("src", "dst", (F.col("e") + F.coalesce("b", F.lit(0.0))).alias("e"))
    a, b = data.select(F.col("vid").alias("src"), F.col("d").alias("da")), data.select(F.col("vid").alias("dst"), F.col("d").alias("db"))
    c = average("hharm", F.col("da"), F.col("db"))
    return strength.join(a, "src").join(b, "dst").select("src", "dst", F.when(c > 0, F.col("e") / c).otherwise(0.0).alias("soc"))


def strong(scored: DataFrame, share: float = 0.25, thresh: float = 0.025) -> DataFrame:
    """(src, dst, w, soc) from both ends: neighbours of src with at least ``share`` of its largest score, and ``thresh``."""
    both = adjacency(scored)
    best = both.groupBy("src").agg(F.max("soc").alias("best"))
    return both.join(best, "src").where((F.col("soc") >= share * F.col("best")) & (F.col("soc") >= thresh)).select("src", "dst", "w", "soc")


def mutual(candidates: DataFrame) -> DataFrame:
    """(a, b): pairs that choose each other among candidates (src, dst, soc) from both ends; a < b.

    A vertex chooses by score, then hash, then ids; the same order for both ends, so the best open pair always matches.
    """
    order = F.struct((-F.col("soc")).alias("s"), tie_hash(F.col("src"), F.col("dst")).alias("h"), F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"))
    choice = candidates.groupBy("src").agg(F.min(order).alias("o")).select("src", F.when(F.col("o.lo") == F.col("src"), F.col("o.hi")).otherwise(F.col("o.lo")).alias("dst"))
    # a pair that both ends chose is there twice
    return choice.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("a", "b")


def handshake(candidates: DataFrame, rounds: int, stage: bool = True) -> DataFrame:
    """(a, b): a matching from up to ``rounds`` rounds of mutual choice; it ends early if a round finds nothing.

    With ``stage`` unset the rounds stay one lazy plan.
    """
    open_, found = candidates.select("src", "dst", "soc"), None
    for _ in range(rounds):
        pairs = mutual(open_)
        if stage:
            pairs = staged(pairs, "pairs")
            if pairs.isEmpty():
                break
        found = pairs if found is None else found.unionByName(pairs)
        # what is open follows from the candidates and all pairs so far, so that only pairs are written
        taken = found.select(F.explode(F.array("a", "b")).alias("v"))
        open_ = candidates.select("src", "dst", "soc").join(taken, F.col("src") == F.col("v"), "left_anti").join(taken, F.col("dst") == F.col("v"), "left_anti")
    return pairs if found is None else found


def pair_map(vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """(f, c): every vertex with its cluster, named by the smaller member; single ones are clusters of their own."""
    members = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("f"), F.col("a").alias("c")), F.struct(F.col("b").alias("f"), F.col("a").alias("c")))).alias("m")).select("m.f", "m.c")
    return vertices.select(F.col("vid").alias("f")).join(members, "f", "left").select("f", F.coalesce("c", "f").alias("c"))


def orphans_join(vmap: DataFrame, edges: DataFrame, data: DataFrame, thresh: float = 0.025) -> DataFrame:
    """(f, c): clusters of one vertex join the neighbour's cluster to which they are tied best, if that isn't of one vertex.

    vmap (f, c) and edges, data on the vertices f. The score is w over the orphan's max_od, summed by cluster.
    """
    sizes = vmap.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    sized = vmap.join(sizes, "c")
    lone, rest = sized.where("n = 1").select("f", "c"), sized.where("n > 1").select("f", "c")
    # weights are summed before the division, so that whole numbers give the same score in any order
    tied = adjacency(edges.select("src", "dst", "w")).join(lone.select(F.col("f").alias("src")), "src").join(rest.select(F.col("f").alias("dst"), "c"), "dst")
    summed = tied.groupBy("src", "c").agg(F.sum("w").alias("w")).join(data.select(F.col("vid").alias("src"), "max_od"), "src")
    by_cluster = summed.select("src", "c", F.when(F.col("max_od") > 0, F.col("w") / F.col("max_od")).otherwise(0.0).alias("soc")).where(F.col("soc") >= thresh)
    best = by_cluster.groupBy("src").agg(F.min(F.struct((-F.col("soc")).alias("s"), tie_hash(F.col("src"), F.col("c")).alias("h"), F.col("c").alias("c"))).alias("o")).select(F.col("src").alias("f"), F.col("o.c").alias("nc"))
    return vmap.join(best, "f", "left").select("f", F.coalesce("nc", "c").alias("c"))


def map_data(data: DataFrame, edges: DataFrame, vmap: DataFrame, diag_stab_boost: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Vertex data (vid, d, max_od, cnt) and edges of the clusters between rounds.

    Diagonals add up, less 2 (1 - boost) times the edges inside; edges between the same clusters add up; max_od is the largest
    of the members' (of the edges that are left it may be smaller).
    """
    m = vmap.select(F.col("f").alias("vid"), "c")
    ends = edges.join(vmap.select(F.col("f").alias("src"), F.col("c").alias("ca")), "src").join(vmap.select(F.col("f").alias("dst"), F.col("c").alias("cb")), "dst").where("ca is not null and cb is not null")
    inside = ends.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("w").alias("inner"))
    sums = data.join(m, "vid").where("c is not null").groupBy("c").agg(F.sum("d").alias("d"), F.max("max_od").alias("max_od"), F.sum("cnt").alias("cnt"))
    out = sums.join(inside, "c", "left").select(F.col("c").alias("vid"), (F.col("d") - 2 * (1 - diag_stab_boost) * F.coalesce("inner", F.lit(0.0))).alias("d"), "max_od", "cnt")
    across = ends.where("ca <> cb").groupBy(F.least("ca", "cb").alias("src"), F.greatest("ca", "cb").alias("dst")).agg(F.sum("w").alias("w"))
    return out, across


def spw(vertices: DataFrame, edges: DataFrame, data: DataFrame, rounds: int = 3, handshakes: int = 4, kind: str = "geom", thresh: float = 0.025, orphans: bool = True,
        fixed: DataFrame | None = None, allowed: DataFrame | None = None, stage: bool = True) -> DataFrame:
    """(f, c): successive pairwise clusters of ``vertices`` (vid): pairs, then pairs of pairs, ..., then orphans join.

    ``fixed`` (f, c) gives clusters by hand: their members take no part. ``allowed`` (src, dst) limits the edges used.
    """
    part = vertices.select("vid")
    if fixed is not None:
        part = part.join(fixed.select(F.col("f").alias("vid")), "vid", "left_anti")
    keep = edges.join(part.select(F.col("vid").alias("src")), "src", "left_semi").join(part.select(F.col("vid").alias("dst")), "dst", "left_semi").select("src", "dst", "w")
    if allowed is not None:
        keep = keep.join(allowed.select("src", "dst"), ["src", "dst"], "left_semi")
    vmap = part.select(F.col("vid").alias("f"), F.col("vid").alias("c"))
    now_data, now_edges = data, keep
    hold = (lambda df, tag: staged(df, tag)) if stage else (lambda df, tag: df)
    for _ in range(rounds):
        pairs = handshake(strong(soc(now_edges, now_data, kind), thresh=thresh), handshakes, stage)
        step = pair_map(now_data.select("vid"), pairs)
        vmap = hold(vmap.join(step.select(F.col("f").alias("c"), F.col("c").alias("nc")), "c").select("f", F.col("nc").alias("c")), "vmap")
        now_data, now_edges = map_data(now_data, now_edges, step)
        now_data, now_edges = hold(now_data, "soc-data"), hold(now_edges, "soc-edges")
    if orphans:
        vmap = orphans_join(vmap, keep, data, thresh)
    return vmap if fixed is None else vmap.unionByName(fixed.select("f", "c"))


def luby(vertices: DataFrame, edges: DataFrame, dist2: bool = False, rounds: int = 30, stage: bool = True) -> DataFrame:
    """(vid): a maximal independent set, by rounds in which vertices first among their open neighbours join.

    The order is by degree, hash and id, so low degrees come first. With ``dist2`` members are at a distance of three or more.
    """
    adj = adjacency(edges).select("src", "dst")
    if dist2:
        two = adj.join(adj.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").where("src <> far").select("src", F.col("far").alias("dst"))
        adj = adj.unionByName(two).distinct()
    degree = adj.groupBy(F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("deg"))
    ranked = vertices.select("vid").join(degree, "vid", "left").select("vid", F.struct(F.coalesce("deg", F.lit(0)).alias("deg"), vertex_hash(F.col("vid")).alias("h"), F.col("vid").alias("id")).alias("p"))
    hold = (lambda df, tag: staged(df, tag)) if stage else (lambda df, tag: df)
    open_, found = hold(ranked, "mis-open"), None
    for _ in range(rounds):
        of = open_.select(F.col("vid").alias("dst"), F.col("p").alias("q"))
        least = adj.join(of, "dst").groupBy(F.col("src").alias("vid")).agg(F.min("q").alias("q"))
        new = hold(open_.join(least, "vid", "left").where(F.col("q").isNull() | (F.col("p") < F.col("q"))).select("vid"), "mis-new")
        found = new if found is None else found.unionByName(new)
        near = adj.join(new.select(F.col("vid").alias("src")), "src").select(F.col("dst").alias("vid")).unionByName(new).distinct()
        open_ = hold(open_.join(near, "vid", "left_anti"), "mis-open")
        if stage and open_.isEmpty():
            break
    else:
        if stage:
            raise RuntimeError(f"the independent set isn't maximal after {rounds} rounds")
    return found


def mis_clusters(vertices: DataFrame, edges: DataFrame, scored: DataFrame, dist2: bool = False, stage: bool = True) -> DataFrame:
    """(f, c): every vertex with a seed: a neighbour that is one, by largest score, else the cluster its best neighbour joined,
    else itself. scored is (src, dst, w, soc) with one row for each edge."""
    seeds = luby(vertices, edges, dist2, stage=stage)
    both = adjacency(scored)
    order = lambda c: F.min(F.struct((-F.col("soc")).alias("s"), tie_hash(F.col("src"), F.col("dst")).alias("h"), F.col(c).alias("c")))
    rest = vertices.select("vid").join(seeds, "vid", "left_anti")
    first = both.join(seeds.select(F.col("vid").alias("dst")), "dst").join(rest.select(F.col("vid").alias("src")), "src").groupBy("src").agg(order("dst").alias("o")).select(F.col("src").alias("f"), F.col("o.c").alias("c"))
    placed = seeds.select(F.col("vid").alias("f"), F.col("vid").alias("c")).unionByName(first)
    if stage:
        placed = staged(placed, "mis-placed")
    left = vertices.select("vid").join(placed.select(F.col("f").alias("vid")), "vid", "left_anti")
    return placed.unionByName(leftovers(left, both, placed))


def leftovers(left: DataFrame, both: DataFrame, placed: DataFrame) -> DataFrame:
    """(f, c): vertices without a cluster join the one with the largest score over size, else stay alone."""
    sizes = placed.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    near = both.join(left.select(F.col("vid").alias("src")), "src").join(placed.select(F.col("f").alias("dst"), "c"), "dst").join(sizes, "c")
    wish = near.groupBy("src").agg(F.min(F.struct((-F.col("soc") / F.col("n")).alias("s"), tie_hash(F.col("src"), F.col("dst")).alias("h"), F.col("c").alias("c"))).alias("o"))
    return left.join(wish, F.col("vid") == F.col("src"), "left").select(F.col("vid").alias("f"), F.coalesce("o.c", "vid").alias("c"))


def plate_test(vertices: DataFrame, edges: DataFrame, rounds: int = 50, stage: bool = True) -> DataFrame:
    """(f, c): connected components of vertices with equal first two coordinates, named by the smallest member.

    Labels spread over edges whose ends share the position, and jump to their label's label, until nothing changes.
    """
    at = vertices.select("vid", F.slice("pos", 1, 2).alias("xy"))
    same = edges.join(at.select(F.col("vid").alias("src"), F.col("xy").alias("a")), "src").join(at.select(F.col("vid").alias("dst"), F.col("xy").alias("b")), "dst").where("a = b")
    adj = adjacency(same.select("src", "dst"))
    now = vertices.select(F.col("vid").alias("f"), F.col("vid").alias("c"))
    if stage:
        adj, now = staged(adj, "plate"), staged(now, "plate")
    for _ in range(rounds):
        least = adj.join(now.select(F.col("f").alias("dst"), F.col("c").alias("nc")), "dst").groupBy(F.col("src").alias("f")).agg(F.min("nc").alias("nc"))
        hop = now.join(least, "f", "left").select("f", "c", F.least("c", F.coalesce("nc", "c")).alias("nc"))
        hop = hop.join(now.select(F.col("f").alias("nc"), F.col("c").alias("jump")), "nc").select("f", "c", F.least("nc", "jump").alias("nc"))
        if not stage:
            now = hop.select("f", F.col("nc").alias("c"))
            continue
        hop = staged(hop, "plate")
        now = hop.select("f", F.col("nc").alias("c"))
        if hop.where("c <> nc").isEmpty():
            break
    else:
        if stage:
            raise RuntimeError(f"the labels did not settle in {rounds} rounds")
    return now


def greedy(edges: DataFrame, part: DataFrame) -> DataFrame:
    """(f, c): sequential greedy pairing inside each part (vid, p), heaviest edges first: the order-dependent reference form.

    A part is one task, so this is for comparisons on bounded parts, not for levels of any size.
    """
    inner = edges.join(part.select(F.col("vid").alias("src"), "p"), "src").join(part.select(F.col("vid").alias("dst"), F.col("p").alias("q")), "dst").where("p = q")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        taken: dict[int, int] = {}
        for r in rows.sort_values(["w", "src", "dst"], ascending=[False, True, True]).itertuples():
            if r.src not in taken and r.dst not in taken:
                taken[r.src] = taken[r.dst] = r.src
        return pd.DataFrame({"f": list(taken), "c": list(taken.values())}, dtype="int64")

    pairs = inner.select("p", "src", "dst", "w").groupBy("p").applyInPandas(run, "f long, c long")
    return part.select(F.col("vid").alias("f")).join(pairs, "f", "left").select("f", F.coalesce("c", "f").alias("c"))


def stable_clusters(vmap: DataFrame, edges: DataFrame, thresh: float = 0.25) -> DataFrame:
    """(c, ok): whether each cluster's inner edges hold it together: A_in - thresh * (D - sum) semi-definite on its members.

    edges is (src, dst, w). A cluster is a bounded group (a few members), so one dense check each.
    """
    ends = edges.join(vmap.select(F.col("f").alias("src"), F.col("c").alias("ca")), "src").join(vmap.select(F.col("f").alias("dst"), F.col("c").alias("cb")), "dst").where("ca = cb")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([rows["src"], rows["dst"]]))
        i, j, w = np.searchsorted(ids, rows["src"]), np.searchsorted(ids, rows["dst"]), rows["w"].to_numpy()
        a = np.zeros((len(ids), len(ids)))
        np.add.at(a, (i, j), -w)
        np.add.at(a, (j, i), -w)
        d = -a.sum(axis=1)
        a[np.arange(len(ids)), np.arange(len(ids))] = d
        mass = np.diag(d) - np.outer(d, d) / max(d.sum(), 1e-300)
        return pd.DataFrame({"c": [int(rows["ca"].iloc[0])], "ok": [semi_definite(a - thresh * mass)]})

    checked = ends.select("ca", "src", "dst", "w").groupBy("ca").applyInPandas(run, "c long, ok boolean")
    return vmap.select("c").distinct().join(checked, "c", "left").select("c", F.coalesce("ok", F.lit(True)).alias("ok"))


