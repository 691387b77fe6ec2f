"""SentencePiece encoding and decoding, with segmentations sampled without replacement.

``PieceModel`` reads a SentencePiece model file. ``canonical`` ids are the library's own; ``decode`` is their inverse.

Sampling is Gumbel top-k without replacement. A document's lattice is the chain of its units (a run of spaces with the
word after it, or a line end); no piece crosses units, so a segmentation is a choice for each unit and its
probability a product. A piece's prior is Zipf's law in the order of the vocabulary (a parameter: the model file, of the BPE
kind, has ranks only). The perturbed A-star search expands nodes of the tree of choices in the order of their perturbed
maxima: the first path is the maximum of all, its Gumbel value that of the root; every position of a path leaves a sibling
node ("another choice here, after the same choices before"), whose maximum is a Gumbel variable truncated at the path's
value; the next sample is the best open node, completed by a path of its own. The value of the best node left open after k
samples, kappa, gives the inclusion probability 1 - exp(-exp(logp - kappa)) of each sample. All draws are hashes of the row
key, the path, the position and the step, so that a row's samples depend on nothing else.

Speed and memory: a worker builds the lattice of each distinct unit once (forward sums and best paths, all new units of a
block at once) and remembers it, up to ``CACHE`` units; paths of all documents of a block are drawn together in numpy. Texts
are whole; a block is bounded by characters, and a single longer text is a block of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.runs import Buffers, Segments, blocks, ragged, release

SAMPLES = 2
ZIPF_SHIFT = 10.0
#: Characters of one block; and distinct units, and characters of them, that a worker remembers: 130 MB at most, but for a block that
#: has more by itself (about 21 bytes a character, of 3 edges with 17 bytes each).
BLOCK_CHARS = 500_000
CACHE = 230_000
CACHE_CHARS = 1_750_000
#: Rows of a batch that are taken at once.
SLICE = 1024
#: Units whose lattices are built at once.
AT_ONCE = 4_000
#: Units that the library encodes as one text.
JOINED = 200
TINY = 1e-12
#: Steps of one in the fixed-point sums of log probabilities.
FIXED = 1 << 30
SPACE = ord("▁")
_models: dict[str, PieceModel] = {}


def mixed(*parts: Any) -> np.ndarray:
    """Uniform numbers in (0, 1) from a hash of the parts (integers or arrays of them)."""
    with np.errstate(over="ignore"):
        h = np.uint64(0x9E3779B97F4A7C15)
        for p in parts:
            # h is new memory after this line, so that the others may write into it
            h = h ^ np.asarray(p).astype(np.uint64)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
        h >>= np.uint64(11)
    out = h.astype(np.float64)
    out += 0.5
    out /= float(1 << 53)
    return out


class PieceModel:
    """The vocabulary as a trie of characters, and the lattices of the units met so far."""

    def __init__(self, path: str, shift: float = ZIPF_SHIFT) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(size) if self.library.is_byte(i)}
        plain = [i for i in range(size) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))]
        self.surface = [b""] * size
        for i in plain:
            self.surface[i] = names[i].encode()
        for value, i in self.byte_ids.items():
            self.surface[i] = bytes([value])
        self.surface_bytes = np.array([len(x) for x in self.surface], np.int64)
        self.byte_of = np.array([self.byte_ids[v] for v in range(256)], np.int32)
        prior = 1.0 / (np.arange(len(plain)) + shift)
        prior = np.log(prior / prior.sum())
        self.byte_prior = float(prior[-1])
        self.longest = max(len(names[i]) for i in plain)
        # trie: transitions (state, character) -> state in a hash table; the accepted id of each state
        states: dict[tuple[int, int], int] = {}
        ids = [-1]
        for i in plain:
            at = 0
            for c in names[i]:
                key = (at, ord(c))
                if key not in states:
                    states[key] = len(ids)
                    ids.append(-1)
                at = states[key]
            ids[at] = i
        self._place({s << 21 | c: to for (s, c), to in states.items()})
        self.known = Segments(np.uint32, CACHE, CACHE_CHARS)
        self.ids = np.array(ids, np.int32)
        self.prior_of = np.full(size, self.byte_prior)
        self.prior_of[plain] = prior
        chars, edges = CACHE_CHARS, 4 * CACHE_CHARS
        self.buffers = Buffers(
            self,
            first=(np.int64, CACHE + 1),  # the first character of each unit; one more at the end
            # by character, as the end of a prefix of its unit: its edges, the log probability that the prefix is segmented in
            # the best way, and the best last edge
            edge_first=(np.int32, chars + 1), chain=(np.float64, chars), best_length=(np.int8, chars), best_share=(np.float32, chars),
            # edges by their last character, the best first: characters, id (below 0: several bytes of a character), cumulated share
            edge_length=(np.int8, edges), edge_id=(np.int32, edges), edge_cum=(np.float32, edges), edge_share=(np.float64, edges),
            canonical_first=(np.int64, CACHE + 1), canonical_ids=(np.int32, chars), intact=(np.bool_, CACHE),
        )
        self.clear()

    def _place(self, transitions: dict[int, int]) -> None:
        """A cuckoo table: each key is at one of two places, so that numpy looks up many at once with two reads each."""
        bits = max(8, (4 * len(transitions)).bit_length())
        size, mask = 1 << bits, (1 << 64) - 1
        self.shift_bits = np.uint64(64 - bits)
        for seed in range(100):
            multipliers = [(0x9E3779B97F4A7C15 + 2 * seed) & mask, (0xC2B2AE3D27D4EB4F + 2 * seed) & mask]
            at = lambda key, m: ((((key * m) & mask) ^ (((key * m) & mask) >> 29)) * multipliers[0] & mask) >> (64 - bits)
            slots: dict[int, int] = {}
            for key in transitions:
                turn, last = 0, -1
                while turn < 200:
                    for m in multipliers:
                        if at(key, m) not in slots:
                            slots[at(key, m)] = key
                            turn = 1000
                            break
                    else:
                        # not back to where it has just been pushed out
                        place = at(key, multipliers[at(key, multipliers[0]) == last])
                        slots[place], key, last = key, slots[place], place
                        turn += 1
                if turn < 1000:
                    break
            else:
                break
        else:
            raise RuntimeError("no table of transitions was found")
        self.multipliers = [np.uint64(m) for m in multipliers]
        self.keys, self.next = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        for place, key in slots.items():
            self.keys[place], self.next[place] = key, transitions[key]

    def step(self, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which transitions exist, and the states that those lead to."""
        with np.errstate(over="ignore"):
            mixed_keys = [want.view(np.uint64) * m for m in self.multipliers]
            places = [(((x ^ (x >> np.uint64(29))) * self.multipliers[0]) >> self.shift_bits).astype(np.int64) for x in mixed_keys]
        here = self.keys[places[0]] == want
        place = np.where(here, places[0], places[1])
        known = here | (self.keys[place] == want)
        return known, self.next[place[known]]

    def clear(self) -> None:
        """Forget all units."""
        self.known.clear()
        self.buffers.clear()
        self.buffers.push(first=np.zeros(1, np.int64), edge_first=np.zeros(1, np.int32), canonical_first=np.zeros(1, np.int64))

    def forget(self) -> None:
        """Forget the units that are used least."""
        kept = self.known.forget()
        lengths = self.first[kept + 1] - self.first[kept]
        chars = ragged(self.first[kept], lengths)
        edge_counts = (self.edge_first[1:] - self.edge_first[:-1])[chars]
        edges = ragged(self.edge_first[:-1][chars].astype(np.int64), edge_counts.astype(np.int64))
        each = self.canonical_first[kept + 1] - self.canonical_first[kept]
        ids = ragged(self.canonical_first[kept], each)
        # one array after the other, so that no second copy of all is held
        for names, at in ((("edge_length", "edge_id", "edge_cum", "edge_share"), edges), (("chain", "best_length", "best_share"), chars), (("canonical_ids",), ids), (("intact",), kept)):
            for name in names:
                self.buffers.keep(name, at)
        for name, x in (("first", lengths), ("edge_first", edge_counts), ("canonical_first", each)):
            self.buffers.keep(name, np.zeros(0, np.int64))
            self.buffers.push(**{name: np.concatenate([np.zeros(1, np.int64), np.cumsum(x)])})

    def add(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Build the lattices of units, given as segments of ``codes``, that aren't known."""
        for at in range(0, len(starts), AT_ONCE):
            lengths = (ends - starts)[at : at + AT_ONCE]
            self._add(codes[ragged(starts[at : at + AT_ONCE], lengths)].astype(np.int64), lengths)

    def _add(self, chars: np.ndarray, lengths: np.ndarray) -> None:
        first = np.concatenate([[0], np.cumsum(lengths)])
        n, wide = len(chars), min(self.longest, int(lengths.max()))
        # by last character and length: 0, the id + 1, or below 0 a character that is spelled in several bytes
        found = np.zeros((n, wide), np.int32)
        start = np.arange(n)
        stop = np.repeat(first[1:], lengths)
        state = np.zeros(n, np.int64)
        for k in range(wide):
            fits = start + k < stop[start]
            start, state = start[fits], state[fits]
            known, state = self.step(state << 21 | chars[start + k])
            start = start[known]
            ok = self.ids[state] >= 0
            found[start[ok] + k, k] = self.ids[state[ok]] + 1
        # characters that are no piece are spelled in bytes
        spelled = np.flatnonzero(found[:, 0] == 0)
        if len(spelled):
            c = chars[spelled]
            found[spelled, 0] = np.where(c < 0x80, self.byte_of[c & 0x7F] + 1, -1 - c)
        spots = np.flatnonzero(found.ravel())
        edge_id = found.ravel()[spots]
        end, k = np.divmod(spots, wide)
        length = (k + 1).astype(np.int8)
        score = self.prior_of[np.maximum(edge_id - 1, 0)]
        if len(spelled):
            spread = -1 - edge_id
            score = np.where(edge_id > 0, score, self.byte_prior * (1 + (spread > 0x7F) + (spread > 0x7FF) + (spread > 0xFFFF)))
        edge_id -= edge_id > 0
        counts = np.bincount(end, minlength=n)
        edge_first = np.concatenate([[0], np.cumsum(counts)])
        # forward sums and best paths, one position of all units at a time
        total, best, best_length = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n, np.int8)
        longer = np.arange(len(lengths))
        for j in range(int(lengths.max())):
            longer = longer[lengths[longer] > j]
            at = first[longer] + j
            each = counts[at]
            e = ragged(edge_first[at], each)
            back = np.repeat(at, each) - length[e]
            # an edge from the unit's start goes back to a place whose sums stay 0
            back = np.where(length[e] <= j, back, n)
            cut = np.cumsum(each) - each
            own = score[e]
            row = np.repeat(np.arange(len(at)), each)
            sums = total[back]
            sums += own
            top = np.maximum.reduceat(sums, cut)
            sums -= top[row]
            total[at] = top + np.log(np.add.reduceat(np.exp(sums, out=sums), cut))
            sums = best[back]
            sums += own
            top = np.maximum.reduceat(sums, cut)
            best[at] = top
            # of equal ones the longest edge, the last in order
            hit = np.flatnonzero(sums == top[row])
            best_length[at[row[hit]]] = length[e[hit]]
        total, best = total[:n], best[:n]
        head = np.repeat(first[:-1], lengths)[end]
        back = end - length
        edge_share = np.exp(score + np.where(back >= head, total[np.maximum(back, 0)], 0.0) - total[end])
        is_best = length == best_length[end]
        # the best edge goes first among those with its last character
        slot = np.arange(len(end))
        begin = edge_first[:-1][end]
        chosen = np.zeros(n, np.int64)
        chosen[end[is_best]] = slot[is_best]
        order = np.where(slot == begin, chosen[end], np.where(slot <= chosen[end], slot - 1, slot))
        edge_share, edge_id, length = edge_share[order], edge_id[order].astype(np.int32), length[order]
        run = np.cumsum(edge_share)
        run -= np.repeat(run[edge_first[:-1]] - edge_share[edge_first[:-1]], counts)
        run /= np.repeat(run[edge_first[1:] - 1], counts)
        old, shift = len(self.chain), len(self.edge_cum)
        self.buffers.push(
            first=first[1:] + old, edge_first=edge_first[1:] + shift, chain=np.minimum(best - total, 0.0), best_length=best_length,
            best_share=edge_share[edge_first[:-1]], edge_length=length, edge_id=edge_id,
            edge_cum=run, edge_share=np.log(np.maximum(edge_share, 1e-300)),
        )
        canonical, each, ok = self.canonical_units(chars, first)
        self.buffers.push(canonical_first=self.canonical_first[-1] + np.cumsum(each), canonical_ids=canonical, intact=ok)

    def canonical_units(self, chars: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The library's ids of units, one after the other, how many each unit has, and whether they spell it.

        Many go as one text, a line end before each: no piece crosses it, and the lengths of the pieces tell the units apart.
        """
        n = len(first) - 1
        lined = np.full(len(chars) + n, 10, np.uint32)
        lined[np.arange(len(chars)) + np.repeat(np.arange(1, n + 1), np.diff(first))] = chars
        text = lined.tobytes().decode("utf-32-le", "surrogatepass")
        cuts = [int(first[k]) + k for k in range(0, n, JOINED)] + [len(text)]
        # without the space that the library puts first
        coded = self.library.encode([text[x:y].replace("▁", " ") for x, y in zip(cuts[:-1], cuts[1:], strict=True)], num_threads=1)
        ids = np.concatenate([np.array(x[1:], np.int32) for x in coded])
        spelled = b"".join(map(self.surface.__getitem__, ids.tolist()))
        wide = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
        lengths = np.add.reduceat(wide, first[:-1]) + 1
        stops = np.cumsum(lengths)
        last = np.searchsorted(np.cumsum(self.surface_bytes[ids]), stops) + 1
        begin = np.concatenate([[0], last[:-1]]) + 1
        whole = text.encode("utf-8", "surrogatepass")
        ok = np.ones(n, bool) if spelled == whole else np.array([spelled[x:y] == whole[x:y] for x, y in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)], bool)
        return ids[ragged(begin, last - begin)], last - begin, ok

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts, one after the other, by number, and how many each text has.

        A text without a character has no unit; else a space goes before it, as the library does.
        """
        joined = "".join("▁" + t for t in texts if t).replace(" ", "▁")
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        stops = np.cumsum(sizes)
        space, line = codes == SPACE, codes == 10
        begins = line.copy()
        begins[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        begins[(stops - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(codes))
        counts = np.diff(np.searchsorted(starts, stops), prepend=0)
        return self.units(codes, starts, ends), counts

    def units(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        got = self.known.number(codes, starts, ends)
        if got is None:
            self.forget()
            got = self.known.number(codes, starts, ends)
        if got is None:
            self.clear()
            return self.units(codes, starts, ends)
        self.add(codes, starts[got[1]], ends[got[1]])
        return got[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and bytes joined, spaces restored, and the first one dropped.

        The exact inverse of encoding for texts without the character U+2581, which stands for a space.
        """
        text = b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace").replace("▁", " ")
        return text[1:] if text.startswith(" ") else text

    def spell(self, edge_ids: np.ndarray) -> np.ndarray:
        """Ids of edges, with those of bytes in the place of spelled characters."""
        if not len(edge_ids) or edge_ids.min() >= 0:
            return edge_ids
        return np.array([j for i in edge_ids.tolist() for j in ([i] if i >= 0 else [self.byte_ids[b] for b in chr(-1 - i).encode()])], np.int32)

    def draw(self, unit: np.ndarray, off_best: np.ndarray, key: np.ndarray, place: np.ndarray, path: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A segmentation for each given unit, from all, or where ``off_best`` is set from all but the best.

        Returns its log probability among all, and (row, edge) of its edges, the last edge of a unit first.
        """
        logp = np.zeros(len(unit))
        row = np.arange(len(unit))
        at, begin = self.first[unit + 1] - 1, self.first[unit]
        bound = off_best.copy()  # still on the best path, and must leave it
        rows, edges = [], []
        step = 0
        while len(row):
            u = mixed(key[row], place[row], path, turn, step)
            share = self.best_share[at]
            target = u
            if bound.any():
                length = self.best_length[at]
                back = at - length
                rest = np.where(back >= begin, -np.expm1(self.chain[np.maximum(back, 0)]), 0.0)
                whole = -np.expm1(self.chain[at])
                stay = np.where(bound, np.clip(share * rest / np.maximum(whole, 1e-300), 0, 1), 0.0)
                leaves = bound & (u >= stay)
                v = np.where(leaves, (u - stay) / np.maximum(1 - stay, 1e-300), u)
                target = np.where(bound, np.where(leaves, share + v * (1 - share), share * 0.5), u)
            low, high = self.edge_first[at], self.edge_first[at + 1] - 1
            if bound.any():
                low = np.where(leaves, np.minimum(low + 1, high), low)
                bound = bound & ~leaves
            # the first edge whose cumulated share reaches the target: a few steps, as a character ends few pieces
            edge, want = low, target
            ahead = np.flatnonzero((edge < high) & (self.edge_cum[edge] < want))
            while len(ahead):
                edge[ahead] += 1
                ahead = ahead[(edge[ahead] < high[ahead]) & (self.edge_cum[edge[ahead]] < want[ahead])]
            rows.append(row)
            edges.append(edge)
            logp[row] += self.edge_share[edge]
            at = at - self.edge_length[edge]
            more = at >= begin
            row, at, begin, bound = row[more], at[more], begin[more], bound[more]
            step += 1
        return logp, np.concatenate(rows) if rows else row, np.concatenate(edges) if edges else row


    def draw_excluding(self, unit: int, taken: list[list[int]], key: np.uint64, place: int, path: int) -> tuple[float, list[int]]:
        """A segmentation that is none of those taken (edges, the last of the unit first), and its log probability."""
        at, begin = int(self.first[unit + 1]) - 1, int(self.first[unit])
        live = [(x, float(np.exp(self.edge_share[x].sum()))) for x in taken]
        logp, edges = 0.0, []
        while at >= begin:
            low, high = int(self.edge_first[at]), int(self.edge_first[at + 1])
            share = np.exp(self.edge_share[low:high])
            free = share.copy()
            for x, mass in live:
                free[x[len(edges)] - low] -= mass
            free = np.where(free > TINY * share, free, 0.0)
            run = np.cumsum(free)
            u = float(mixed(key, place, path, 4, len(edges))) * run[-1]
            k = min(int(np.searchsorted(run, u, side="right")), high - low - 1)
            live = [(x, mass / share[k]) for x, mass in live if x[len(edges)] == low + k]
            edges.append(low + k)
            logp += float(self.edge_share[low + k])
            at -= int(self.edge_length[low + k])
        return logp, edges

    def best_edges(self, unit: int) -> list[int]:
        at, begin, out = int(self.first[unit + 1]) - 1, int(self.first[unit]), []
        while at >= begin:
            out.append(int(self.edge_first[at]))
            at -= int(self.best_length[at])
        return out


def _signature(rows: np.ndarray, edges: np.ndarray, count: int) -> np.ndarray:
    """A number for each row's set of edges (edges are those of one lattice, so their order adds nothing)."""
    with np.errstate(over="ignore"):
        h = (edges.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    out = np.zeros(count, np.uint64)
    np.add.at(out, rows, h)
    return out


class Paths:
    """Paths of all documents of a block: by unit, whether it is segmented in the best way, else its own edges."""

    def __init__(self, model: PieceModel, unit: np.ndarray) -> None:
        self.model, self.unit = model, unit
        self.logp = np.zeros(len(unit))
        self.off = np.zeros(len(unit), bool)
        self.signature = np.zeros(len(unit), np.uint64)
        self.rows, self.edges = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def set(self, where: np.ndarray, off: np.ndarray, logp: np.ndarray, rows: np.ndarray, edges: np.ndarray) -> None:
        """Replace the units ``where``; rows index into ``where``."""
        if len(self.rows):
            gone = np.zeros(len(self.unit), bool)
            gone[where] = True
            keep = ~gone[self.rows]
            self.rows, self.edges = self.rows[keep], self.edges[keep]
        self.off[where], self.logp[where] = off, logp
        self.signature[where] = np.where(off, _signature(rows, edges, len(where)), np.uint64(0))
        self.rows, self.edges = np.concatenate([self.rows, where[rows]]), np.concatenate([self.edges, edges])

    def fixed(self, a: int = 0, z: int | None = None) -> np.ndarray:
        """Log probabilities of the units a to z as integers: their sums don't depend on what else is in the block."""
        return np.rint(self.logp[a:z] * FIXED).astype(np.int64)

    def edges_at(self, i: int) -> list[int]:
        """The edges of one unit, the last first."""
        return self.edges[self.rows == i].tolist() if self.off[i] else self.model.best_edges(int(self.unit[i]))

    def copy(self) -> Paths:
        out = Paths(self.model, self.unit)
        out.logp, out.off, out.signature = self.logp.copy(), self.off.copy(), self.signature.copy()
        out.rows, out.edges = self.rows, self.edges
        return out

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """The edges' ids of all units in order, and how many each unit has (a spelled character counts once)."""
        m, n = self.model, len(self.unit)
        best = ~self.off
        # numbers of units are dense, so a table takes the place of sorting
        mine = self.unit[best]
        met = np.zeros(int(mine.max()) + 1 if len(mine) else 0, bool)
        met[mine] = True
        kinds = np.flatnonzero(met)
        index = np.zeros(len(met), np.int64)
        index[kinds] = np.arange(len(kinds))
        which = index[mine]
        # the best paths of the distinct units
        at, begin, row = m.first[kinds + 1] - 1, m.first[kinds], np.arange(len(kinds))
        rows, edges = [], []
        while len(row):
            rows.append(row)
            edges.append(m.edge_first[at])
            at = at - m.best_length[at]
            more = at >= begin
            row, at, begin = row[more], at[more], begin[more]
        counts = np.zeros(n, np.int64)
        counts += np.bincount(self.rows, minlength=n)
        if rows:
            r, e = np.concatenate(rows), np.concatenate(edges)
            each = np.bincount(r, minlength=len(kinds))
            order = np.argsort(r, kind="stable")  # steps of a unit one after the other, the last edge first
            flat = m.edge_id[e[order]]
            first = np.concatenate([[0], np.cumsum(each)[:-1]])
            counts[best] = each[which]
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]) if n else 0, np.int32)
        if rows:
            c = each[which]
            source = ragged(first[which], c)
            back = ragged(np.zeros(len(c), np.int64), c)
            out[np.repeat(ends[best] - 1, c) - back] = flat[source]
        if len(self.rows):
            order = np.argsort(self.rows, kind="stable")
            r, e = self.rows[order], self.edges[order]
            c = np.bincount(r, minlength=n)
            back = ragged(np.zeros(n, np.int64), c)
            out[ends[r] - 1 - back] = m.edge_id[e]
        return out, counts


def sample(model: PieceModel, unit: np.ndarray, counts: np.ndarray, keys: np.ndarray, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each document up to k distinct segmentations (ids, log probability, inclusion probability), best perturbed first.

    unit, counts: as from ``numbers``; keys: a number for each document. A document with fewer segmentations has them all,
    each included with probability 1 (choices of a unit that together have less than ``TINY`` of its probability are not told
    apart from none).
    """
    n, docs = len(unit), len(counts)
    out: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in range(docs)]
    if not n:
        return [[(np.zeros(0, np.int32), 0.0, 1.0)] for _ in range(docs)]
    doc = np.repeat(np.arange(docs), counts)
    ends = np.cumsum(counts)
    starts = ends - counts
    place = np.arange(n) - starts[doc]
    key = keys.astype(np.int64).view(np.uint64)
    filled = np.flatnonzero(counts > 0)
    p_best = np.exp(model.chain[model.first[unit + 1] - 1])

    def fill(paths: Paths, where: np.ndarray, path: int) -> None:
        """Draw the units ``where`` freely."""
        off = mixed(key[doc[where]], place[where], path, 0, 1 << 20) >= p_best[where]
        got = model.draw(unit[where[off]], np.ones(int(off.sum()), bool), key[doc[where[off]]], place[where[off]], path, 0)
        logp = np.log(p_best[where])
        logp[off] = got[0]
        paths.set(where, off, logp, np.flatnonzero(off)[got[1]], got[2])

    def gumbels(paths: Paths, value: np.ndarray, after: np.ndarray, path: int) -> np.ndarray:
        """Perturbed maxima of the siblings at each position of the paths; none up to position ``after`` of a document."""
        fixed = paths.fixed()
        before = np.cumsum(fixed) - fixed
        before = (before - before[np.minimum(starts, n - 1)][doc]) / FIXED
        p = np.exp(paths.logp)
        left = 1 - p
        phi = np.where((left > TINY) & (place > after[doc]), before + np.log(np.maximum(left, TINY)), -np.inf)
        e = -np.log(mixed(key[doc], place, path, 1, 1 << 21))
        with np.errstate(over="ignore", invalid="ignore"):
            return np.where(np.isfinite(phi), phi - np.log(e + np.exp(np.minimum(phi - value[doc], 700))), -np.inf)

    value = -np.log(-np.log(mixed(key, 0, 0, 2, 1 << 22)))
    paths = [Paths(model, unit)]
    fill(paths[0], np.arange(n), 0)
    opened = [gumbels(paths[0], value, np.full(docs, -1), 0)]
    # by node (path, position): the later paths that left it
    taken: dict[tuple[int, int], list[int]] = {}
    alive = [np.isin(np.arange(docs), filled)]
    kappa = np.full(docs, -np.inf)
    for path in range(1, k + 1):
        peak = np.stack([np.maximum.reduceat(np.append(g, -np.inf), np.minimum(starts, n)) for g in opened])
        peak[:, counts == 0] = -np.inf
        of = peak.argmax(axis=0)
        kappa = peak[of, np.arange(docs)]
        if path == k:
            break
        go = np.flatnonzero(np.isfinite(kappa))
        alive.append(np.isin(np.arange(docs), go))
        new = paths[0].copy()
        spot = np.zeros(docs, np.int64)
        for p in range(len(paths)):
            mine = go[of[go] == p]
            if not len(mine):
                continue
            inside = np.isin(doc, mine)
            is_peak = inside & (opened[p] == kappa[doc])
            at = np.flatnonzero(is_peak)
            at = at[np.unique(doc[at], return_index=True)[1]]
            spot[doc[at]] = at
            if p:
                _take(new, paths[p], np.flatnonzero(inside))
        at = spot[go]
        # the choice at the spot: another one than those that paths through this node have made
        used = [[int(of[d]), *taken.get((int(of[d]), a), [])] for d, a in zip(go.tolist(), at.tolist(), strict=True)]
        for j in [j for j, u in enumerate(used) if len(u) > 1]:
            a = int(at[j])
            logp, edges = model.draw_excluding(int(unit[a]), [paths[p].edges_at(a) for p in used[j]], key[doc[a]], int(place[a]), path)
            off = edges != model.best_edges(int(unit[a]))
            new.set(at[j : j + 1], np.array([off]), np.array([logp]), np.zeros(len(edges) * off, np.int64), np.array(edges, np.int64)[: len(edges) * off])
        todo, turn = np.array([j for j, u in enumerate(used) if len(u) == 1], np.int64), 1
        while len(todo):  # a choice other than the best one has half of the probability at most, so few turns are taken
            where = at[todo]
            before = np.array([paths[used[j][0]].off[at[j]] for j in todo], bool), np.array([paths[used[j][0]].signature[at[j]] for j in todo], np.uint64)
            got = model.draw(unit[where], ~before[0], key[doc[where]], place[where], path, turn)
            sign = _signature(got[1], got[2], len(where))
            # a free draw may be the best segmentation, which paths keep without edges
            off = sign != _best_signature(model, unit[where])
            new_one = (off != before[0]) | (off & (sign != before[1]))
            rows_ok = new_one[got[1]] & off[got[1]]
            index = np.cumsum(new_one) - 1
            new.set(where[new_one], off[new_one], got[0][new_one], index[got[1][rows_ok]], got[2][rows_ok])
            todo, turn = todo[~new_one], turn + 1
        after = np.full(docs, np.iinfo(np.int64).max)
        after[go] = place[at]
        fill(new, np.flatnonzero(place > after[doc]), path)
        # the node at the spot stays open for what is neither taken nor the new choice
        worth = kappa
        opened.append(gumbels(new, worth, after, path))
        for d, a, u in zip(go.tolist(), at.tolist(), used, strict=True):
            mass = 1 - sum(float(np.exp(paths[p].logp[a])) for p in u) - float(np.exp(new.logp[a]))
            phi = int(paths[of[d]].fixed(int(starts[d]), a).sum()) / FIXED + np.log(mass) if mass > TINY else -np.inf
            e = -np.log(float(mixed(key[d], a - starts[d], path, 3, 1 << 23)))
            opened[of[d]][a] = phi - np.log(e + np.exp(min(phi - kappa[d], 700.0))) if np.isfinite(phi) else -np.inf
            taken.setdefault((int(of[d]), a), []).append(path)
        paths.append(new)
    for p, live in zip(paths, alive, strict=True):
        ids, per_unit = p.ids()
        tokens = np.concatenate([[0], np.cumsum(per_unit)])
        sums = np.concatenate([[0], np.cumsum(p.fixed())])
        for d in np.flatnonzero(live).tolist():
            logp = int(sums[ends[d]] - sums[starts[d]]) / FIXED
            included = 1.0 if not np.isfinite(kappa[d]) else float(-np.expm1(-np.exp(min(logp - kappa[d], 700.0))))
            out[d].append((model.spell(ids[tokens[starts[d]] : tokens[ends[d]]]), logp, included))
    for d in np.flatnonzero(counts == 0).tolist():
        out[d].append((np.zeros(0, np.int32), 0.0, 1.0))
    return out


def _take(new: Paths, other: Paths, where: np.ndarray) -> None:
    """Copy the units ``where`` from another set of paths."""
    index = np.full(len(other.unit), -1)
    index[where] = np.arange(len(where))
    mine = index[other.rows] >= 0
    signature = other.signature[where]
    new.set(where, other.off[where], other.logp[where], index[other.rows[mine]], other.edges[mine])
    new.signature[where] = signature


def _best_signature(model: PieceModel, unit: np.ndarray) -> np.ndarray:
    at, begin, row = model.first[unit + 1] - 1, model.first[unit], np.arange(len(unit))
    rows, edges = [], []
    while len(row):
        rows.append(row)
        edges.append(model.edge_first[at])
        at = at - model.best_length[at]
        more = at >= begin
        row, at, begin = row[more], at[more], begin[more]
    return _signature(np.concatenate(rows), np.concatenate(edges), len(unit)) if rows else np.zeros(len(unit), np.uint64)


def model_of(path: str) -> PieceModel:
    """The model of this process."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_all(texts: list[str | None], keys: list[int | None], path: str, k: int = SAMPLES) -> Iterator[tuple[np.ndarray, bool, list[tuple[np.ndarray, float, float]]]]:
    """For each text its canonical ids, whether they decode to the text, and its samples. Null texts and keys count as empty and 0."""
    model = model_of(path)
    texts = [t or "" for t in texts]
    number = np.array([x or 0 for x in keys], np.int64)
    for a, z in blocks(texts, BLOCK_CHARS):
        unit, counts = model.numbers(texts[a:z])
        each = model.canonical_first[unit + 1] - model.canonical_first[unit]
        ids = model.canonical_ids[ragged(model.canonical_first[unit], each)]
        ends = np.cumsum(counts)
        tokens = np.concatenate([[0], np.cumsum(each)])
        good = np.concatenate([[0], np.cumsum(~model.intact[unit])])
        drawn = sample(model, unit, counts, number[a:z], k)
        for d in range(z - a):
            lo, hi = int(ends[d] - counts[d]), int(ends[d])
            yield ids[tokens[lo] : tokens[hi]], bool(good[hi] == good[lo]), drawn[d]


SCHEMA = "n_tokens long, ids_crc32 long, round_trip boolean, sample_tokens array<long>, sample_crc32 array<long>, sample_logp array<double>, sample_inclusion array<double>"


def encode(docs: DataFrame, path: str, k: int = SAMPLES, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(doc_id, SCHEMA) for each row of ``docs`` (doc_id, text); ``with_ids`` adds ids array<int> and samples array<array<int>>.

    crc32 is that of ids as little-endian unsigned 32-bit integers. Null texts count as empty: no ids and one, empty, sample.
    Rows that share an id and a text get the same samples; a null id counts as 0.
    """
    fields = f"doc_id long, {SCHEMA}" + (", ids array<int>, samples array<array<int>>" if with_ids else "")
    names = [f.split()[0] for f in fields.split(", ")]

    def crc(x: np.ndarray) -> int:
        return zlib.crc32(np.ascontiguousarray(x, "<i4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, SLICE) for x in batches for at in range(0, x.num_rows, SLICE)):
            ids = b.column("doc_id").to_pylist()
            cols: list[list[Any]] = [ids, *[[] for _ in names[1:]]]
            for own, good, drawn in encode_all(b.column("text").to_pylist(), ids, path, k):
                row = [len(own), crc(own), good, [len(x[0]) for x in drawn], [crc(x[0]) for x in drawn], [x[1] for x in drawn], [x[2] for x in drawn]]
                for c, x in zip(cols[1:], row + ([own.tolist(), [x[0].tolist() for x in drawn]] if with_ids else []), strict=True):
                    c.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names)
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), "text").mapInArrow(run, fields)
