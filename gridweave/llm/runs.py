"""Many short strings at once: hashes of segments of an array of characters, and a hash table in numpy.

Both tokenizer operators cut texts into segments of which most have been met before. Here no segment becomes a Python object
unless it is new: segments are hashed from prefix sums and looked up all together.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class SegmentHash:
    """64-bit hashes of segments: a polynomial in a random value for each character, made the same at every place, finalised
    with the length. Equal hashes don't prove equal segments (see ``Segments``)."""

    def __init__(self) -> None:
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.value = mix(np.arange(1, 0x3001, dtype=np.uint64))

    def _grow(self, n: int) -> None:
        if n > len(self.power):
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def __call__(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(codes))
        top = int(codes.max()) if len(codes) else 0
        values = self.value[codes] if top < len(self.value) else mix(codes.astype(np.uint64) + np.uint64(1))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(values * self.power[: len(codes)], dtype=np.uint64, out=sums[1:])
            h = mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        return np.where(h == 0, np.uint64(1), h)  # 0 marks an empty place of the table


class NumberTable:
    """Open addressing from non-zero 64-bit hashes to numbers; at most half full."""

    def __init__(self, most: int) -> None:
        bits = (2 * most - 1).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.numbers = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it isn't there."""
        place = (h >> self.shift).astype(np.int64)
        key = self.keys[place]
        out = np.where(key == h, self.numbers[place], np.int32(-1))
        open_ = np.flatnonzero((key != h) & (key != 0))
        place = place[open_]
        while len(open_):
            place = (place + 1) & self.mask
            key = self.keys[place]
            hit = key == h[open_]
            out[open_[hit]] = self.numbers[place[hit]]
            go = ~hit & (key != 0)
            open_, place = open_[go], place[go]
        return out

    def put(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct hashes that aren't there."""
        place = (h >> self.shift).astype(np.int64)
        while len(h):
            free = self.keys[place] == 0
            self.keys[place[free]] = h[free]
            mine = self.keys[place] == h  # of several that want one place, one got it
            self.numbers[place[mine]] = numbers[mine]
            h, numbers, place = h[~mine], numbers[~mine], (place[~mine] + 1) & self.mask

    def clear(self) -> None:
        self.keys[:] = 0


class Buffers:
    """Named arrays that grow at the end; views are attributes of the owner.

    Each has room for a fixed number of entries from the start, which takes memory only as it is filled, so that no copying
    growth adds to the peak; more than that (one very long text) is held by a larger array until ``clear``.
    """

    def __init__(self, owner: object, **rooms: tuple[type, int]) -> None:
        self.owner, self.rooms = owner, rooms
        self.clear()

    def clear(self) -> None:
        held = getattr(self, "held", {})
        self.held = {}
        for name, (kind, room) in self.rooms.items():
            buffer = held[name][0] if name in held and len(held[name][0]) == room else np.empty(room, kind)
            self.held[name] = (buffer, 0)
            setattr(self.owner, name, buffer[:0])

    def keep(self, name: str, at: np.ndarray) -> None:
        """Only the entries ``at`` of an array, in that order."""
        some = getattr(self.owner, name)[at]
        self.held[name] = (self.held[name][0], 0)
        self.push(**{name: some})

    def push(self, **arrays: np.ndarray) -> None:
        for name, x in arrays.items():
            buffer, used = self.held[name]
            if used + len(x) > len(buffer):
                grown = np.empty(max(used + len(x), len(buffer) * 5 // 4), buffer.dtype)
                grown[:used] = buffer[:used]
                buffer = grown
            buffer[used : used + len(x)] = x
            self.held[name] = (buffer, used + len(x))
            setattr(self.owner, name, buffer[: used + len(x)])


class Segments:
    """Numbers of the segments met so far: found by hash, and held against the characters that are kept of each.

    Hashes alone would not do: a polynomial modulo 2**64 has equal values for some pairs of texts, whatever its base
    (Thue-Morse words). A segment that has the hash of another one is kept by its bytes.

    Both bounds, of segments and of their characters, are of memory only: beyond them the segments used most stay, half of the
    bound at most, and the others are forgotten.
    """

    def __init__(self, kind: type, most: int, chars: int) -> None:
        self.most, self.chars = most, chars
        self.hash, self.table = SegmentHash(), NumberTable(most)
        self.buffers = Buffers(self, text=(kind, chars), first=(np.int64, most + 1), hashes=(np.uint64, most), uses=(np.int32, most))
        self.clear()

    def clear(self) -> None:
        self.table.clear()
        self.buffers.clear()
        self.buffers.push(first=np.zeros(1, np.int64))
        self.count, self.alike = 0, {}

    def forget(self) -> np.ndarray:
        """Keep those used most; returns their former numbers in the order of the new ones."""
        lone = np.ones(self.count, bool)
        lone[list(self.alike.values())] = False
        lone &= self.uses > 1
        order = np.flatnonzero(lone)
        order = order[np.argsort(-self.uses[order], kind="stable")][: self.most // 2]
        lengths = np.diff(self.first)
        kept = np.sort(order[np.cumsum(lengths[order]) <= self.chars // 2])
        text, hashes, uses, lengths = self.text[ragged(self.first[kept], lengths[kept])], self.hashes[kept], self.uses[kept] // 2, lengths[kept]
        self.clear()
        self.buffers.push(text=text, first=np.cumsum(lengths), hashes=hashes, uses=uses)
        self.count = len(kept)
        self.table.put(hashes, np.arange(self.count, dtype=np.int32))
        return kept

    def full(self, count: int, chars: int) -> bool:
        """Whether so many more would be too many (but nothing is too much for an empty memory)."""
        return self.count > 0 and (self.count + count > self.most or len(self.text) + chars > self.chars)

    def _keep(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        lengths = ends - starts
        self.buffers.push(text=codes[ragged(starts, lengths)], first=len(self.text) + np.cumsum(lengths), hashes=hashes, uses=np.zeros(len(starts), np.int32))
        self.count += len(starts)
        return np.arange(self.count - len(starts), self.count)

    def number(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The number of each segment, and which segments are the first of their kind, in the order of their numbers (that go on from
        ``count``). None if there is no room for them: the owner then forgets, or
        clears, and asks again."""
        h = self.hash(codes, starts, ends)
        found = self.table.find(h).astype(np.int64)
        gaps = np.flatnonzero(found < 0)
        new = np.zeros(0, np.int64)
        if len(gaps):
            keys, at, back = np.unique(h[gaps], return_index=True, return_inverse=True)
            new = gaps[at]
            if self.full(len(new), int((ends - starts)[new].sum())):
                return None
            numbers = self._keep(codes, starts[new], ends[new], keys)
            if self.count <= self.most:  # else one block has more kinds than are remembered, and the next one starts afresh
                self.table.put(keys, numbers.astype(np.int32))
            found[gaps] = numbers[back]
        other = np.flatnonzero(~self._same(found, codes, starts, ends))
        fresh = []
        for i in other.tolist():
            key = codes[starts[i] : ends[i]].tobytes()
            if key not in self.alike:
                self.alike[key] = int(self._keep(codes, starts[i : i + 1], ends[i : i + 1], h[i : i + 1])[0])
                fresh.append(i)
            found[i] = self.alike[key]
        self.uses += np.bincount(found, minlength=self.count).astype(np.int32)
        return found, np.concatenate([new, np.array(fresh, np.int64)])

    def _same(self, numbers: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each segment has the characters kept under its number."""
        lengths, first = ends - starts, self.first[numbers]
        same = self.first[numbers + 1] - first == lengths
        if not len(starts):
            return same
        lengths = np.where(same, lengths, 0)
        unlike = self.text[ragged(first, lengths)] != codes[ragged(starts, lengths)]
        if unlike.any():
            sums = np.concatenate([[0], np.cumsum(unlike)])
            ends = np.cumsum(lengths)
            same &= sums[ends] == sums[ends - lengths]
        return same


def blocks(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i], ..., starts[i] + counts[i] - 1 of all i, one after the other."""
    some = counts > 0
    if not some.all():
        starts, counts = starts[some], counts[some]
    if not len(counts):
        return np.zeros(0, np.int64)
    # steps of one, and a jump to the next start; a single array of the result's size
    ends = np.cumsum(counts)
    out = np.ones(int(ends[-1]), np.int64)
    out[0] = starts[0]
    out[ends[:-1]] = starts[1:] - starts[:-1] - counts[:-1] + 1
    return np.cumsum(out, out=out)


def release() -> None:
    """Give freed memory back to the system, where the C library can: workers stay for later stages, which share their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
