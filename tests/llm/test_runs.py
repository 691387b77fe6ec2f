import numpy as np

from gridweave.llm.runs import Buffers, NumberTable, SegmentHash, Segments, blocks, ragged


def test_table_against_a_dict():
    rng = np.random.default_rng(0)
    table, known = NumberTable(5000), {}
    pool = rng.integers(1, 2**63, 5000).astype(np.uint64)
    pool[:50] = np.uint64(1) + np.arange(50, dtype=np.uint64)  # all want the first place
    for _ in range(8):
        h = np.unique(rng.choice(pool, 900))
        new = h[table.find(h) < 0]
        assert set(new.tolist()) == set(h.tolist()) - set(known)
        table.put(new, np.arange(len(known), len(known) + len(new), dtype=np.int32))
        known |= {int(x): len(known) + i for i, x in enumerate(new)}
        assert table.find(pool).tolist() == [known.get(int(x), -1) for x in pool]
    table.clear()
    assert (table.find(pool) == -1).all() and table.find(pool[:0]).size == 0


def test_equal_segments_have_equal_hashes_anywhere():
    text = "ab abc b abc abé abé ab \U0001f600 bab" * 3
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    pairs = [(i, j) for i in range(len(text)) for j in range(i + 1, min(i + 6, len(text) + 1))]
    h = SegmentHash()(codes, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    by_text, by_hash = {}, {}
    for (i, j), x in zip(pairs, h.tolist(), strict=True):
        assert by_text.setdefault(text[i:j], x) == x and by_hash.setdefault(x, text[i:j]) == text[i:j] and x


def test_ragged_and_buffers():
    assert ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11] and ragged(np.zeros(0, int), np.zeros(0, int)).size == 0

    class Owner:
        pass

    o = Owner()
    b = Buffers(o, x=(np.int64, 4))
    for _ in range(2):
        for k in range(5):
            b.push(x=np.full(k, k))
        assert o.x.tolist() == [1, 2, 2, 3, 3, 3, 4, 4, 4, 4]
        b.clear()
    assert len(o.x) == 0 and len(b.held["x"][0]) == 4


def thue_morse(n):
    """Two words of n letters (a power of 2) whose polynomial hashes modulo 2**64 are equal for n of 1,024 and more."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def cut(words):
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(w) for w in words])
    return codes, ends - [len(w) for w in words], ends


def test_equal_hashes_of_different_segments():
    a, b = thue_morse(2048)
    codes, starts, ends = cut([a, b])
    h = SegmentHash()(codes, starts, ends)
    assert h[0] == h[1]
    s = Segments(np.uint32, 100, 100_000)
    for words, want, new in (([a, "x", b, a], [0, 1, 2, 0], 3), ([b, "y", a, "x", b], [2, 3, 0, 1, 2], 1)):
        got, fresh = s.number(*cut(words))
        first = {words[i]: int(got[i]) for i in fresh}
        assert len(fresh) == new and sorted(first.values()) == list(range(s.count - new, s.count))
        assert [words[i] for i in range(len(words)) for j in range(len(words)) if got[i] == got[j]] == [words[i] for i in range(len(words)) for j in range(len(words)) if words[i] == words[j]]
        assert len(set(got.tolist())) == len(set(want))


def test_segments_forget_those_used_least():
    rng, s, texts = np.random.default_rng(1), Segments(np.uint32, 40, 200), {}
    words = [f"w{i}" for i in range(300)]
    kept_common = 0
    for _ in range(200):
        some = ["the", "of", *rng.choice(words, 10).tolist(), "the", "of"]
        got = s.number(*cut(some))
        if got is None:
            kept = s.forget()
            assert s.count == len(kept) <= 20
            texts = {i: texts[k] for i, k in enumerate(kept.tolist())}
            kept_common += {"the", "of"} <= set(texts.values())
            got = s.number(*cut(some))
        for i in got[1]:
            texts[int(got[0][i])] = some[i]
        assert [texts[i] for i in got[0].tolist()] == some
    assert kept_common > 5


def test_blocks():
    assert list(blocks(["ab", "", "c", "long one", "d"], 3)) == [(0, 3), (3, 4), (4, 5)] and list(blocks([], 3)) == []
