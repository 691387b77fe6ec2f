import re
import zlib
from itertools import product

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from gridweave.llm import pieces
from gridweave.llm.queries import QUERIES
from tests.llm.test_runs import thue_morse

PATH = public_tokenizers.path("piece_bpe_32k.model")


def all_segmentations(model, text):
    """{ids: probability} by brute force."""
    plain = {model.surface[i].decode(): (i, float(model.prior_of[i])) for i in range(259, len(model.surface))}

    def unit(u):
        if not u:
            return [((), 0.0)]
        out = []
        for n in range(1, min(len(u), 16) + 1):
            if u[:n] in plain:
                i, p = plain[u[:n]]
                out += [((i, *ids), p + rest) for ids, rest in unit(u[n:])]
            elif n == 1:
                b = u[0].encode()
                out += [((*(model.byte_ids[x] for x in b), *ids), model.byte_prior * len(b) + rest) for ids, rest in unit(u[n:])]
        return out

    out = {}
    for combination in product(*[unit(u) for u in re.findall("\n|▁*[^▁\n]+|▁+", "▁" + text.replace(" ", "▁"))]):
        out[sum((c[0] for c in combination), ())] = np.exp(sum(c[1] for c in combination))
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def test_query_against_the_library(spark, sf_dir):
    model = pieces.model_of(PATH)
    got = {r.doc_id: r for r in QUERIES["op3_pieces"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = model.library.encode(d.text)
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(np.array(ids, "<i4")), True)
        assert len(set(r.sample_crc32)) == len(r.sample_crc32) and all(0 <= x <= 1 for x in r.sample_inclusion)


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x17F, exclude_characters="▁"), st.sampled_from("abc  \n日😀①")), max_size=40))
def test_round_trip(text):
    model = pieces.model_of(PATH)
    ((ids, good, drawn),) = pieces.encode_all([text], [7], PATH, 3)
    assert good and ids.tolist() == model.library.encode(text) and model.decode(ids.tolist()) == text
    assert len({tuple(x[0].tolist()) for x in drawn}) == len(drawn) and all(model.decode(x[0].tolist()) == text for x in drawn)


def test_samples_follow_the_lattice():
    """Over many keys: the first sample is drawn by probability, the second by probability among the others."""
    model, text, n = pieces.model_of(PATH), "achlich étaux", 4_000
    want = all_segmentations(model, text)
    top = sorted(want, key=want.get)[-3:]
    drawn = [x[2] for x in pieces.encode_all([text] * n, list(range(n)), PATH, 3)]
    assert all(len({tuple(s[0].tolist()) for s in d}) == 3 for d in drawn)
    for d in drawn[:50]:
        for ids, logp, _ in d:
            assert abs(logp - np.log(want[tuple(ids.tolist())])) < 1e-6
    for t in top:
        first = np.mean([tuple(d[0][0].tolist()) == t for d in drawn])
        second = np.mean([tuple(d[1][0].tolist()) == t for d in drawn])
        expected = sum(p * want[t] / (1 - p) for o, p in want.items() if o != t)
        assert abs(first - want[t]) < 0.03 and abs(second - expected) < 0.03
    # weighted by inclusion, samples estimate sums over all segmentations
    mean = np.mean([sum(np.exp(x[1]) / max(x[2], 1e-12) for x in d) for d in drawn])
    assert abs(mean - 1) < 0.05


def test_words_of_equal_hashes():
    model = pieces.model_of(PATH)
    for n in (1024, 2048, 4096):
        a, b = thue_morse(n)
        texts = [a, b, f"so {b} and {a}", b, a]
        for text, (ids, good, drawn) in zip(texts, pieces.encode_all(texts, [1, 2, 3, 4, 5], PATH), strict=True):
            assert good and ids.tolist() == model.library.encode(text) and all(model.decode(x[0].tolist()) == text for x in drawn)


def test_memory_that_is_full():
    """Rows' ids and samples don't depend on what is remembered."""
    full, small = pieces.model_of(PATH), pieces.PieceModel(PATH)
    small.known = pieces.Segments(np.uint32, 25, 120)
    rng = np.random.default_rng(0)
    for turn in range(40):
        texts = [" ".join(rng.choice(["the", "of", f"word{rng.integers(99)}", "x" * int(rng.integers(1, 30)), "é①"], 6)) for _ in range(4)]
        pieces._models["small"] = small
        got, want = (list(pieces.encode_all(texts, [turn, 1, 2, 3], p)) for p in ("small", PATH))
        for (a, ok, x), (b, _, y) in zip(got, want, strict=True):
            assert ok and a.tolist() == b.tolist() and [(i.tolist(), p, q) for i, p, q in x] == [(i.tolist(), p, q) for i, p, q in y]
    assert full is pieces.model_of(PATH)


def test_few_segmentations_and_edge_cases(spark):
    model = pieces.model_of(PATH)
    want = all_segmentations(model, "of")
    ((_, _, drawn),) = pieces.encode_all(["of"], [3], PATH, 50)
    assert {tuple(x[0].tolist()) for x in drawn} == {s for s, p in want.items() if p > 1e-11} and all(x[2] == 1.0 for x in drawn)
    rows = [(1, None, 0), (2, "", 0), (3, " ", 0), (4, "\n\n", 0), (5, "a▁b", 0), (None, "x", 0), (6, "tie tie", 0), (6, "tie tie", 0), (7, "long " * 30_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = pieces.encode(docs, PATH, with_ids=True).collect()
    assert len(got) == 9 and all(r.round_trip for r in got)
    of = {r.doc_id: r for r in got}
    assert of[1].ids == of[2].ids == [] and of[2].sample_inclusion == [1.0]
    assert len({tuple(map(tuple, r.samples)) for r in got if r.doc_id == 6}) == 1
    assert of[7].ids == model.library.encode("long " * 30_000)
    assert pieces.encode(docs.limit(0), PATH).count() == 0
