import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridweave.llm import tokens
from gridweave.llm.queries import QUERIES
from tests.llm.test_runs import thue_morse

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_query_against_the_library(spark, sf_dir):
    got = {r.doc_id: r for r in QUERIES["op7_token_ids"](spark, sf_dir).collect()}
    start = 0
    for d in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()):
        want = [*ids(d.text), 2]
        assert (got[d.doc_id].start, got[d.doc_id].n_tokens, got[d.doc_id].ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x2FF), st.sampled_from("aB 'sIİΣé​<|>1ªµ\u0085\x1c\n"))))
def test_encode_equals_the_library(text):
    assert tokens.encode([text, "again", text], PATH) == [ids(text), ids("again"), ids(text)]


def test_words_of_equal_hashes():
    for n in (1024, 2048, 4096):
        for pair in (thue_morse(n), thue_morse(n)[::-1]):
            tokens.encoder_of(PATH).clear()
            assert tokens.encode([*pair, f"so {pair[1]} and {pair[0]}"], PATH) == [ids(pair[0]), ids(pair[1]), ids(f"so {pair[1]} and {pair[0]}")]
            assert tokens.encode(list(pair[::-1]), PATH) == [ids(t) for t in pair[::-1]]


def test_memory_that_is_full():
    encoder = tokens.Encoder(PATH)
    encoder.known = tokens.Segments(np.uint8, 30, 150)
    rng = np.random.default_rng(0)
    for _ in range(60):
        texts = [" ".join(rng.choice(["the", "of", f"word{rng.integers(99)}", "x" * int(rng.integers(1, 40)), "!?"], 6)) for _ in range(4)]
        got, counts = encoder.encode(texts)
        assert got.tolist() == [i for t in texts for i in ids(t)] and counts.tolist() == [len(ids(t)) for t in texts]


def test_edge_cases(spark, tmp_path):
    rows = [(5, "It's <|endoftext|> here", 1), (5, "b", 1), (None, "x", 1), (1, None, 1), (2, "", 1), (7, "word " * 20_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pos int")
    path = f"file://{tmp_path}/t"
    tokens.write(docs, path, PATH)
    files = tokens.read(spark, path)
    got = tokens.digest(files).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 5, 5, 7] and [r.n_tokens for r in got][1:3] == [1, 1] and got[-1].n_tokens == 20_001
    assert sorted(r.ids for r in files.where("doc_id = 5").collect()) == sorted([[*ids("It's <|endoftext|> here"), 2], [*ids("b"), 2]])
    assert tokens.read(spark, path, [7]).count() == 1
    assert tokens.write_and_digest(docs.limit(0), PATH).count() == 0
