"""Token-ID output: ORC files of encoded documents in ascending order of their ids.

Each row is (shard, pos, doc_id, ids); ORC stores the integers run-length encoded in stripes, with a row index on every
``ROW_INDEX`` rows and Bloom filters on doc_id. Readers split files by stripe, and a look-up of ids reads only stripes and row
groups whose minimum, maximum and Bloom filter allow them.

Encoding is that of the tokenizers library on the whole text. It is local to runs of letters and to runs of other characters
for texts of plain Latin-1 characters (``_SAFE``: no apostrophes, no special tokens, no odd white space), so that each worker
encodes a run once and remembers it; all other texts are encoded by the library as they are.

Scale: one shuffle, by ranges of (id, text hash), so that rows that share an id can still be spread; a shard is one range and
one file. Offsets are sums over shards (one small row each) plus running sums inside one shard.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.llm.runs import Buffers, Segments, blocks, ragged, release
from gridweave.session import staged, work_path

END_ID = 2
ROW_INDEX = 1024
STRIPE_BYTES = 16 << 20
#: Runs that a worker remembers, and characters of them; beyond either the memory is cleared. At these figures it takes 50 MB at most,
#: but for a block of text that has more by itself.
CACHE = 600_000
CACHE_CHARS = 6_000_000
#: Documents taken from a batch at once, and characters encoded at once.
SLICE = 512
BLOCK_CHARS = 1_000_000

#: Characters for which runs can be encoded one by one: printable ASCII but the apostrophe, tab, line ends, and what Latin-1 has from
#: C0 on.
_SAFE = bytes([9, 10, 13, *(c for c in range(0x20, 0x7F) if c != 0x27), *range(0xC0, 0x100)])
#: Lower case of Latin-1, and the kind of each character: 0 white space, 1 letter, 2 other.
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A or (0xC0 <= c <= 0xDE and c != 0xD7) else c for c in range(256))
_KIND = np.array([0 if c in (9, 10, 13, 32) else 1 if 0x61 <= c <= 0x7A or (0xDF <= c and c != 0xF7) else 2 for c in range(256)], np.uint8)
_loaded: dict[str, Encoder] = {}


def safe(text: str) -> bytes | None:
    """The text in Latin-1, lower case, if its runs can be encoded one by one."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if data.translate(None, _SAFE) or b"<|" in data else data.translate(_LOWER)


class Encoder:
    """A tokenizer and the ids of the runs that this process has met, by number."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self.known = Segments(np.uint8, CACHE, CACHE_CHARS)
        self.buffers = Buffers(self, first=(np.int64, CACHE + 1), ids=(np.uint32, CACHE_CHARS))
        self.clear()

    def clear(self) -> None:
        self.known.clear()
        self.buffers.clear()
        self.buffers.push(first=np.zeros(1, np.int64))

    def forget(self) -> None:
        """Forget the runs that are used least."""
        kept = self.known.forget()
        each = self.first[kept + 1] - self.first[kept]
        ids = self.ids[ragged(self.first[kept], each)]
        self.buffers.clear()
        self.buffers.push(first=np.concatenate([np.zeros(1, np.int64), np.cumsum(each)]), ids=ids)

    def learn(self, runs: list[str]) -> None:
        """Encode runs. Those of letters are one word each: they go as one text, cut at the ids that end words."""
        word = np.array([_KIND[ord(r[0])] == 1 for r in runs], bool)
        words = [r for r, w in zip(runs, word.tolist(), strict=True) if w]
        others = [r for r, w in zip(runs, word.tolist(), strict=True) if not w]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids if words else [], np.uint32)
        stops = np.flatnonzero(self.ends_word[ids]) + 1
        if len(stops) != len(words):
            each = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            ids, stops = np.array([i for e in each for i in e], np.uint32), np.cumsum([len(e) for e in each])
        rest = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        flat = np.concatenate([ids, np.array([i for e in rest for i in e], np.uint32)])
        counts = np.concatenate([np.diff(stops, prepend=0), np.array([len(e) for e in rest], np.int64)]).astype(np.int64)
        begin = np.cumsum(counts) - counts
        order = np.concatenate([np.flatnonzero(word), np.flatnonzero(~word)])
        place = np.argsort(order)
        self.buffers.push(ids=flat[ragged(begin[place], counts[place])], first=self.first[-1] + np.cumsum(counts[place]))

    def numbers(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: bytes) -> np.ndarray:
        """The number of each run, new ones learned."""
        got = self.known.number(codes, starts, ends)
        if got is None:
            self.forget()
            got = self.known.number(codes, starts, ends)
        if got is None:
            self.clear()
            return self.numbers(codes, starts, ends, data)
        found, new = got
        if len(new):
            self.learn([data[x:y].decode("latin-1") for x, y in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
        return found

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, each with the end id if given, and how many each has."""
        data = [safe(t) for t in texts]
        whole = [t for t, d in zip(texts, data, strict=True) if d is None]
        joined = b"\n".join(d or b"" for d in data) + b"\n"
        codes = np.frombuffer(joined, np.uint8)
        kind = _KIND[codes]
        cuts = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(codes)]])
        keep = kind[cuts[:-1]] != 0
        starts, ends = cuts[:-1][keep], cuts[1:][keep]
        found = self.numbers(codes, starts, ends, joined)
        each = self.first[found + 1] - self.first[found]
        tokens = np.concatenate([[0], np.cumsum(each)])
        stop = np.cumsum([len(d or b"") + 1 for d in data])
        runs = np.searchsorted(starts, stop)  # runs before the end of each text
        counts = np.diff(tokens[runs], prepend=0)
        ids = self.ids[ragged(self.first[found], each)]
        if whole or end is not None:
            parts, lone = [], iter(self.tokenizer.encode_batch_fast(whole, add_special_tokens=False) if whole else [])
            tail = np.zeros(0, np.uint32) if end is None else np.array([end], np.uint32)
            at = 0
            for i, d in enumerate(data):
                own = ids[at : at + counts[i]] if d is not None else np.array(next(lone).ids, np.uint32)
                at += counts[i]
                counts[i] = len(own) + len(tail)
                parts += [own, tail]
            ids = np.concatenate(parts) if parts else ids
        return ids, counts


def encoder_of(path: str) -> Encoder:
    """The encoder of this process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def encode(texts: list[str], path: str) -> list[list[int]]:
    """The ids of each text, without special tokens."""
    ids, counts = encode_flat(texts, path)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []


def encode_flat(texts: list[str], path: str, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``Encoder.encode``, a block of characters at a time."""
    parts = [encoder_of(path).encode(texts[a:z], end) for a, z in blocks(texts, BLOCK_CHARS)]
    if not parts:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode every row of ``docs`` (doc_id, text) and write the ORC files.

    Null texts count as empty and have the end id only. Null ids come first; rows that share an id are ordered by a hash of
    the text. An empty table writes no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                flat, counts = encode_flat([t or "" for t in b.column("text").to_pylist()], tokenizer, end_id)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(pos, pos + b.num_rows)), b.column("doc_id"), ids], ["pos", "doc_id", "ids"])
                pos += b.num_rows
        release()

    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    out = dealt.select("doc_id", "text").mapInArrow(run, "pos long, doc_id long, ids array<int>").select(F.spark_partition_id().alias("shard"), "pos", "doc_id", "ids")
    options = {"orc.stripe.size": str(STRIPE_BYTES), "orc.row.index.stride": str(ROW_INDEX), "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}
    out.write.options(**options).orc(path)


SCHEMA = "shard int, pos long, doc_id long, ids array<int>"


def read(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """The rows of the files; with ``ids``, of these documents only, by metadata pruning."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if ids is None else rows.where(F.col("doc_id").isin(ids))


def digest(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the rows read back; start is the number of ids of all documents before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            offsets, values = np.asarray(ids.offsets), np.asarray(ids.values).astype("<i4", copy=False)
            crc = [zlib.crc32(values[a:z]) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("pos"), b.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["shard", "pos", "doc_id", "n_tokens", "ids_crc32"])

    rows = files.mapInArrow(run, "shard int, pos long, doc_id long, n_tokens long, ids_crc32 long")
    rows = staged(rows, "tokens")
    before = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    shards = rows.groupBy(F.col("shard").alias("s")).agg(F.sum("n_tokens").alias("n")).select("s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(shards, F.col("shard") == F.col("s"))
    return joined.select("doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")


def write_and_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    path = work_path(spark, "token-files")
    write(docs, path, tokenizer)
    return digest(read(spark, path))
