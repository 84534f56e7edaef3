"""Token ids of whole texts, written as Huffman-coded blocks and read back.

A corpus is a folder with ``codebook`` (one row: the code length of every id) and ``blocks``
(rows: part, block, first_id, n_docs, n_tokens, payload; see ``huffman``). Parts are ascending
ranges of document ids, blocks ascend within a part, documents within a block. Both are Parquet
tables, so that any store Spark can reach holds them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.cluster import NO_ID, bucket_of, cut, key_bounds, partitions
from strandwise.llm.huffman import Code, bit_limit, code_lengths, read_block, write_block
from strandwise.llm.text import LOWER, lean, mix, parts, slices, span_hashes, texts

KNOWN = 3_000_000
BLOCK = 1 << 20
_STATE: dict[str, tuple] = {}

#: 0 separates; 1 may stand in a word; 2 is other ASCII; 3 leaves the cut to the library.
_CLASS = np.full(256, 3, dtype=np.int8)
_CLASS[33:127] = 2
_CLASS[[b for b in range(128) if chr(b).isalpha()] + [ord("'"), 0xC3]] = 1
_CLASS[ord("<")] = 3
_CLASS[[0x20, 0x09, 0x0A, 0x0D]] = 0


def spans_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches whose tokens don't depend on what stands beside them: words
    (ASCII and Latin-1 letters, apostrophes) and runs of other ASCII. A stretch between separators
    that holds anything else (other alphabets, marks, controls, a special token's bracket) is one."""
    kind = _CLASS[buf]
    after = np.flatnonzero(buf[:-1] == 0xC3) + 1
    kind[after] = np.where((buf[after] == 0x97) | (buf[after] == 0xB7), 3, 1)
    quote = np.flatnonzero(buf == 0x27)  # between two letters it is of the word, else the library cuts
    if len(quote):
        beside = (kind == 1) & (buf != 0x27)
        kind[quote] = np.where(beside[quote - 1] & beside[np.minimum(quote + 1, len(buf) - 1)] & (quote > 0), 1, 3)
    if (kind == 3).any():
        edge = np.flatnonzero(np.diff(kind != 0, prepend=False, append=False))
        low, high = edge[0::2], edge[1::2]
        seen = np.concatenate([[0], np.cumsum(kind == 3)])
        odd = seen[high] > seen[low]
        mark = np.zeros(len(buf) + 1, dtype=np.int8)
        mark[low[odd]] += 1
        mark[high[odd]] -= 1
        kind[np.cumsum(mark[:-1]).astype(bool)] = 4
    edge = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(buf)]])
    full = kind[edge[:-1]] != 0
    return edge[:-1][full], edge[1:][full]


class Encoder:
    """A tokenizer with a memory of the spans it has met.

    For tokenizers that normalise case and white space away and cut words from punctuation (as
    word_bpe_49k) the ids of a text are those of its spans one after another. Spans are looked up
    by a 64-bit hash in arrays, where a second one must agree; only those that are new to the worker
    go through the library, a batch at a time. The memory holds ``KNOWN`` spans (about 40 bytes
    each) and then starts again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = "<u2" if self.vocab <= 1 << 16 else "<u4"
        self._clear()

    def _clear(self) -> None:
        self.keys, self.low, self.size = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.check, self.ids = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=self.dtype)

    def _learn(self, keys: np.ndarray, check: np.ndarray, spans: list[str]) -> None:
        """Adds spans under their (ascending) keys."""
        found: list[list[int]] = []
        for k in range(0, len(spans), 4096):
            found += [got.ids for got in self.tokenizer.encode_batch_fast(spans[k : k + 4096], add_special_tokens=False)]
        size = np.array([len(x) for x in found], dtype=np.int32)
        low = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.array([i for x in found for i in x], dtype=self.dtype)])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.check = np.insert(self.keys, at, keys), np.insert(self.check, at, check)
        self.low, self.size = np.insert(self.low, at, low), np.insert(self.size, at, size)

    def encode(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts (UTF-8), one after another, and how many each text has."""
        buf = np.frombuffer(b"\n".join(docs) + b"\n", dtype=np.uint8)
        start, end = spans_of(buf)
        lower = LOWER[buf]
        key, check = span_hashes(lower, start, end), span_hashes(lower, start, end, 1)
        while True:
            keys, first, place = np.unique(key, return_index=True, return_inverse=True)
            if len(self.keys) + len(keys) > KNOWN:
                self._clear()
            at = np.searchsorted(self.keys, keys)
            new = np.ones(len(keys), dtype=bool)
            there = at < len(self.keys)
            new[there] = self.keys[at[there]] != keys[there]
            if new.any():
                raw, pick = buf.tobytes(), first[new]
                self._learn(keys[new], check[pick], [raw[a:b].decode() for a, b in zip(start[pick].tolist(), end[pick].tolist(), strict=True)])
                at = np.searchsorted(self.keys, keys)
            other = self.check[at][place] != check
            if not other.any():
                break
            key[other] = mix(key[other] ^ check[other])  # spans that share a hash get another one
        size = self.size[at][place].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.low[at][place] - total[:-1], size) + np.arange(total[-1])]
        bounds = np.cumsum([0] + [len(d) + 1 for d in docs])
        return ids, np.diff(total[np.searchsorted(start, bounds)])


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _STATE:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _STATE[path] = (Encoder(path),)
    return _STATE[path][0]


def forget() -> None:
    """Drops this process's encoders. (A mapper calls it by name: the table of encoders itself must not
    become part of what is sent to the workers.)"""
    _STATE.clear()


def encode_texts(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """docs (id_, text) to (id_, ids binary): packed ids with end_id appended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for batch in parts(batches):
            docs_ = texts(batch.column(1))
            for a, b in slices([len(d) for d in docs_]):
                ids, n = enc.encode(docs_[a:b])
                edge = np.concatenate([[0], np.cumsum(n)])
                packed = [ids[x:y].tobytes() + end for x, y in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(packed, pa.binary())], names=["id_", "ids"])

    return docs.mapInArrow(lean(run), "id_ bigint, ids binary")


def _counts(ids: DataFrame, vocab: int, dtype: str) -> np.ndarray:
    """How often each id occurs: one row per task and id is shuffled, one per id is collected, so
    the driver's share is bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # all texts are encoded: a worker lives on, its encoder needn't
        total = np.zeros(vocab, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(x, dtype=dtype), minlength=vocab) if len(x) > vocab else 0
            small = b"".join(x for x in batch.column(0).to_pylist() if len(x) <= vocab)
            total += np.bincount(np.frombuffer(small, dtype=dtype), minlength=vocab)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["token", "n"])

    out = np.zeros(vocab, dtype=np.int64)
    for row in ids.select("ids").mapInArrow(lean(run), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect():
        out[row.token] = row.n
    return out


def write_corpus(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> None:
    """Encodes every text and writes the corpus to ``path``, in ascending order of ids.

    A null text is empty: it holds end_id alone. Null ids come first; equal ids stand side by side,
    ordered by their token ids. An empty table makes a corpus without blocks. Other columns are not
    read.
    """
    spark = docs.sparkSession
    enc = encoder(tokenizer)
    vocab, dtype = max(enc.vocab, end_id + 1), enc.dtype
    held = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id_"), F.col(text_col).alias("text"))
    bounds = key_bounds(held, "id_", partitions(spark))
    ids = cut(encode_texts(held, tokenizer, end_id))
    counts = _counts(ids, vocab, dtype)
    lengths = code_lengths(counts, bit_limit(int((counts > 0).sum())))
    spark.createDataFrame([(vocab, dtype, zlib.compress(lengths.tobytes()))], "vocab int, dtype string, lengths binary").coalesce(1).write.parquet(f"{path}/codebook")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        code = Code(lengths)
        part, number, before, n, doc_ids, texts_ = 0, 0, 0, 0, [], []

        def close() -> pa.RecordBatch:
            data = np.frombuffer(b"".join(texts_), dtype=dtype)
            sizes = np.array([len(x) for x in texts_], dtype=np.int64) // np.dtype(dtype).itemsize
            payload = write_block(code, np.array(doc_ids, dtype=np.int64), sizes, data, before)
            row = [part, number, doc_ids[0], len(doc_ids), n, payload]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["part", "block", "first_id", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for p, i, x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if n and (p != part or n >= block):
                    yield close()
                    before, number, n, doc_ids, texts_ = (before + n, number + 1, 0, [], []) if p == part else (0, 0, 0, [], [])
                part = p
                doc_ids.append(i)
                texts_.append(x)
                n += len(x) // np.dtype(dtype).itemsize
        if n:
            yield close()

    n_parts = len(bounds) + 1
    rows = ids.select(bucket_of("id_", bounds).alias("part"), "id_", "ids")
    rows = rows.repartitionById(n_parts, F.col("part")).sortWithinPartitions("part", "id_", "ids")
    rows.mapInArrow(lean(run), "part int, block bigint, first_id bigint, n_docs bigint, n_tokens bigint, payload binary").write.option("compression", "none").parquet(f"{path}/blocks")


def read_code(spark: SparkSession, path: str) -> tuple[np.ndarray, str]:
    row = spark.read.parquet(f"{path}/codebook").head()
    return np.frombuffer(zlib.decompress(row.lengths), dtype=np.uint8), row.dtype


def read_corpus(spark: SparkSession, path: str, with_ids: bool = True, id_col: str = "doc_id") -> DataFrame:
    """The corpus's documents: id, start (ids of all documents before it), n_tokens (with the end
    id), ids_crc32 (of the ids as little-endian u32) and, with_ids, token_ids."""
    lengths, _ = read_code(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # a row for each part
    total, offset = 0, {}
    for part in sorted(sizes):
        offset[part] = total
        total += sizes[part]
    schema = f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", token_ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        code = Code(lengths)
        for batch in batches:
            for part, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs_, counts, ids, before = read_block(code, payload)
                edge = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                cols = [pa.array(docs_, mask=docs_ == NO_ID), pa.array(edge[:-1] + before + offset[part]), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "start", "n_tokens", "ids_crc32", "token_ids"][: 4 + with_ids])

    return blocks.select("part", "payload").mapInArrow(lean(run), schema)
