"""Huffman coding, the token corpus and edit-aware counts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from samples import odd_rows
from tokenizers import Tokenizer

from strandwise.llm import edits, huffman, tokens
from strandwise.llm.cluster import shared_dir

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n,limit", [(1, 12), (2, 12), (5, 3), (300, 12), (3000, 13)])
def test_huffman_round_trip(n, limit):
    rng = np.random.default_rng(n)
    counts = np.zeros(n + 40, dtype=np.int64)
    counts[rng.choice(n + 40, n, replace=False)] = rng.geometric(0.01, n)
    lengths = huffman.code_lengths(counts, limit)
    used = counts > 0
    assert lengths[used].max() <= limit and not lengths[~used].any()
    assert sum(2.0 ** -int(x) for x in lengths[used]) <= 1
    code = huffman.Code(lengths)
    for size in (0, 1, 127, 128, 129, 5000):
        ids = rng.choice(np.flatnonzero(used), size, p=counts[used] / counts.sum())
        docs = np.array([-3, 7], dtype=np.int64)
        block = huffman.write_block(code, docs, np.array([size // 3, size - size // 3]), ids, 99)
        back = huffman.read_block(code, block)
        assert (back[0] == docs).all() and (back[2] == ids).all() and back[3] == 99


def test_lengths_are_optimal_without_a_limit():
    import heapq

    rng = random.Random(1)
    for _ in range(20):
        c = [rng.randrange(1, 50) for _ in range(rng.randrange(2, 30))]
        heap, cost = list(c), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            cost += x
            heapq.heappush(heap, x)
        assert (huffman.code_lengths(np.array(c), 30).astype(int) * np.array(c)).sum() == cost


def test_not_a_block():
    with pytest.raises(ValueError):
        huffman.read_block(huffman.Code(np.array([1, 1])), bytes(60))
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, dtype=np.int64), 3)


def test_encoder_equals_library():
    enc, rng = tokens.Encoder(WORD_BPE), random.Random(5)
    letters = ["a", "B", "é", "É", "ß", "×", " ", "\n", "\t", "'s", "'", "don't", "1", "23", ".", ",", "<|endoftext|>", "<|", "…", " ", "́", "İ", "Σ", "中", "\x0b", "\x1c", "!!", "ﬁ"]
    for _ in range(800):
        x = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 14)))
        ids, n = enc.encode([x.encode(), b"", x.encode()])
        want = enc.tokenizer.encode(x, add_special_tokens=False).ids
        assert ids.tolist() == want + want and n.tolist() == [len(want), 0, len(want)], repr(x)


def test_encoder_starts_again(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN", 4)
    enc = tokens.Encoder(WORD_BPE)
    for x in ("a b c", "d e f", "a b c d e f g"):
        assert enc.encode([x.encode()])[0].tolist() == enc.tokenizer.encode(x, add_special_tokens=False).ids


def test_corpus(spark, odd):
    path = shared_dir(spark)
    tokens.write_corpus(odd.repartition(3), path, WORD_BPE, end_id=2, block=500)
    tk = Tokenizer.from_file(WORD_BPE)
    rows = sorted(((-(1 << 63) if i is None else i, tk.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in odd_rows()), key=lambda r: (r[0], np.array(r[1], "<u2").tobytes()))
    want, start = [], 0
    for i, ids in rows:
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    found = sorted(((-(1 << 63) if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.token_ids) for r in tokens.read_corpus(spark, path).collect()), key=lambda r: r[1])
    assert found == want


def test_empty_corpus(spark, empty):
    path = shared_dir(spark)
    tokens.write_corpus(empty, path, WORD_BPE)
    assert tokens.read_corpus(spark, path).count() == 0


def replaced(t, a, b, r):
    a = min(max(a, 0), len(t))
    b = min(max(b, a), len(t))
    return t[:a] + r + t[b:]


def test_trees_follow_edits():
    tk, counts, rng = Tokenizer.from_file(BYTE_BPE), edits.Counter(BYTE_BPE), random.Random(1)
    for _ in range(150):
        text = "".join(rng.choice(["a", "b", " ", "  ", "\n", "ab", "12", "é", " x", ".", "word "]) for _ in range(rng.randrange(0, 300)))
        tree = edits.TokenTree(text, counts)
        for _ in range(10):
            a = rng.randrange(0, len(text) + 2)
            b, r = a + rng.randrange(0, 12), "".join(rng.choice([" ", "a", "\n", " b", "  ", "é1"]) for _ in range(rng.randrange(0, 5)))
            text = replaced(text, a, b, r)
            tree.edit(a, b, r)
            assert tree.text() == text and tree.n_chars == len(text)
            assert tree.n_tokens == len(tk.encode(text, add_special_tokens=False))


def test_an_edit_counts_little_again():
    tree = edits.TokenTree("word " * 20_000, edits.Counter(BYTE_BPE))
    tree.edit(50_000, 50_003, "x")
    assert tree.encoded < 1000


def test_recount(spark, odd, empty):
    tk = Tokenizer.from_file(BYTE_BPE)
    n = lambda t: len(tk.encode(t, add_special_tokens=False))
    want = []
    for i, t in odd_rows():
        x = t or ""
        e = replaced(x, len(x) // 4, len(x) // 4, " edited")
        e = replaced(e, len(x) // 2, len(x) // 2 + 16, x[:24])
        e = replaced(e, len(x) - 10, 1 << 30, "")
        want.append((str(i), n(x), n(e), len(e), zlib.crc32(e.encode())))
    found = edits.recount(edits.with_sample_edits(odd), BYTE_BPE).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.edited_tokens, r.edited_chars, r.edited_crc32) for r in found) == sorted(want)
    assert edits.recount(edits.with_sample_edits(empty), BYTE_BPE).count() == 0
