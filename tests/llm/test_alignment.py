"""Cross-tokenizer alignment against the libraries on whole texts and a token-by-token walk."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from samples import frame, odd_rows
from tokenizers import Tokenizer

from strandwise.llm import alignment
from strandwise.llm.queries import op13_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), {c: b for c, b in alignment.byte_letters().items()}


def cut(libraries, text):
    a, b, letters = libraries
    want = (" " + text).encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return None
    return list(zip(ids_a, bytes_a, strict=True)), list(zip(ids_b, bytes_b, strict=True))


def ends(tokens):
    out, at = [], 0
    for _, x in tokens:
        out.append((at, at + len(x)))
        at += len(x)
    return out


def brute(libraries, rows):
    seen, per = defaultdict(Counter), []
    for i, text in rows:
        got = cut(libraries, text or "")
        if not got:
            per.append((i, 0, 0, 0, [], ""))
            continue
        a, b = got
        ea, eb = ends(a), ends(b)
        links, k = [], 0
        for (x, y), (ta, _) in zip(ea, a, strict=True):
            while eb[k][1] <= x:
                k += 1
            m = k
            while m < len(b) and eb[m][0] < y:
                links.append((ta, b[m][0]))
                m += 1
        shared = sorted({y for _, y in ea} & {y for _, y in eb})
        groups, p, q = [], 0, 0
        for y in shared:
            ga, gb = [], []
            while p < len(a) and ea[p][1] <= y:
                ga.append(str(a[p][0]))
                p += 1
            while q < len(b) and eb[q][1] <= y:
                gb.append(str(b[q][0]))
                q += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        per.append((i, len(a), len(b), len(shared), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        for pair in set(links):
            seen[pair[0]][pair[1]] += 1
    out = []
    for i, na, nb, ng, links, sha in per:
        best = sum(seen[x][y] == max(seen[x].values()) for x, y in links)
        out.append((i, na, nb, ng, len(links), best, sum(seen[x][y] for x, y in links), sha))
    return out


def hostile():
    rng = random.Random(8)
    signs = list("abc  \n\t.'\"<>_▁é中文ﬁ 　́​😀٣½ß'’—0123") + ["  ", " \n ", "don't", "<|endoftext|>", "<s>", "</s>", "<0x0A>", "\x00", "\x1c", "\x85", "ÀB", "naïve", "Ω "]
    return [(500 + k, "".join(rng.choice(signs) for _ in range(rng.randrange(1, 40)))) for k in range(600)]


def same(found, libraries, rows):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr) == sorted(brute(libraries, rows), key=repr)


def test_against_the_libraries(spark, libraries):
    rows = odd_rows() + hostile() + [(2000, " "), (2001, "a "), (2002, " a"), (2003, "▁"), (2004, "  "), (2005, "a  b"), (2006, "x" * 3000)]
    assert sum(cut(libraries, t or "") is not None for _, t in rows) > 300
    same(alignment.aligned(frame(spark, rows), A, B), libraries, rows)


def test_small_blocks_and_memory(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "KNOWN", 50)
    cutter = alignment.Cutter(A, B)
    rows = [t.encode() for _, t in hostile()]
    one = alignment.Aligned(cutter, rows[:300])
    for k, text in enumerate(rows[:300]):
        alone = alignment.Aligned(cutter, [text])
        assert (alone.n_a[0], alone.n_b[0], alone.n_groups[0], alone.n_links[0]) == (one.n_a[k], one.n_b[k], one.n_groups[k], one.n_links[k])
    assert one.group_texts()[7] == alignment.Aligned(cutter, [rows[7]]).group_texts()[0]


def test_blocks_are_put_together(spark, libraries):
    docs = frame(spark, hostile()).repartition(40)  # blocks of a few texts each
    same(alignment.aligned(docs, A, B), libraries, hostile())


def test_empty_table(spark, empty):
    assert alignment.aligned(empty, A, B).collect() == []


def test_query(spark, sf_dir, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    same(op13_alignment(spark, sf_dir), libraries, rows)
