"""Vector codes against full scans in Python integers."""

import hashlib
import math
import random

import numpy as np

from strandwise.llm import vectorcodes as V
from strandwise.llm.queries import op12_vector_codes

SCHEMA = "vec_id bigint, embedding array<{}>, label int, code string, vec_ int, id_ string, slot_ int, error double"


def brute(rows, n_parts, entries, rounds):
    """rows: (id, vector, label)."""
    order = lambda r: (r[0] is None, r[0] or 0, list(r[1]))
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    kept.sort(key=order)
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    vectors = [[int(math.floor(x * 256)) for x in r[1]] for r in kept]
    width = len(vectors[0]) // n_parts
    cut = lambda v: [tuple(v[k * width : (k + 1) * width]) for k in range(n_parts)]
    pieces = [cut(v) for v in vectors]
    books = [[p[k] for p in pieces[:entries]] for k in range(n_parts)]
    near = lambda p, book: min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        new = []
        for k in range(n_parts):
            groups = {}
            for p in pieces:
                groups.setdefault(near(p[k], books[k])[1], []).append(p[k])
            new.append([tuple(sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)) if e in groups else old for e, old in enumerate(books[k])])
        books = new
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out = []
    for r, p in zip(kept, pieces, strict=True):
        found = [near(p[k], books[k]) for k in range(n_parts)]
        out.append([r[0], "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), r[2]])
    fits = lambda x: x if x < 1 << 63 else None
    return [(i, code, fits(e), fits(sum(o[2] for o in out if o[3] == lab)), digest) for i, code, e, lab in out]


def check(spark, rows, kind="double", n_parts=4, entries=8, rounds=2):
    df = spark.createDataFrame([(i, v, lab, "c", 1, "i", 2, 0.5) for i, v, lab in rows], SCHEMA.format(kind)).repartition(3)
    got = V.vector_codes(df, n_parts=n_parts, entries=entries, rounds=rounds).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute(rows, n_parts, entries, rounds), key=repr)
    return got


def test_against_full_scans(spark):
    rng = random.Random(3)
    rows = [(k * 3 % 200, [rng.gauss(0, 1) for _ in range(8)], rng.choice([None, 1, 2, 3])) for k in range(200)]
    rows += [(1000 + k, [round(rng.random() * 2) / 2 for _ in range(8)], None) for k in range(60)]  # ties
    rows += [(5, [0.25] * 8, 1), (5, [0.25] * 8, 1), (None, [0.5] * 8, 2), (None, [-0.5] * 8, 9)]
    rows += [(2000, None, 1), (2001, [None] + [0.0] * 7, 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] + [0.0] * 7, 1), (2004, [], 1), (2005, [1.0] * 4, 1)]
    assert len(check(spark, rows)) == 264
    check(spark, rows, rounds=0)
    check(spark, rows, n_parts=8, entries=256)
    check(spark, rows[:3])


def test_numbers_beyond_64_bits(spark):
    rng = random.Random(5)
    rows = [(k, [rng.choice([1e30, -3e5, 7.125, 1e9]) * rng.random() for _ in range(4)], k % 2) for k in range(40)]
    check(spark, rows, n_parts=2, entries=4)


def test_equal_vectors_and_empty_entries(spark):
    check(spark, [(k, [1.0, 2.0, 3.0, 4.0], 1) for k in range(20)])


def test_empty(spark):
    assert check(spark, [(1, None, 1)]) == []
    assert V.vector_codes(spark.createDataFrame([], SCHEMA.format("float"))).collect() == []


def test_exponion_scans_fewer_and_finds_the_same():
    rng = np.random.default_rng(1)
    book = rng.integers(-500, 500, (64, 4))
    x = book[rng.integers(0, 64, 3000)] + rng.integers(-40, 40, (3000, 4))
    full = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    for start in (full.argmin(axis=1), np.zeros(3000, dtype=np.int64), V._guess(x, book)):
        best, least = V.nearest(x, book, start)
        assert (best == full.argmin(axis=1)).all() and (least == full.min(axis=1)).all()


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op12_vector_codes(spark, sf_dir).collect())) == sorted(brute(rows, 16, 64, 2))
