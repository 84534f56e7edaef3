"""Substring dedup and SimHash against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from samples import frame, odd_rows, words

from strandwise.llm import simhash, substring
from strandwise.llm.text import LOWER

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NONE = -(1 << 63)


def brute_substring(rows, size):
    """Places are (id, start); rows that share an id share their places."""
    first, docs = {}, {}
    for i, t in rows:
        docs.setdefault(NONE if i is None else i, []).append(WORD.findall(t or ""))
    for i in sorted(docs):
        for w in docs[i]:
            for k in range(len(w) - size + 1):
                key = tuple(w[k : k + size])
                first[key] = min(first.get(key, (i, k)), (i, k))
    flagged = {i: {k for w in ws for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < (i, k)} for i, ws in docs.items()}
    out = []
    for i, ws in docs.items():
        for w in ws:
            gone = {p for k in flagged[i] for p in range(k, k + size)}
            kept = " ".join(x for p, x in enumerate(w) if p not in gone)
            out.append((None if i == NONE else i, len(w), len(w) - sum(p not in gone for p in range(len(w))), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [4, 20])
def test_substring_brute(spark, odd, size):
    rows = [r for r in odd_rows() if r[0] != 116 or size == 20]
    df = frame(spark, rows).repartition(3)
    found = substring.remove_repeats(df, window=size).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in found), key=str)
    want = brute_substring(rows, size)
    if size == 4:  # texts that share an id may hold different words: only the digests of their own
        assert [g[:4] for g in got if g[0] is not None] == [w[:4] for w in want if w[0] is not None]
    else:
        assert got == want


def test_substring_empty(empty):
    assert substring.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        substring.repeated_windows(empty, 7)


def test_substring_flushes(spark, monkeypatch):
    monkeypatch.setattr(substring, "FLUSH", 50)
    rng = random.Random(3)
    passage = words(rng, 30)
    rows = [(k, words(rng, 30) + " " + passage + " " + words(rng, 5)) for k in range(60)]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in substring.remove_repeats(frame(spark, rows)).collect())
    assert got == sorted(brute_substring(rows, 20))


def brute_print(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(LOWER[np.frombuffer((text or "").encode(), dtype=np.uint8)]))
    s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius):
    """The smallest id reachable, for a list of (id, print)."""
    label = list(range(len(prints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
                label[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        least[root(k)] = min(least.get(root(k), i), i)
    return [least[root(k)] for k in range(len(prints))]


def test_simhash_brute(odd):
    rows = odd_rows()
    prints = [(NONE if i is None else i, brute_print(t)) for i, t in rows]
    comp = brute_components(prints, 3)
    want = sorted(((i, format(p, "016x"), c) for (i, p), c in zip(prints, comp, strict=True)))
    found = simhash.near_duplicates(odd.repartition(3)).select("doc_id", simhash.hex_print().alias("f"), "component_id").collect()
    none = lambda x: NONE if x is None else x
    assert sorted((none(r.doc_id), r.f, none(r.component_id)) for r in found) == want


@pytest.mark.parametrize("block", [3, 512])
def test_links_of_clustered_prints(spark, block):
    rng = random.Random(8)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(rng.randrange(0, 5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    links = [(r.a, r.b) for r in simhash.link_fingerprints(df, block=block).collect()]
    assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() <= 64 for a, b in links)
    label = {p: p for p in signed}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        label[root(a)] = root(b)
    want = brute_components(list(enumerate(prints)), 3)
    groups = {}
    for p, w in zip(signed, want, strict=True):
        groups.setdefault(root(p), set()).add(w)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_copies(empty).count() == 0


def test_near_copies(spark):
    rng = random.Random(21)
    rows = []
    for k in range(30):
        text = words(rng, 200).split()
        rows.append((3 * k, " ".join(text)))
        rows.append((3 * k + 1, " ".join(text)))
        text[100] = "zz"
        rows.append((3 * k + 2, " ".join(text)))
    rows += [(1000, ""), (1001, None)]
    found = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, rows)).collect()}
    assert all(found[i] == i // 3 * 3 for i in range(90)) and found[1001] == 1000
    left = simhash.without_copies(frame(spark, rows))
    assert sorted(r.doc_id for r in left.collect()) == [3 * k for k in range(30)] + [1000]
    assert left.columns == frame(spark, rows).columns


def _edited(rng, text, changes):
    w = text.split()
    for i in rng.sample(range(10, len(w) - 10), changes):
        w[i] = f"new{rng.randrange(10**9)}"
    return " ".join(w)


def _resemblance(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_near_copies_lose_no_pair(spark):
    rng = random.Random(31)
    text = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    rows, want = [], {}
    while len(rows) < 600:  # pairs just above 0.8, none with a third text that would link them
        a = text(rng.randrange(150, 400))
        b = _edited(rng, a, len(a.split()) // 46)
        if 0.8 <= _resemblance(a, b) < 0.83:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    found = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, rows)).collect()}
    assert all(found[k] == k // 2 * 2 for k in range(len(rows)))


def test_near_copies_link_nothing_below(spark):
    rng = random.Random(32)
    rows = []
    while len(rows) < 200:
        a = " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(150, 400)))
        b = _edited(rng, a, len(a.split()) // 36)
        if 0.72 <= _resemblance(a, b) < 0.8:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    assert all(r.doc_id == r.component_id for r in simhash.near_copies(frame(spark, rows)).collect())


def test_ring_pairs_connect_all_within_the_radius(spark):
    rng = random.Random(33)
    rows = []
    for k in range(40):
        centre = rng.getrandbits(64)
        for j in range(6):
            x = centre
            for _ in range(rng.randrange(0, 4)):
                x ^= 1 << rng.randrange(64)
            rows.append((x, 100 * k + j % 5))  # one set under two fingerprints, too
    signed = [(x - (1 << 64) if x >> 63 else x, fp) for x, fp in rows]
    found = [(r.a, r.b) for r in simhash.ring_pairs(spark.createDataFrame(signed, "sim bigint, fp bigint").repartition(3)).collect()]
    sims = {}
    for x, fp in rows:
        sims.setdefault(fp, set()).add(x)
    near = [(a, b) for a in sims for b in sims if a < b and any((x ^ y).bit_count() <= 3 for x in sims[a] for y in sims[b])]
    assert all(a < b for a, b in found) and len(found) == len(set(found))

    def groups(links):
        label = {fp: fp for fp in sims}
        for _ in sims:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert groups(found) == groups(near) and len(set(groups(near).values())) < len(sims)


def test_near_copies_come_from_fingerprints_and_are_checked(spark, monkeypatch):
    rng = random.Random(34)
    text = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(20):  # one word of 600 changed: a bit or two
        w = text(600)
        rows.append((2 * k, " ".join(w)))
        w[300] = "changed"
        rows.append((2 * k + 1, " ".join(w)))
    for k in range(20):  # equal but for the words that a repeated line drowns: one fingerprint, other sets
        line = text(3) * 200
        rows += [(1000 + 2 * k, " ".join(line + text(8))), (1001 + 2 * k, " ".join(line + text(8)))]
    made, own = [], simhash.ring_pairs

    def seen(prints, *rest):
        out = own(prints, *rest)
        ids = {r.fp: r.id_ for r in prints.collect()}
        made.extend(tuple(sorted((ids[r.a], ids[r.b]))) for r in out.collect())
        return out

    monkeypatch.setattr(simhash, "ring_pairs", seen)
    found = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, rows)).collect()}
    assert len([p for p in made if p[1] < 1000]) >= 15 and len([p for p in made if p[0] >= 1000]) >= 15
    assert all(found[k] == k // 2 * 2 for k in range(40)) and all(found[k] == k for k in found if k >= 1000)
