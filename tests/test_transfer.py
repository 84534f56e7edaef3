"""Features through edit logs against bases that are moved one edit at a time."""

import random

import pytest

from strandwise.operators import transfer


def brute(n, circular, edits, features):
    """The text as a list of base numbers; a feature holds the numbers that are its own."""
    text, new = list(range(n)), n
    own = {}
    for fid, strand, s, e, frame in features:
        if s < n and (e <= n or (circular and e <= n + s)):
            own[fid] = [[x % n for x in range(s, e)], strand, frame, False, False]
    for op, at, size, put in edits:
        if op not in ("insert", "delete", "replace"):
            continue
        at = min(max(at, 0), len(text))
        gone = []
        if op != "insert":
            gone = text[at : at + size]
            if circular and op == "delete" and at + size > len(text):
                gone = gone + text[: min(at + size - len(text), at)]
        dead = set(gone)
        for f in own.values():
            bases = f[0]
            if not bases:
                continue
            left = next((k for k, x in enumerate(bases) if x not in dead), len(bases))
            right = next((k for k, x in enumerate(reversed(bases)) if x not in dead), len(bases))
            f[3], f[4] = f[3] or left > 0, f[4] or right > 0
            f[2] = (f[2] - (right if f[1] == "reverse" else left)) % 3
            f[0] = [x for x in bases if x not in dead]
        keep = [x for x in text[:at] if x not in dead]
        rest = [x for x in text[at:] if x not in dead]
        add = list(range(new, new + (size if op == "insert" else put if op == "replace" else 0)))
        new += len(add)
        if add:
            for f in own.values():
                bases = f[0]
                if not bases:
                    continue
                # inside: between two of its bases that follow each other in it
                before = keep[-1] if keep else (rest[-1] if circular and rest else None)
                after = rest[0] if rest else (keep[0] if circular and keep else None)
                for k in range(len(bases) - 1):
                    if bases[k] == before and bases[k + 1] == after:
                        bases[k + 1 : k + 1] = add
                        break
        text = keep + add + rest
    where = {x: k for k, x in enumerate(text)}
    return {(fid, where[f[0][0]], where[f[0][0]] + len(f[0]), f[2], f[3], f[4], len(text)) for fid, f in own.items() if f[0]}


def case(rng, circular):
    n = rng.randrange(20, 80)
    edits, size = [], n
    for _ in range(rng.randrange(0, 12)):
        op = rng.choice(["insert", "delete", "replace"])
        at = rng.randrange(0, max(1, size) + 2)
        k = rng.randrange(0, 9)
        put = rng.randrange(1, 6)
        edits.append((op, at, k, put))
        at = min(at, size)
        if op == "insert":
            size += k
        elif op == "delete":
            size -= min(k, size - at) + (min(max(0, at + k - size), at) if circular else 0)
        else:
            size += put - min(k, size - at)
    features = []
    for fid in range(12):
        s = rng.randrange(n)
        e = s + rng.randrange(1, 25)
        features.append((fid, rng.choice(["forward", "reverse"]), s, e, rng.randrange(3)))
    return n, edits, features


@pytest.mark.parametrize("block", [256, 3])
def test_equals_edit_by_edit(spark, monkeypatch, block):
    rng = random.Random(block)
    want, docs, edits, features = set(), [], [], []
    for doc in range(150):
        circular = doc % 2 == 1
        n, log, own = case(rng, circular)
        docs.append((doc, "circular" if circular else "linear", n))
        edits += [(doc, k, k, *x) for k, x in enumerate(log)]
        features += [(f[0] + doc * 100, doc, *f[1:]) for f in own]
        want |= {(doc, x[0] + doc * 100, *x[1:]) for x in brute(n, circular, log, own)}
    got = set()
    if block == 256:
        df = transfer.moved_features(spark.createDataFrame(features, "feature_id long, doc_id int, strand string, start int, end int, frame int"), spark.createDataFrame(edits, "doc_id int, ms long, event_id long, op string, position int, len int, put int"), spark.createDataFrame(docs, "doc_id int, topology string, length int"))
        got = {tuple(r) for r in df.collect()}
    else:
        monkeypatch.setattr(transfer, "BLOCK", block)
        for doc, topology, n in docs:
            log = transfer.Log(n)
            for e in edits:
                if e[0] == doc:
                    log.add(*e[3:], topology == "circular")
            own = [f for f in features if f[1] == doc]
            rows = transfer._of(log, n, topology == "circular", doc, [f[2] for f in own], [f[3] for f in own], [f[4] for f in own], [f[5] for f in own], [f[0] for f in own])
            got |= set(zip(*rows, strict=True))
    assert got == want


def test_odd_rows(spark):
    f = [(1, 1, "forward", 2, 5, None), (2, 1, "forward", None, 5, 0), (3, 1, None, 4, 4, 0), (4, 9, "forward", 0, 3, 0), (5, None, "forward", 0, 3, 0), (6, 1, "reverse", 8, 30, 1)]
    e = [(1, 1, 1, None, 3, 4, 0), (1, 2, 2, "insert", None, 4, 0), (1, None, 3, "insert", 0, 2, 0), (9, 1, 1, "insert", 0, 2, 0)]
    d = [(1, "linear", 10), (2, None, None)]
    df = transfer.moved_features(spark.createDataFrame(f, "feature_id long, doc_id int, strand string, start int, end int, frame int"), spark.createDataFrame(e, "doc_id int, ms long, event_id long, op string, position int, len int, put int"), spark.createDataFrame(d, "doc_id int, topology string, length int"))
    assert [tuple(r) for r in df.collect()] == [(1, 1, 4, 7, 0, False, False, 12)]
