"""Delta histories: round trips, chain lengths, damage."""

import random

from strandwise.operators import deltas


def log(rng, doc, n):
    text, out = "".join(rng.choice("ACGT") for _ in range(200)), []
    for v in range(n):
        out.append((doc, v * 2, text))
        at = rng.randrange(len(text) + 1)
        text = text[:at] + "".join(rng.choice("ACGTé") for _ in range(rng.randrange(6))) + text[at + rng.randrange(6) :]
        if rng.random() < 0.05:
            text = "".join(rng.choice("AC") for _ in range(rng.randrange(300)))
    return out


def test_shared_ends():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("AB") for _ in range(rng.randrange(9))) for _ in range(2))
        p, s = deltas.shared_ends(a, b)
        want = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        rest = min(len(a), len(b)) - want
        tail = next((k for k in range(rest) if a[-1 - k] != b[-1 - k]), rest)
        assert (p, s) == (want, tail)


def test_round_trip(spark):
    rng = random.Random(2)
    rows = [r for doc in range(20) for r in log(rng, doc, rng.randrange(1, 60))]
    rows += [(50, 1, None), (50, 2, ""), (50, 3, "A"), (None, 1, "x"), (51, None, "x"), (52, 1, "b"), (52, 1, "a")]
    df = spark.createDataFrame(rows, "doc_id int, version int, text string").repartition(4)
    kept = deltas.encode(df, 8)
    held = {(r.doc_id, r.version): r for r in kept.collect()}
    want = {}
    for d, v, t in rows:
        if d is not None and v is not None:
            want[d, v] = min(want[d, v], t or "") if (d, v) in want else t or ""
    got = {(r.doc_id, r.version): r.text for r in deltas.decode(kept).collect()}
    assert got == want and len(held) == len(want)
    assert sum(len(r.middle) for r in held.values()) < 0.4 * sum(map(len, want.values()))
    assert deltas.chain_lengths(kept).where("longest > 7").count() == 0
    ask = spark.createDataFrame([(3, 4), (3, 999), (7, 0), (None, 1)], "doc_id int, version int")
    some = {(r.doc_id, r.version): r.text for r in deltas.decode(kept, ask).collect()}
    assert some == {k: want[k] for k in ((3, 4), (7, 0)) if k in want}


def test_damage(spark):
    rows = [(1, 1, False, 0, 0, "x"), (1, 2, True, 0, 0, "abc"), (1, 3, False, 2, 2, "y"), (1, 4, False, 0, 0, "z"), (1, 5, True, 0, 0, None), (2, 1, True, 0, 0, "abcd"), (2, 2, False, 1, 1, None), (2, 3, False, None, 1, "q")]
    got = {(r.doc_id, r.version): r.text for r in deltas.decode(spark.createDataFrame(rows, f"doc_id int, {deltas.DELTA}")).collect()}
    assert got == {(1, 1): None, (1, 2): "abc", (1, 3): None, (1, 4): None, (1, 5): "", (2, 1): "abcd", (2, 2): "ad", (2, 3): None}
