"""Line dedup against a second implementation."""

import hashlib
import random
from collections import defaultdict

from samples import frame, odd_rows

from strandwise.llm import lines


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, shortest, documents):
    holders = defaultdict(list)
    for n, (i, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            holders[k].append(float("-inf") if i is None else i)
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        here = float("-inf") if i is None else i
        kept = [x for x in own if len(key(x)) < shortest or len(holders[key(x)]) < documents or max(holders[key(x)]) == here]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return out


def rows_with_lines(seed=4, n=160):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("alpha Beta gamma Delta épsilon zêta".split()) for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    hot = "This line stands in most of the documents, in Several Spellings"
    rows = odd_rows()
    for k in range(n):
        own = [rng.choice(["", " ", "\t"]) + rng.choice([str.upper, str.lower, str])(rng.choice(pool)) + rng.choice(["", "\r", " \x0b"]) for _ in range(rng.randrange(0, 12))]
        if rng.random() < 0.7:
            own.append(hot.swapcase() if rng.random() < 0.5 else f"  {hot}")
        rows.append((1000 + k, "\n".join(own)))
    rows += [(2000, "\n" * 50), (2001, "x" * 40), (2001, "x" * 40), (2002, "é" * 39 + "\n" + "é" * 40), (None, hot), (None, hot.upper())]
    rows += [(3000 + k, "é" * 39 + "\n" + "É" * 20 + "x" * 20 + " ") for k in range(6)]
    return rows


def same(found, rows, shortest=40, documents=5):
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"]
    got = sorted((tuple(r[n] for n in names) for r in found.collect()), key=repr)
    assert got == sorted(brute(rows, shortest, documents), key=repr)


def test_against_brute_force(spark):
    rows = rows_with_lines()
    same(lines.drop_repeated_lines(frame(spark, rows)), rows)


def test_any_number_of_batches_and_levels(spark):
    rows = rows_with_lines(9, 60)
    docs = frame(spark, rows)
    for batches, documents in ((1, 5), (5, 3), (7, 1)):
        same(lines.drop_repeated_lines(docs, documents=documents, batches=batches, shortest=12), rows, 12, documents)


def test_runs_close_and_compact(spark):
    runs = lines.Runs(spark, 3)
    for k in reversed(range(5)):
        runs.add(spark.range(k * 10, k * 10 + 10).selectExpr("id AS id_", "id % 4 AS h", "0L AS g"))
        assert [bool(x) for x in runs.levels] == [bool(5 - k >> j & 1) for j in range((5 - k).bit_length())]
    names = runs.names
    held = {r.h: r.n for name in runs.levels if name for r in spark.table(name).collect()}
    assert held == {0: 3, 1: 3, 2: 5, 3: 5}  # closed by the first compaction at the latest, then nothing is added
    assert sorted(tuple(r) for r in runs.close().collect()) == [(0, 0, 48), (1, 0, 49), (2, 0, 46), (3, 0, 47)]
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_empty_table(spark, empty):
    assert lines.drop_repeated_lines(empty).collect() == []
