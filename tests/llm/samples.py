"""Rows for the operators' tests."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id_ int, fp string, topic string, weight double, mix_ string, part int, h string, places string, label int, component_id string"


def frame(spark, rows):
    """documents of (doc_id, text) with other columns whose names the operators use inside."""
    full = [(i, t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 3}", len(t) if t is not None else None, 1, "x", "y", 0.5, "z", 9, "q", "w", 3, "c") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(rng, n, size=40):
    return " ".join("w" + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 4))) for _ in range(n)) if size else ""


def odd_rows():
    """Nulls, empties, repeats, ties, a very long text, near copies and shared passages."""
    rng = random.Random(12)
    base = [words(rng, rng.randrange(1, 120)) for _ in range(25)]
    passage = words(rng, 60)
    long = words(rng, 40_000)
    near = base[3].split()
    near[len(near) // 2] = "changed"
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100, base[0]), (101, base[0]), (102, " ".join(near)), (103, base[1] + "\n" + passage), (104, passage + " x " + base[2]), (105, passage.upper())]
    rows += [(110, ""), (111, None), (112, "  \n\t "), (113, "one"), (114, "same same " * 40), (115, "É, ok. don't <|endoftext|> 12.5kg 中文   x"), (116, long), (None, base[4]), (None, None)]
    rows += [(120, base[5]), (120, base[5])]
    return rows
