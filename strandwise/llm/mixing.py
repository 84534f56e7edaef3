"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents fall into cells of (source, language, topic). A cell's weight starts at 1 and is scaled,
margin after margin, until the weighted tokens of every source, language and topic stand in the
target's proportion. Documents are then sampled with probabilities in proportion to their cell's
weight, one at most, that keep a given share of all tokens.

Cells are aggregated before anything moves. Up to ``DRIVER_CELLS`` cells are raked on the driver;
more are raked as a distributed table by the same steps.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm.cluster import NO_ID, cut, fresh

MARGINS = ("source", "lang", "topic")
ALPHA = 0.85
BUDGET = 0.5
ROUNDS, TOLERANCE = 100, 1e-6
DRIVER_CELLS = 100_000
NONE = "(none)"


def topic_of(text: Column) -> Column:
    """A document's kind, told by its layout: table, symbols, capitals, lines or prose."""
    size = F.char_length(text) + 1
    count = lambda rule: F.regexp_count(text, F.lit(rule))
    return (
        F.when(count(r"\|") * 20 > size, "table")
        .when(count("[#$%&*]") * 20 > size, "symbols")
        .when(count("[A-Z]") * 3 > size, "capitals")
        .when(count("\n") * 40 > size, "lines")
        .otherwise("prose")
    )


def token_estimate(text: Column) -> Column:
    """Tokens of a text as its words: runs of other than spaces, tabs and line ends."""
    return F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("bigint")


def tempered(sums: Mapping[str, float], alpha: float = ALPHA) -> dict[str, float]:
    """Shares in proportion to the sums to the power alpha: below 1, the small gain."""
    raised = {k: v**alpha for k, v in sums.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def rake(tokens: np.ndarray, keys: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights of the cells. keys: for each margin the cells' category numbers; targets: the
    categories' shares. Categories without tokens are left out of their margin's target."""
    weight = np.ones(len(tokens))
    total = tokens.sum()
    shares = []
    for key, target in zip(keys, targets, strict=True):
        there = np.bincount(key, tokens, len(target)) > 0
        live = np.where(there, target, 0)
        shares.append(live / live.sum() * total if live.sum() else live)
    for _ in range(rounds):
        worst = 0.0
        for key, share in zip(keys, shares, strict=True):
            now = np.bincount(key, tokens * weight, len(share))
            scale = np.divide(share, now, out=np.ones_like(share), where=now > 0)
            weight = weight * scale[key]
            worst = max(worst, float(np.abs(scale[now > 0] - 1).max(initial=0)))
        if worst < tolerance:
            break
    return weight


def _scale(tokens: np.ndarray, weight: np.ndarray, budget: float) -> float:
    """c with sum(tokens * min(1, c * weight)) = budget of all tokens."""
    goal, order = budget * tokens.sum(), np.argsort(-weight)
    t, w = tokens[order], weight[order]
    full, rest = np.concatenate([[0], np.cumsum(t)]), np.concatenate([np.cumsum((t * w)[::-1])[::-1], [0]])
    for k in range(len(t)):
        c = (goal - full[k]) / rest[k] if rest[k] > 0 else np.inf
        if c * w[k] <= 1:
            return float(c)
    return float("inf")


def _rake_table(cells: DataFrame, targets: dict[str, dict[str, float]], rounds: int, tolerance: float, budget: float) -> DataFrame:
    """rake and _scale for more cells than the driver takes: joins and aggregates by margin."""
    spark, total = cells.sparkSession, cells.agg(F.sum("tokens")).head()[0]
    shares = {}
    for m, target in targets.items():
        goal = spark.createDataFrame(list(target.items()), f"{m} string, share double")
        there = cells.where("tokens > 0").select(m).distinct().join(goal, m)
        mass = there.agg(F.sum("share")).head()[0] or 1.0
        shares[m] = cut(there.select(m, (F.col("share") / mass * total).alias("share")))
    cells = cut(cells.withColumn("weight", F.lit(1.0)))
    for _ in range(rounds):
        worst = 0.0
        for m, share in shares.items():
            now = cells.groupBy(m).agg(F.sum(F.col("tokens") * F.col("weight")).alias("now")).where("now > 0")
            scale = now.join(share, m, "left").select(m, (F.coalesce("share", F.lit(0.0)) / F.col("now")).alias("scale"))
            worst = max(worst, scale.agg(F.max(F.abs(F.col("scale") - 1))).head()[0] or 0.0)
            cells = cells.join(scale, m, "left").withColumn("weight", F.col("weight") * F.coalesce("scale", F.lit(1.0))).drop("scale")
        cells = cut(cells)
        if worst < tolerance:
            break
    c, goal = 0.0, budget * total
    for _ in range(64):
        full = F.col("weight") * F.lit(c) >= 1 if c else F.lit(False)
        held, rest = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("weight")))).head()
        new = (goal - held) / rest if rest else c
        if new <= c * (1 + 1e-12):
            break
        c = new
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(c))).select(*targets, "weight", "probability")


def _margins(text_col: str) -> list[Column]:
    """The source, language and topic of a row, none of them null."""
    named = [F.coalesce(F.col(m).cast("string"), F.lit(NONE)).alias(m) for m in MARGINS[:2]]
    return [*named, topic_of(F.coalesce(F.col(text_col), F.lit(""))).alias("topic")]


def _calibrated(rows: DataFrame, targets: Mapping[str, Mapping[str, float]] | None, budget: float, alpha: float, rounds: int, driver_cells: int) -> DataFrame:
    """(source, lang, topic, weight, probability) of the cells of rows (the margins, n_tokens)."""
    spark = rows.sparkSession
    cells = rows.groupBy(*MARGINS).agg(F.sum("n_tokens").cast("double").alias("tokens"))
    held = cells.limit(driver_cells + 1).collect()
    small = len(held) <= driver_cells
    if not small:
        cells = cut(cells)
    goals = {}
    for k, m in enumerate(MARGINS):
        if targets and m in targets:
            goals[m] = dict(targets[m])
        elif small:
            sums: dict[str, float] = {}
            for r in held:
                sums[r[k]] = sums.get(r[k], 0.0) + r.tokens
            goals[m] = tempered(sums, alpha)
        else:
            goals[m] = tempered({r[0]: r[1] for r in cells.groupBy(m).agg(F.sum("tokens")).collect()}, alpha)
    if not small:
        return _rake_table(cells, goals, rounds, TOLERANCE, budget)
    names = [sorted({r[k] for r in held} | set(goals[m])) for k, m in enumerate(MARGINS)]
    at = [{n: i for i, n in enumerate(x)} for x in names]
    held.sort(key=lambda r: tuple(r[:3]))
    tokens = np.array([r.tokens for r in held])
    keys = [np.array([at[k][r[k]] for r in held], dtype=np.int64) for k in range(len(MARGINS))]
    weight = rake(tokens, keys, [np.array([goals[m].get(n, 0.0) for n in x]) for m, x in zip(MARGINS, names, strict=True)], rounds) if tokens.sum() else np.ones(len(held))
    c = _scale(tokens, weight, budget) if tokens.sum() else budget
    found = [(*(r[k] for k in range(len(MARGINS))), float(w), float(min(1.0, c * w)) if r.tokens else float(budget)) for r, w in zip(held, weight, strict=True)]
    return F.broadcast(spark.createDataFrame(found, ", ".join(f"{m} string" for m in MARGINS) + ", weight double, probability double"))


def _draw(id_col: str, seed: int) -> Column:
    """A number in [0, 1) that follows from the id."""
    held = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID))
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), held), 11) / F.lit(float(1 << 53))


def mixed(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, rounds: int = ROUNDS, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """docs' rows as (id, source, lang, topic, n_tokens, weight, probability, kept).

    targets gives shares by margin; a margin left out takes its own token shares to the power
    alpha. budget is the expected share of all tokens kept. Whether a row is kept follows from a
    hash of its id, so runs agree, and rows that share an id share its fate. Null sources and
    languages form a category of their own; null and empty texts have no tokens and take their
    cell's probability (in a cell without tokens, the budget); a null id counts as an id. An
    empty table gives no rows. Columns other than source, lang, id and text are not read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id_"), *_margins(text_col), token_estimate(F.coalesce(F.col(text_col), F.lit(""))).alias("n_tokens"))
    rows = cut(rows)  # a few bytes a row, so that the texts are read once
    table = _calibrated(rows, targets, budget, alpha, rounds, driver_cells)
    out = rows.join(table, list(MARGINS))
    return out.select(F.col("id_").alias(id_col), *MARGINS, "n_tokens", "weight", "probability", (_draw("id_", seed) < F.col("probability")).alias("kept"))


def sample(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, rounds: int = ROUNDS, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """The rows of docs that ``mixed`` keeps, with their own columns and without moving a text."""
    rows = docs.select(*_margins(text_col), token_estimate(F.coalesce(F.col(text_col), F.lit(""))).alias("n_tokens"))
    table = _calibrated(rows, targets, budget, alpha, rounds, driver_cells)
    names = [fresh(docs.columns, f"mix_{m}") for m in MARGINS]
    p = fresh(docs.columns, "mix_probability")
    place = docs.select("*", *(c.alias(n) for c, n in zip(_margins(text_col), names, strict=True)))
    joined = place.join(table.select(*(F.col(m).alias(n) for m, n in zip(MARGINS, names, strict=True)), F.col("probability").alias(p)), names)
    return joined.where(_draw(id_col, seed) < F.col(p)).select(*(F.col(f"`{c}`") for c in docs.columns))
