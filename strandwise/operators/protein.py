"""Protein measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandwise import dims
from strandwise.functions.seq import count_in, let


def chain(protein: Column) -> Column:
    return F.translate(F.upper(protein), "*", "")


def mass_ten_thousandths(protein: Column) -> Column:
    """The sum of residue masses in ten-thousandths of a dalton, exact; water left out."""
    out = F.lit(0).cast("bigint")
    for r, m in dims.RESIDUE_MASS.items():
        out = out + count_in(protein, r) * round(m * 10_000)
    return out


def molecular_weight(protein: Column) -> Column:
    return let(chain(protein), lambda p: F.when(F.length(p) == 0, 0.0).otherwise(mass_ten_thousandths(p) / 10_000.0 + dims.WATER))


def extinction(protein: Column) -> tuple[Column, Column]:
    """Molar absorptivity at 280 nm with cystines, and with every Cys reduced."""
    p = chain(protein)
    reduced = count_in(p, "W") * dims.ABSORB_W + count_in(p, "Y") * dims.ABSORB_Y
    return reduced + F.floor(count_in(p, "C") / 2).cast("int") * dims.ABSORB_CYSTINE, reduced


def net_charge(protein: Column, ph: Column) -> Column:
    h = F.pow(F.lit(10.0), ph)
    up = lambda pk: F.pow(F.lit(10.0), F.lit(pk)) / (F.pow(F.lit(10.0), F.lit(pk)) + h)
    first = F.substring(protein, 1, 1)
    terminal = F.lit(dims.N_TERMINAL_DEFAULT)
    for r, pk in dims.N_TERMINAL_PK.items():
        terminal = F.when(first == r, pk).otherwise(terminal)
    out = F.pow(F.lit(10.0), terminal) / (F.pow(F.lit(10.0), terminal) + h) - (1 - up(dims.C_TERMINAL_PK))
    for r, pk in dims.POSITIVE_PK.items():
        out = out + count_in(protein, r) * up(pk)
    for r, pk in dims.NEGATIVE_PK.items():
        out = out - count_in(protein, r) * (1 - up(pk))
    return out


def isoelectric_point(protein: Column) -> Column:
    """The pH without net charge, by 18 halvings of 0 to 14; null for an empty chain."""

    def solve(p: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("low"), F.lit(14.0).alias("high"))

        def halve(a: Column, _: Column) -> Column:
            return let((a.low + a.high) / 2, lambda m: F.when(net_charge(p, m) > 0, F.struct(m.alias("low"), a.high.alias("high"))).otherwise(F.struct(a.low.alias("low"), m.alias("high"))))

        found = F.aggregate(F.sequence(F.lit(1), F.lit(18)), start, halve, lambda a: (a.low + a.high) / 2)
        return F.when(F.length(p) > 0, found)

    return let(chain(protein), solve)
