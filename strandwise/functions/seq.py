"""Per-sequence scalars as Column expressions: all JVM-side, none needs a shuffle."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandwise import dims


def let(value: Column, f) -> Column:
    """f(value), the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def positions(n: Column) -> Column:
    """0 .. n - 1, empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def complement(seq: Column) -> Column:
    return F.translate(seq, dims.COMPLEMENT_FROM, dims.COMPLEMENT_TO)


def revcomp(seq: Column) -> Column:
    return F.reverse(complement(seq))


def is_nucleotide(seq: Column) -> Column:
    return seq.rlike("^[ACGTURYKMBDHVSWNacgturykmbdhvswn]*$")


def normalise(seq: Column) -> Column:
    """White space and digits taken out, as numbered blocks are pasted."""
    return F.regexp_replace(seq, r"[\s0-9]+", "")


def count_in(seq: Column, letters: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def gc_sixths(seq: Column) -> tuple[Column, Column]:
    """G and C in sixths of a base, and the bases that count, in sixths; N counts for neither."""
    up = F.upper(seq)
    gc = F.lit(0)
    for weight in (6, 4, 3, 2):
        gc = gc + count_in(up, "".join(k for k, v in dims.GC_SIXTHS.items() if v == weight)) * weight
    return gc, count_in(up, "".join(dims.GC_SIXTHS)) * 6


def gc_content(seq: Column) -> Column:
    gc, counted = gc_sixths(seq)
    return F.when(counted > 0, gc / counted)


def gc_fraction(seq: Column) -> Column:
    """G, C and S over the whole length, as primers are judged."""
    return F.when(F.length(seq) > 0, count_in(F.upper(seq), "GCS") / F.length(seq))


def codon_map(table: int) -> Column:
    return F.create_map(*[F.lit(x) for pair in dims.code_table(table).items() for x in pair])


def _expand(codon: Column, table: int) -> Column:
    """The amino acid on which all readings of an ambiguous codon agree, else X."""
    sets = F.create_map(*[F.lit(x) for k, v in dims.IUPAC.items() for x in (k, v)])
    at = lambda i: F.split(F.try_element_at(sets, F.substring(codon, i, 1)), "")
    grow = lambda a, b: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, y))))
    read = F.array_distinct(F.transform(grow(grow(at(1), at(2)), at(3)), lambda c: F.try_element_at(codon_map(table), c)))
    return F.when(F.size(read) == 1, F.get(read, F.lit(0))).otherwise("X")


def translate_codon(codon: Column, table: int = 1) -> Column:
    up = F.upper(codon)
    plain = F.try_element_at(codon_map(table), F.translate(up, "U", "T"))
    return F.coalesce(F.when(F.length(up) == 3, F.coalesce(plain, _expand(up, table))), F.lit("X"))


def translate(seq: Column, table: int = 1, frame: int = 0) -> Column:
    """Amino acids of whole codons from an offset; a partial last codon is dropped.

    Plain sequences index NCBI's 64-letter string by three base digits; only sequences with
    ambiguity codes take the way over all readings.
    """
    n = F.floor((F.length(seq) - frame) / 3).cast("int")
    acids = F.lit("".join(dims.code_table(table).values()))

    def plain(t: Column) -> Column:
        # an array of digits: a substring would walk the text from its start for every codon
        at = lambda d, i: F.substring(acids, F.get(d, i) * 16 + F.get(d, i + 1) * 4 + F.get(d, i + 2) + 1, F.lit(1))
        digits = F.transform(F.split(t, ""), lambda c: F.ascii(c) - 48)
        return let(digits, lambda d: F.array_join(F.transform(positions(n), lambda i: at(d, i * 3 + frame)), ""))

    coded = lambda t: F.array_join(F.transform(positions(n), lambda i: translate_codon(F.substring(t, i * 3 + frame + 1, F.lit(3)), table)), "")
    up = F.upper(seq)
    return F.when(up.rlike("^[ACGTU]*$"), let(F.translate(up, "TUCAG", "00123"), plain)).otherwise(let(up, coded))


def longest_run(seq: Column) -> Column:
    """Length of the longest run of one letter."""
    step = F.aggregate(
        F.split(seq, ""),
        F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda a, c: let(F.when((c == a.last) & (c != ""), a.run + 1).otherwise(F.when(c != "", 1).otherwise(0)), lambda r: F.struct(c.alias("last"), r.alias("run"), F.greatest(a.best, r).alias("best"))),
    )
    return step.best


def _steps(seq: Column) -> tuple[Column, Column, Column]:
    """Enthalpy in tenths of kcal/mol and entropy in tenths of cal/(K mol), as exact integers, and
    whether the strand pairs with itself. Sums over counts of the 16 steps keep them exact."""
    tenths = lambda k: F.create_map(*[F.lit(x) for s, v in dims.NEAREST.items() for x in (s, round(v[k] * 10))])
    at = positions(F.length(seq) - 1)
    total = lambda k: F.aggregate(at, F.lit(0), lambda a, i: a + F.element_at(tenths(k), F.substring(seq, i + 1, F.lit(2))))
    ends = lambda k: sum((F.when(F.substring(seq, p, 1).isin("G", "C"), round(dims.INIT_GC[k] * 10)).otherwise(round(dims.INIT_AT[k] * 10)) for p in (1, -1)), F.lit(0))
    own = seq == revcomp(seq)
    return total(0) + ends(0), total(1) + ends(1), own


def melting(seq: Column, oligo_nm: float = dims.OLIGO_NM, sodium_mm: float = dims.SODIUM_MM) -> Column:
    """Melting temperature in degrees C; null below two bases or with other letters than ACGTU."""
    up = F.translate(F.upper(seq), "U", "T")

    def tm(s: Column) -> Column:
        h, ds, own = _steps(s)
        ds = ds / 10.0 + F.when(own, dims.SYMMETRY_S).otherwise(0.0) + F.lit(0.368) * (F.length(s) - 1) * F.lit(math.log(sodium_mm / 1000))
        conc = F.when(own, math.log(oligo_nm * 1e-9)).otherwise(math.log(oligo_nm * 1e-9 / 4))
        return F.when((F.length(s) >= 2) & s.rlike("^[ACGT]+$"), h * 100.0 / (ds + F.lit(dims.GAS) * conc) - 273.15)

    return let(up, tm)


def q5_melting(seq: Column) -> Column:
    """Melting temperature for a high-fidelity polymerase's buffer."""
    up = F.translate(F.upper(seq), "U", "T")
    ln = math.log(dims.Q5_SODIUM)

    def tm(s: Column) -> Column:
        h, ds, own = _steps(s)
        molar = h * 100.0 / (ds / 10.0 + F.when(own, dims.SYMMETRY_S).otherwise(0.0) + F.lit(dims.GAS * math.log(dims.Q5_OLIGO)))
        salt = ((F.lit(4.29) * gc_fraction(s) - 3.95) * ln + 0.94 * ln * ln) * 1e-5
        return F.when((F.length(s) >= 2) & s.rlike("^[ACGT]+$"), 1 / (1 / molar + salt) - 273.15)

    return let(up, tm)


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def iupac_class(pattern: str) -> str:
    """A regular expression that a sequence matches position by position: a base matches a code
    when the bases it stands for are among the code's."""
    out = []
    for code in pattern.upper():
        allowed = set(dims.IUPAC[code])
        out.append("[" + "".join(sorted(k for k, v in dims.IUPAC.items() if set(v) <= allowed)) + "]")
    return "".join(out)


def mott_trim(quality: Column, cutoff: float = 0.05) -> Column:
    """struct<start, end>: the stretch of highest summed (cutoff - error probability)."""
    zero = F.struct(F.lit(0.0).alias("best"), F.lit(0).alias("bs"), F.lit(0).alias("be"), F.lit(0.0).alias("sum"), F.lit(0).alias("start"), F.lit(0).alias("i"))

    def step(a: Column, q: Column) -> Column:
        def after(s: Column) -> Column:
            return F.struct(
                F.when((s > 0) & (s > a.best), s).otherwise(a.best).alias("best"),
                F.when((s > 0) & (s > a.best), a.start).otherwise(a.bs).alias("bs"),
                F.when((s > 0) & (s > a.best), a.i + 1).otherwise(a.be).alias("be"),
                F.when(s <= 0, 0.0).otherwise(s).alias("sum"),
                F.when(s <= 0, a.i + 1).otherwise(a.start).alias("start"),
                (a.i + 1).alias("i"),
            )

        return let(a["sum"] + F.lit(cutoff) - F.pow(F.lit(10.0), -q / 10.0), after)

    return F.aggregate(quality, zero, step, lambda a: F.struct(a.bs.alias("start"), a.be.alias("end")))


def phred(text: Column, offset: int = 33) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)


def base64url(raw: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(raw), "+/", "-_"), "=+$", "")


def seguid(seq: Column) -> Column:
    """SHA-1 of the sequence, base64url without padding."""
    return base64url(F.unhex(F.sha1(F.upper(seq))))


def least_rotation(text: str) -> str:
    """The least of a text's rotations, in linear time: two candidates are compared letter by letter,
    and the one that loses moves past all that was compared."""
    n, i, j, k = len(text), 0, 1, 0
    while j < n and i < n and k < n:
        a, b = text[(i + k) % n], text[(j + k) % n]
        if a == b:
            k += 1
            continue
        if a > b:
            i += k + 1
        else:
            j += k + 1
        j += i == j
        k = 0
    at = min(i, j)
    return text[at:] + text[:at]


def minimal_rotation(seq: Column) -> Column:
    """The least of a circle's rotations."""

    @F.pandas_udf("string")
    def rotated(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else least_rotation(t))

    return rotated(seq)
