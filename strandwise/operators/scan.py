"""Pattern scans over many molecules: motifs, cut sites, guides, k-mers.

A scan is one pass of numpy over Arrow batches. Molecules are laid side by side, circles with their
first bases again behind them, long ones in overlapping pieces of ``PIECE`` bases, so that time and
memory grow with the bases and a 5 Mb circle costs no more per base than many short lines. A base
is a set of four bits (IUPAC); it matches a pattern's position when its set lies within the
pattern's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise import dims

PIECE = 1 << 18
WORDS = 1 << 18
ANCHOR = 6

MASKS = np.zeros(256, dtype=np.uint8)
for _code, _bases in dims.IUPAC.items():
    for _c in (_code, _code.lower()):
        MASKS[ord(_c)] = sum(1 << "ACGT".index(b) for b in _bases)
DIGITS = np.full(16, 255, dtype=np.uint8)
DIGITS[[1, 2, 4, 8]] = range(4)
TURNED = np.arange(256, dtype=np.uint8)
TURNED[np.frombuffer(dims.COMPLEMENT_FROM.encode(), np.uint8)] = np.frombuffer(dims.COMPLEMENT_TO.encode(), np.uint8)


def extended(seq: Column, topology: Column, extra: int) -> Column:
    """A circle's text with its first bases again, so that matches may pass the origin."""
    return F.when(topology == "circular", F.concat(seq, F.substring(seq, 1, extra))).otherwise(seq)


@dataclass
class Laid:
    """Pieces of molecules in one buffer, a zero byte after each.

    low: where each piece starts in the buffer; row, base: the molecule (row of the batch) it is of
    and where in it the piece starts; size, circle: the molecule's length and topology."""

    buf: np.ndarray
    low: np.ndarray
    row: np.ndarray
    base: np.ndarray
    size: np.ndarray
    circle: np.ndarray

    def places(self, at: np.ndarray, width: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the buffer places ``at`` are starts of a window of that width in a molecule, and
        for those the row and the position. What lies in two pieces counts in the first."""
        piece = np.searchsorted(self.low, at, side="right") - 1
        pos = at - self.low[piece] + self.base[piece]
        n = self.size[piece]
        good = (pos - self.base[piece] < PIECE) & (width <= n) & np.where(self.circle[piece], pos < n, pos + width <= n)
        return good, self.row[piece[good]], pos[good]


def laid(sequences: list[bytes | None], circles: list[bool], extra: int) -> Iterator[Laid]:
    """The molecules of a batch, about PIECE bases at a time; windows reach up to ``extra`` bases past
    their first. A null molecule is empty."""
    held: list[tuple[bytes, int, int, int, bool]] = []
    total = 0

    def out() -> Laid:
        text = [x[0] for x in held]
        low = np.cumsum([0] + [len(t) + 1 for t in text])[:-1]
        row, base, size, circle = (np.array([x[k] for x in held]) for k in (1, 2, 3, 4))
        return Laid(np.frombuffer(b"\0".join(text) + b"\0", np.uint8), low, row, base, size, circle.astype(bool))

    for row, (s, circle) in enumerate(zip(sequences, circles, strict=True)):
        n = len(s or b"")
        if not n:
            continue
        text = s + (s * (extra // n + 1))[:extra] if circle else s
        for base in range(0, n, PIECE):
            held.append((text[base : base + PIECE + extra], row, base, n, circle))
            total += len(held[-1][0])
            if total >= PIECE:
                yield out()
                held, total = [], 0
    if held:
        yield out()


def strings(buf: np.ndarray, at: np.ndarray, size: int, turned: bool | np.ndarray = False) -> pa.Array:
    """The texts ``buf[at : at + size]``, reverse complements where turned."""
    index = at[:, None] + np.arange(size)[None, :]
    text = buf[index]
    if turned is not False:
        other = TURNED[text[:, ::-1]]
        text = np.where(np.broadcast_to(turned, len(at))[:, None], other, text)
    offsets = np.arange(len(at) + 1, dtype=np.int32) * size
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text)))


def codes(masks: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The number in base 4 of each run of ``width`` bases, and whether all of them are plain."""
    digit = DIGITS[masks]
    n = max(0, len(masks) - width + 1)
    number, plain = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for k in range(width):
        d = digit[k : k + n]
        number = (number << 2) | (d & 3)
        plain &= d < 4
    return number, plain


class Patterns:
    """IUPAC patterns to be found together.

    Every pattern has an anchor, the stretch of up to ANCHOR positions that fewest plain words match;
    a table from such words to patterns gives candidates in one look at each base, and the other
    positions are compared on the candidates alone. Windows whose anchor holds ambiguous bases are
    compared position by position."""

    def __init__(self, patterns: list[str]):
        self.sizes = np.array([len(p) for p in patterns], dtype=np.int64)
        self.most = int(self.sizes.max(initial=1))
        self.sets = np.full((len(patterns), self.most), 15, dtype=np.uint8)
        for k, p in enumerate(patterns):
            self.sets[k, : len(p)] = MASKS[np.frombuffer(p.encode(), np.uint8)]
        self.anchor = [_anchor(p) for p in patterns]
        rows: dict[int, list[tuple[int, int]]] = {}
        for k, (p, (a, b)) in enumerate(zip(patterns, self.anchor, strict=True)):
            rows.setdefault(b - a, []).extend((_number(w), k) for w in _words(p[a:b]))
        self.tables = {}
        for width, found in rows.items():
            words, ids = np.array(sorted(found), dtype=np.int64).T
            self.tables[width] = np.searchsorted(words, np.arange(4**width + 1)), ids

    def find(self, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and pattern numbers of all matches in a buffer of base sets."""
        offsets = np.array([a for a, _ in self.anchor], dtype=np.int64)
        places, which = [], []
        for width, (edge, ids) in self.tables.items():
            number, plain = codes(masks, width)
            at = np.flatnonzero(plain & (edge[number + 1] > edge[number]))
            low, many = edge[number[at]], edge[number[at] + 1] - edge[number[at]]
            total = np.cumsum(many)
            k = ids[np.repeat(low - total + many, many) + np.arange(int(many.sum()))]
            places.append(np.repeat(at, many) - offsets[k])
            which.append(k)
        odd = np.flatnonzero((DIGITS[masks] > 3) & (masks > 0))
        for k, (a, b) in enumerate(self.anchor if len(odd) else []):
            at = np.unique((odd[:, None] - np.arange(a, b)[None, :]).ravel())
            places.append(at)
            which.append(np.full(len(at), k))
        at, k = np.concatenate(places), np.concatenate(which)
        good = (at >= 0) & (at + self.sizes[k] <= len(masks))
        at, k = at[good], k[good]
        for j in range(self.most):
            inside = j < self.sizes[k]
            base = masks[np.where(inside, at + j, 0)]
            good = ~inside | ((base > 0) & ((base & ~self.sets[k, j]) == 0))
            at, k = at[good], k[good]
        return at, k


def _number(word: str) -> int:
    out = 0
    for c in word:
        out = out * 4 + "ACGT".index(c)
    return out


def _words(pattern: str) -> list[str]:
    out = [""]
    for code in pattern.upper():
        out = [w + b for w in out for b in dims.IUPAC[code]]
    return out


def _anchor(pattern: str) -> tuple[int, int]:
    """The stretch of at most ANCHOR positions with the fewest plain words."""
    width = min(ANCHOR, len(pattern))
    count = lambda p: int(np.prod([len(dims.IUPAC[c]) for c in p.upper()]))
    best = min(range(len(pattern) - width + 1), key=lambda k: count(pattern[k : k + width]))
    return best, best + width


def mapped(df: DataFrame, keep: list[str], extra: int, columns: str, found) -> DataFrame:
    """keep and the columns that ``found(piece)`` gives: an iterator of (rows, *arrays)."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [*keep, *(c.split()[0].strip("`") for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, sequence, topology = batch.columns
            circles = [t == "circular" for t in topology.to_pylist()]
            for piece in laid(sequence.cast(pa.binary()).to_pylist(), circles, extra):
                for rows, *arrays in found(piece):
                    index = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([*(c.take(index) for c in own), *(a if isinstance(a, pa.Array) else pa.array(a) for a in arrays)], names=names)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), columns])
    return df.select(*keep, F.col("sequence").alias("sequence_"), F.col("topology").alias("topology_")).mapInArrow(run, schema)


def windows(df: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """keep, pos, word: every window of a molecule (columns sequence, topology); on a circle one for
    each base. A window longer than the molecule is none."""

    def found(piece: Laid):
        for low in range(0, len(piece.buf), WORDS):
            at = np.arange(low, min(low + WORDS, len(piece.buf) - size + 1))
            good, rows, pos = piece.places(at, size)
            yield rows, pos.astype(np.int32), strings(piece.buf, at[good], size)

    return mapped(df, keep, size - 1, "pos int, word string", found)


def motif(df: DataFrame, pattern: str, keep: list[str]) -> DataFrame:
    """keep, start, strand: matches of an IUPAC pattern on both strands, in forward coordinates.
    A pattern that is its own reverse complement is reported forward only."""
    ways = [pattern] + ([] if dims.revcomp(pattern) == pattern else [dims.revcomp(pattern)])
    wanted, names = Patterns(ways), pa.array(["forward", "reverse"])

    def found(piece: Laid):
        at, k = wanted.find(MASKS[piece.buf])
        good, rows, pos = piece.places(at, len(pattern))
        yield rows, pos.astype(np.int32), names.take(pa.array(k[good]))

    return mapped(df, keep, len(pattern) - 1, "start int, strand string", found)


def cut_sites(mol: DataFrame, enzymes: DataFrame, length_col: str = "length") -> DataFrame:
    """seq_id, enzyme, strand, site_start, cut, cut_bottom for every enzyme, in one pass over the
    molecules for all of them. The catalogue is closed over by the tasks; it is bounded by its own
    size, not by the data. On a line, cuts that fall outside the molecule are left out."""
    uses = []
    for e in enzymes.collect():
        n = len(e.site)
        uses.append((e.site, e.name, "forward", e.cut_top, e.cut_bottom))
        if not e.palindromic:
            uses.append((dims.revcomp(e.site), e.name, "reverse", n - e.cut_bottom, n - e.cut_top))
    if not uses:
        raise ValueError("no enzymes")
    wanted = Patterns([u[0] for u in uses])
    names, strands = pa.array([u[1] for u in uses]), pa.array([u[2] for u in uses])
    top, bottom = (np.array([u[k] for u in uses], dtype=np.int64) for k in (3, 4))

    def found(piece: Laid):
        at, k = wanted.find(MASKS[piece.buf])
        good, rows, pos = piece.places(at, wanted.sizes[k])
        k, which = k[good], np.searchsorted(piece.low, at[good], side="right") - 1
        n, circle = piece.size[which], piece.circle[which]
        cuts = [np.where(circle, (pos + x[k]) % n, pos + x[k]) for x in (top, bottom)]
        on = circle | ((cuts[0] >= 0) & (cuts[0] <= n) & (cuts[1] >= 0) & (cuts[1] <= n))
        k = pa.array(k[on])
        yield rows[on], names.take(k), strands.take(k), pos[on].astype(np.int32), *(c[on].astype(np.int32) for c in cuts)

    return mapped(mol.select("seq_id", "sequence", "topology"), ["seq_id"], wanted.most - 1, "enzyme string, strand string, site_start int, cut int, cut_bottom int", found)


def guides(mol: DataFrame, pam: str = "NGG", spacer: int = 20, pam_first: bool = False) -> DataFrame:
    """seq_id, strand, start, spacer, pam, gc: guides on both strands, their PAM behind the spacer or,
    pam_first, before it; start is the spacer's in forward coordinates. Spacers with ambiguous bases
    are none."""
    size = spacer + len(pam)
    left = pam if pam_first else "N" * spacer + pam  # the window as it reads on its own strand
    left = pam + "N" * spacer if pam_first else left
    wanted, names = Patterns([left, dims.revcomp(left)]), pa.array(["forward", "reverse"])
    own = len(pam) if pam_first else 0  # where the spacer starts in the window
    plain = np.zeros(256, dtype=bool)
    plain[np.frombuffer(b"ACGTacgt", np.uint8)] = True
    upper = np.arange(256, dtype=np.uint8)
    upper[97:123] -= 32

    def found(piece: Laid):
        at, k = wanted.find(MASKS[piece.buf])
        good, rows, pos = piece.places(at, size)
        at, turned = at[good], k[good] == 1
        low = np.where(turned, size - own - spacer, own)
        odd = np.concatenate([[0], np.cumsum(~plain[piece.buf])])
        full = odd[at + low + spacer] == odd[at + low]
        at, turned, rows, pos, low = at[full], turned[full], rows[full], pos[full], low[full]
        which = np.searchsorted(piece.low, at, side="right") - 1
        start = np.where(piece.circle[which], (pos + low) % piece.size[which], pos + low)
        text = upper[piece.buf]
        gc = np.concatenate([[0], np.cumsum((text == 71) | (text == 67))])
        beside = np.where(turned, size - len(pam) if pam_first else 0, 0 if pam_first else spacer)
        yield rows, names.take(pa.array(turned.astype(np.int64))), start.astype(np.int32), strings(text, at + low, spacer, turned), strings(text, at + beside, len(pam), turned), (gc[at + low + spacer] - gc[at + low]).astype(np.int32)

    return mapped(mol, ["seq_id"], size - 1, "strand string, start int, spacer string, pam string, gc int", found)


def packed(spacer: Column) -> Column:
    """Bases of a plain sequence of up to 31 as two bits each of a bigint."""
    return F.conv(F.translate(spacer, "ACGT", "0123"), 4, 10).cast("bigint")


def unpacked(x: Column, size: int) -> Column:
    """The bases of a packed sequence of ``size``."""
    return F.translate(F.lpad(F.conv(x.cast("string"), 10, 4), size, "0"), "0123", "ACGT")


def near_spacers(query: DataFrame, background: DataFrame, mismatches: int = 3, size: int = 20) -> DataFrame:
    """(spacer, other, copies, apart): distinct spacers of the background, and how often each occurs,
    that differ from a query spacer in at most ``mismatches`` places.

    Pigeonhole: cut into mismatches + 3 pieces, three of them are equal, so candidates are an
    equi-join on (which three, their bases), about half a spacer, compared as packed integers; a
    pair is kept under its first three equal pieces only. Only the packed bases and the key, the
    pieces with their number above them, are shuffled; what else a row has is joined to the pairs.
    Spacers are of plain upper-case bases, ``size`` of them (28 at most).
    """
    pieces = mismatches + 3
    bounds = [(k * size // pieces, (k + 1) * size // pieces) for k in range(pieces)]
    combos = list(combinations(range(pieces), 3))
    mask = lambda ks: sum(((1 << 2 * (bounds[k][1] - bounds[k][0])) - 1) << 2 * (size - bounds[k][1]) for k in ks)
    bit = 2 * size
    keyed = lambda df, c: df.select(c, F.explode(F.array(*[F.col(c).bitwiseAND(F.lit(mask(ks))).bitwiseOR(F.lit(n << bit)) for n, ks in enumerate(combos)])).alias("key"))
    b = background.groupBy(packed(F.col("spacer")).alias("y")).agg(F.count("*").alias("copies"))
    # a set against itself is keyed and shuffled once
    q = keyed(b, "y").select(F.col("y").alias("x"), "key") if query is background else keyed(query.select(packed(F.col("spacer")).alias("x")).distinct(), "x")
    xor = F.col("x").bitwiseXOR(F.col("y"))
    apart = F.bit_count(xor.bitwiseOR(F.shiftright(xor, 1)).bitwiseAND(F.lit(int("01" * size, 2))))
    # no equal piece before the last of the three but those three themselves
    earlier = F.array(*[F.array(*[F.lit(mask([k])) for k in range(c[2]) if k not in c]).cast("array<bigint>") for c in combos])
    first = F.forall(F.get(earlier, F.shiftright("key", bit).cast("int")), lambda m: xor.bitwiseAND(m) != 0)
    pairs = q.join(keyed(b, "y").hint("merge"), "key").where(apart <= mismatches).where(first).select("x", "y", apart.alias("apart"))
    return pairs.join(b.hint("merge"), "y").select(unpacked(F.col("x"), size).alias("spacer"), unpacked(F.col("y"), size).alias("other"), "copies", "apart")


def off_targets(query: DataFrame, background: DataFrame, mismatches: int = 3) -> DataFrame:
    """(spacer, n): places of the background within the mismatches."""
    return near_spacers(query, background, mismatches).groupBy("spacer").agg(F.sum("copies").alias("n"))


def kmers(mol: DataFrame, k: int) -> DataFrame:
    """seq_id, kmer: the distinct k-mers of each molecule."""
    return windows(mol, k, ["seq_id"]).select("seq_id", F.col("word").alias("kmer")).distinct()


def kmer_sets(mol: DataFrame, k: int) -> DataFrame:
    """seq_id, kmers: the different k-mers of each molecule as one array of numbers, equal for equal
    words of up to eight letters. A molecule's array has 4 ** k plain words at most."""
    if not 1 <= k <= 8:
        raise ValueError("words of one to eight letters")

    def found(piece: Laid):
        padded = np.concatenate([piece.buf, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(piece.buf), dtype="<i8", buffer=padded, strides=(1,))
        at = np.arange(len(piece.buf) - k + 1)
        good, rows, _ = piece.places(at, k)
        both = np.unique(np.stack([rows, eight[at[good]] & ((1 << 8 * k) - 1 if k < 8 else -1)], axis=1), axis=0)
        lead = np.flatnonzero(np.diff(both[:, 0], prepend=-1))
        yield both[lead, 0], pa.ListArray.from_arrays(pa.array(np.append(lead, len(both)), pa.int32()), pa.array(both[:, 1]))

    pieces = mapped(mol, ["seq_id"], k - 1, "kmers array<bigint>", found)
    return pieces.groupBy("seq_id").agg(F.array_distinct(F.flatten(F.collect_list("kmers"))).alias("kmers"))
