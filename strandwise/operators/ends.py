"""Fragments with the ends that cuts leave, their ligation, and assemblies by homology or overhangs.

An end's overhang is written along the top strand, so a right and a left end join when kind and
overhang are equal. A tube's pieces are few: what walks over them takes one tube at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise import dims
from strandwise.functions.seq import revcomp
from strandwise.operators.scan import cut_sites


def _cut(text: str, circular: bool, cuts: list[tuple[int, int]]) -> list[tuple]:
    """The fragments of one molecule: start, end, both ends' kinds and overhangs, top strand. cuts: top
    and bottom positions, ascending."""
    n = len(text)
    round_ = text + text if circular else text
    ends = []
    for cut, bottom in cuts:
        d = bottom - cut
        if circular:
            d = (d + n // 2) % n - n // 2
        low = cut if d >= 0 else cut + d
        low = low % n if circular else max(low, 0)
        ends.append((cut, "blunt" if d == 0 else "five_prime" if d > 0 else "three_prime", round_[low : low + abs(d)]))
    if circular:
        ends += [(ends[0][0] + n, *ends[0][1:])] if ends else []
    else:
        ends = [(0, "end", ""), *ends, (n, "end", "")]
    return [(a[0], b[0], *a[1:], *b[1:], round_[a[0] : b[0]]) for a, b in zip(ends, ends[1:], strict=False)]


def cut_fragments(mol: DataFrame, cuts: DataFrame) -> DataFrame:
    """seq_id, start, end, left_kind, left_overhang, right_kind, right_overhang, sequence: what a
    complete digest leaves, top strand from cut to cut. mol: seq_id, topology, length, sequence; cuts:
    seq_id, cut, cut_bottom. Ends of a line that no cut made are 'end'. Where two cuts fall on one top
    position the one with the smaller bottom cut counts. Uncut circles leave no fragment.

    A molecule meets all its cuts in one row, so its text is moved once, however often it is cut."""
    own = cuts.where("cut IS NOT NULL AND cut_bottom IS NOT NULL").groupBy("seq_id", F.col("cut").cast("bigint").alias("cut")).agg(F.min(F.col("cut_bottom").cast("bigint")).alias("bottom"))
    own = own.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("cut", "bottom"))).alias("cuts"))
    rows = mol.where("length > 0 AND sequence IS NOT NULL").select("seq_id", "topology", "sequence").join(own, "seq_id", "left")
    names = ["seq_id", "start", "end", "left_kind", "left_overhang", "right_kind", "right_overhang", "sequence"]
    types = [pa.int64(), pa.int64(), *[pa.string()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                at, out = [], []
                for x, (topology, text, held) in enumerate(zip(*(part.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                    circular = topology == "circular"
                    found = _cut(text, circular, [(c["cut"], c["bottom"]) for c in held or [] if circular or 0 < c["cut"] < len(text)])
                    out += found
                    at += [x] * len(found)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[c] for r in out], t) for c, t in enumerate(types))], names=names)

    return rows.mapInArrow(run, f"seq_id {dict(rows.dtypes)['seq_id']}, start bigint, end bigint, left_kind string, left_overhang string, right_kind string, right_overhang string, sequence string")


def junctions(fragments: DataFrame, key: str = "seq_id", tube: str = "tube") -> DataFrame:
    """Pairs (tube, key, start, other, other_start) of a fragment and one of the same tube whose left end
    its right end joins:
    equal kind and overhang (plain bases: an equi-join), no outer end of a line, no fragment with two
    phosphate-free ends (column dephosphorylated, if there is one)."""
    bare = F.col("dephosphorylated") if "dephosphorylated" in fragments.columns else F.lit(False)
    f = fragments.withColumn("bare_", F.coalesce(bare, F.lit(False)))
    a = f.where("right_kind <> 'end'").select(tube, key, "start", F.col("right_kind").alias("kind"), F.col("right_overhang").alias("overhang"), F.col("bare_").alias("x"))
    b = f.where("left_kind <> 'end'").select(tube, F.col(key).alias("other"), F.col("start").alias("other_start"), F.col("left_kind").alias("kind"), F.col("left_overhang").alias("overhang"), F.col("bare_").alias("y"))
    return a.join(b, [tube, "kind", "overhang"]).where("NOT (x AND y)").select(tube, key, "start", "other", "other_start")


def terminal_overlap(a: str, b: str, least: int, most: int | None = None) -> int:
    """Bases of the longest suffix of a that is a prefix of b, from ``least`` to ``most``; 0: none.
    Candidates are where b's first ``least`` bases occur in a's end."""
    limit = min(len(a), len(b)) if most is None else min(len(a), len(b), most)
    at = a.find(b[:least], len(a) - limit) if limit >= least else -1
    while at >= 0:
        if b.startswith(a[at:]):
            return len(a) - at
        at = a.find(b[:least], at + 1)
    return 0


def _gibson(parts: list[str], least: int, circular: bool) -> tuple[str | None, str]:
    parts = [p.upper() for p in parts]
    if not parts:
        return None, "no parts"
    product = parts[0]
    for k, part in enumerate(parts[1:], 1):
        n = terminal_overlap(product, part, least)
        if not n:
            return None, f"no homology between parts {k} and {k + 1}"
        product += part[n:]
    if circular:
        n = terminal_overlap(product, parts[0], least) if len(parts) > 1 else terminal_overlap(product, product[: len(product) // 2], least)
        if not n or n == len(product):
            return None, "the ends do not close"
        product = product[:-n]
    return product, ""


def homology_products(parts: DataFrame, key: str, order: str, least: int = 15, circular: bool = True) -> DataFrame:
    """key, product, problem: each tube's parts (order, sequence) joined in order by their homologous
    ends; a circle closes on its first part. A tube without a product says why."""

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        product, problem = _gibson([s or "" for s in rows["sequence"]], least, circular)
        return pd.DataFrame({key: rows[key].iloc[:1], "product": [product], "problem": [problem]})

    kind = dict(parts.dtypes)[key]
    return parts.select(key, order, "sequence").groupBy(key).applyInPandas(join, f"`{key}` {kind}, product string, problem string")


def golden_gate(pieces: list[tuple[int, str, str, str]]) -> tuple[list[tuple[int, bool]], str, str]:
    """The order of pieces (id, left overhang, right overhang, body with its left overhang) of a
    one-tube assembly, each with whether it is turned round; the circle; and a problem.

    The walk starts with the first piece as it is; at every step exactly one unused piece, either way
    round, must fit; all must be used and the last must close on the first."""
    if not pieces:
        return [], "", "no pieces"
    ways = {i: ((left, right, body), (dims.revcomp(right), dims.revcomp(left), dims.revcomp(body[len(left) :] + right))) for i, left, right, body in pieces}
    first = pieces[0][0]
    order, product, at = [(first, False)], pieces[0][3], pieces[0][2]
    left = [p[0] for p in pieces[1:]]
    while left:
        fits = [(i, turned) for i in left for turned in (False, True) if ways[i][turned][0] == at]
        if not fits:
            return order, "", "nothing fits"
        if len(fits) > 1:
            return order, "", "more than one fits"
        i, turned = fits[0]
        order.append((i, turned))
        product, at = product + ways[i][turned][2], ways[i][turned][1]
        left.remove(i)
    if at != pieces[0][1]:
        return order, "", "the ends do not close"
    return order, product, ""


def golden_gate_products(pieces: DataFrame, key: str) -> DataFrame:
    """key, order, product, problem for tubes of pieces (key, piece_id, left, right, body), by id."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("piece_id")
        order, product, problem = golden_gate(list(zip(rows["piece_id"], rows["left"], rows["right"], rows["body"], strict=True)))
        text = "-".join(f"{i}{'r' if t else ''}" for i, t in order)
        return pd.DataFrame({key: rows[key].iloc[:1], "order": [text], "product": [product], "problem": [problem]})

    kind = dict(pieces.dtypes)[key]
    return pieces.select(key, "piece_id", "left", "right", "body").groupBy(key).applyInPandas(walk, f"`{key}` {kind}, `order` string, product string, problem string")


def golden_gate_digest(donors: DataFrame, enzyme: str = "BsaI") -> DataFrame:
    """tube, order, product, problem: donors (tube, seq_id: its own in the whole table, topology, length,
    sequence) cut by a type IIS enzyme and joined in one tube. Fragments that still hold its site are
    cut again and again in the tube and take no part, nor do those with an outer or blunt end; the others
    are numbered by seq_id and start. Tubes without such fragments have no row."""
    row = next(e for e in dims.ENZYMES if e[0] == enzyme)
    cuts = cut_sites(donors, dims.enzymes(donors.sparkSession, [row])).select("seq_id", "cut", "cut_bottom")
    f = cut_fragments(donors, cuts).where("left_kind = 'five_prime' AND right_kind = 'five_prime'")
    text = F.upper("sequence")
    f = f.where(~text.contains(row[1]) & ~text.contains(dims.revcomp(row[1])))
    f = f.join(donors.select("seq_id", "tube"), "seq_id").withColumn("piece_id", F.row_number().over(Window.partitionBy("tube").orderBy("seq_id", "start")) - 1)
    pieces = f.select("tube", "piece_id", F.upper("left_overhang").alias("left"), F.upper("right_overhang").alias("right"), text.alias("body"))
    return golden_gate_products(pieces, "tube")


def turned_fragment(fragments: DataFrame) -> DataFrame:
    """Fragments read from the other strand: ends exchanged, overhangs and bases turned. The new top
    strand covers what the old bottom strand did."""
    kinds = F.col("left_kind"), F.col("right_kind")
    left, right = F.col("left_overhang"), F.col("right_overhang")
    body = F.col("sequence")
    # the bottom strand: a five-prime overhang of the left end is the top strand's own, a right one is not
    body = F.when(kinds[0] == "five_prime", F.substring(body, F.length(left) + 1, F.length(body))).otherwise(F.when(kinds[0] == "three_prime", F.concat(left, body)).otherwise(body))
    body = F.when(kinds[1] == "five_prime", F.concat(body, right)).otherwise(F.when(kinds[1] == "three_prime", F.substring(body, F.lit(1), F.length(body) - F.length(right))).otherwise(body))
    rest = [c for c in fragments.columns if c not in ("left_kind", "left_overhang", "right_kind", "right_overhang", "sequence")]
    return fragments.select(*rest, kinds[1].alias("left_kind"), revcomp(right).alias("left_overhang"), kinds[0].alias("right_kind"), revcomp(left).alias("right_overhang"), revcomp(body).alias("sequence"))
