"""Where primers pair with molecules, and what pairs of primers amplify.

A primer pairs at its last bases exactly (the anchor) and with few mismatches before them. The part
before the anchor is cut into mismatches + 1 pieces, one of which is then equal as well, so a site's
keys are (piece, anchor and piece). A bit for each possible key tells the scan which places are worth
a row: its size follows from the key's width, not from the primers. The rest is an equi-join on keys
and a comparison of packed integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.operators.scan import DIGITS, MASKS, Laid, mapped, packed

KEY = 10


def _pieces(size: int, anchor: int, mismatches: int) -> list[tuple[int, int]]:
    """(bits to the right, bases) of the pieces of a primer of ``size`` bases before its anchor."""
    head, n = size - anchor, mismatches + 1
    edges = [k * head // n for k in range(n + 1)]
    return [(size - b, min(b - a, KEY - anchor)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _keys(x, size: int, anchor: int, mismatches: int) -> list:
    """Keys of a packed primer or site (a bigint column or int64 array)."""
    out = []
    for right, bases in _pieces(size, anchor, mismatches):
        low, mask = (1 << 2 * anchor) - 1, (1 << 2 * bases) - 1
        if isinstance(x, Column):
            out.append(F.shiftleft(F.shiftright(x, 2 * right).bitwiseAND(F.lit(mask)), 2 * anchor).bitwiseOR(x.bitwiseAND(F.lit(low))))
        else:
            out.append((((x >> (2 * right)) & mask) << (2 * anchor)) | (x & low))
    return out


def anneal_sites(mol: DataFrame, primers: DataFrame, anchor: int = 5, mismatches: int = 2, keep: tuple[str, ...] = ("seq_id",)) -> DataFrame:
    """keep, primer_id, strand, start, size, mismatches: places where a primer (primer_id, sequence)
    pairs. A forward site reads as the primer does, a reverse one as its reverse complement; start is
    in forward coordinates. Primers of under ``anchor`` + mismatches + 1 or over 31 bases, or with
    other letters than ACGT, pair nowhere; so do windows with ambiguous bases."""
    own = primers.select("primer_id", F.upper("sequence").alias("text")).where(F.col("text").rlike("^[ACGT]+$") & F.length("text").between(anchor + mismatches + 1, 31))
    sizes = sorted(r[0] for r in own.select(F.length("text")).distinct().collect())  # 31 at most
    out = None
    for size in sizes:
        p = own.where(F.length("text") == size).select("primer_id", packed(F.col("text")).alias("x"))
        p = p.select("primer_id", "x", F.posexplode(F.array(*_keys(F.col("x"), size, anchor, mismatches))).alias("k", "key"))
        part = _sites(mol, p, size, anchor, mismatches, list(keep))
        out = part if out is None else out.unionByName(part)
    if out is None:
        kinds = dict(mol.dtypes)
        return mol.sparkSession.createDataFrame([], ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"primer_id {dict(primers.dtypes)['primer_id']}", "strand string, start int, size int, mismatches int"]))
    return out


def _sites(mol: DataFrame, p: DataFrame, size: int, anchor: int, mismatches: int, keep: list[str]) -> DataFrame:
    pieces = _pieces(size, anchor, mismatches)
    wanted = [np.zeros(4 ** (anchor + bases), dtype=bool) for _, bases in pieces]
    for r in p.select("k", "key").distinct().collect():  # as many as there are keys: (mismatches + 1) * 4 ** KEY
        wanted[r.k][r.key] = True
    held = mol.sparkSession.sparkContext.broadcast([np.packbits(w) for w in wanted])
    strands = pa.array(["forward", "reverse"])

    def found(piece: Laid):
        bits = [np.unpackbits(b).astype(bool) for b in held.value]
        digit = DIGITS[MASKS[piece.buf]]
        n = max(0, len(digit) - size + 1)
        plain, ways = np.ones(n, dtype=bool), [np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)]
        for k in range(size):
            d = digit[k : k + n]
            plain &= d < 4
            d = (d & 3).astype(np.int64)
            ways[0] = (ways[0] << 2) | d
            ways[1] |= (3 - d) << (2 * k)
        for s, x in enumerate(ways):
            for k, key in enumerate(_keys(x, size, anchor, mismatches)):
                at = np.flatnonzero(bits[k][key] & plain)
                good, rows, pos = piece.places(at, size)
                at = at[good]
                yield rows, pa.array(np.full(len(at), k, dtype=np.int32)), key[at], strands.take(pa.array(np.full(len(at), s))), pos.astype(np.int32), x[at]

    sites = mapped(mol, keep, size - 1, "k int, key bigint, strand string, start int, y bigint", found)
    xor = F.col("x").bitwiseXOR(F.col("y"))
    apart = F.bit_count(xor.bitwiseOR(F.shiftright(xor, 1)).bitwiseAND(F.lit(int("01" * size, 2))))
    masks = F.array(*[F.lit(((1 << 2 * bases) - 1) << 2 * right) for right, bases in pieces])
    first = F.forall(F.slice(masks, 1, F.col("k")), lambda m: xor.bitwiseAND(m) != 0)  # no earlier piece is equal
    hit = sites.join(p, ["k", "key"]).withColumn("mismatches", apart.cast("int")).where(F.col("mismatches") <= mismatches).where(first)
    return hit.select(*keep, "primer_id", "strand", "start", F.lit(size).alias("size"), "mismatches")


def amplicons(sites: DataFrame, key: str = "seq_id", reach: int | None = None) -> DataFrame:
    """key, forward_id, reverse_id, start, size, mismatches: what a forward and a reverse site of one
    molecule amplify, primers included. sites: key, topology, length, primer_id, strand, start, size,
    mismatches. On a line the reverse site ends behind the forward one's start and holds no less than
    the longer primer; on a circle it may stand before it, then the product passes the origin.
    ``reach`` bounds a product's size; then sites only meet those in the same or the next stretch of
    that many bases, not all of their molecule."""
    f = sites.where("strand = 'forward'").select(key, "topology", "length", F.col("primer_id").alias("forward_id"), "start", F.col("size").alias("fs"), F.col("mismatches").alias("fm"))
    r = sites.where("strand = 'reverse'").select(key, F.col("primer_id").alias("reverse_id"), F.col("start").alias("at"), F.col("size").alias("rs"), F.col("mismatches").alias("rm"))
    ahead = F.col("at") + F.col("rs") - F.col("start")
    fits = (F.col("at") >= F.col("start")) & (ahead >= F.greatest("fs", "rs"))
    size = F.when(fits, ahead).when((F.col("topology") == "circular") & (F.col("at") < F.col("start")), ahead + F.col("length"))
    if reach is None:
        out = f.join(r, key).withColumn("product", size).where(F.col("product").isNotNull())
    else:
        bin_ = lambda place: F.floor(place / reach)
        f = f.withColumn("bin", F.explode(F.array(bin_(F.col("start")), bin_(F.col("start")) + 1)))
        n = r.join(sites.select(key, F.col("topology").alias("topology_"), F.col("length").alias("length_")).distinct(), key)
        turns = F.when(F.col("topology_") == "circular", F.array(bin_(F.col("at")), bin_(F.col("at") + F.col("length_")))).otherwise(F.array(bin_(F.col("at"))))
        r = n.select(key, "reverse_id", "at", "rs", "rm", F.explode(F.array_distinct(turns)).alias("bin"))
        place = F.when(fits, F.col("at")).otherwise(F.col("at") + F.col("length"))  # a pair counts in its own bin only
        out = f.join(r, [key, "bin"]).withColumn("product", size).where(F.col("product").isNotNull() & (F.col("product") <= reach) & (bin_(place) == F.col("bin")))
    return out.select(key, "forward_id", "reverse_id", "start", F.col("product").cast("int").alias("size"), (F.col("fm") + F.col("rm")).alias("mismatches"))


def best_products(products: DataFrame, key: str = "seq_id", most: int = 12) -> DataFrame:
    """The ``most`` products of each molecule by mismatches, size and start, with their rank."""
    w = Window.partitionBy(key).orderBy("mismatches", "size", "start", "forward_id", "reverse_id")
    return products.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
