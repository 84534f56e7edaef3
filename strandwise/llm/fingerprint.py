"""Threshold-scaled document fingerprints, in DataFrame functions only.

A sketch holds every distinct shingle hash in the lowest ``1/SCALE`` of the hash range, so two
sketches can be united, and compared whatever the texts' lengths: the same hashes are retained on
both sides. A text whose hashes all lie above has an empty sketch; a hash of all its shingles beside it
tells such texts apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.llm.cluster import NO_ID, bucket_of, key_bounds, let, partitions

SCALE = 4
SHINGLE = 5
SPACE = r"[ \t-\r]+"


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-case words of a text (a null text has none)."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def sketch_of(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """struct<kept, whole>: the ascending distinct retained hashes, and where a text has shingles but
    none of them is retained, a hash of all of them. Fewer words than a shingle: one shingle of all
    of them; none: nothing retained, and whole is null."""
    most = -(1 << 63) + (1 << 64) // scale - 1

    def shingles(h: Column) -> Column:
        at = lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(shingle)))
        short = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(h) >= shingle, F.transform(F.sequence(F.lit(0), F.size(h) - shingle), at)).otherwise(short)

    def retained(s: Column) -> Column:
        whole = lambda k: F.when((F.size(k) == 0) & (F.size(s) > 0), F.xxhash64(F.array_sort(F.array_distinct(s))))
        return let(F.filter(s, lambda x: x <= F.lit(most)), lambda k: F.struct(F.array_sort(F.array_distinct(k)).alias("kept"), whole(k).alias("whole")))

    return let(let(word_hashes(text), shingles), retained)


def merge(a: Column, b: Column) -> Column:
    """The retained hashes of two texts together."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: str, b: str) -> Column:
    """Estimated resemblance: shared over all retained hashes. Where neither retains any: 1 if both
    have the same shingles (or none), else 0."""
    both = F.size(F.array_intersect(f"{a}.kept", f"{b}.kept"))
    sizes = F.size(f"{a}.kept") + F.size(f"{b}.kept")
    return F.when(sizes > 0, both / (sizes - both)).otherwise(F.col(f"{a}.whole").eqNullSafe(F.col(f"{b}.whole")).cast("double"))


def containment(a: str, b: str) -> Column:
    """Estimated share of a's shingles that b has too. An a that retains none: 1 if it has no
    shingles or the same ones as b, else 0."""
    none = F.col(f"{a}.whole").isNull() | F.col(f"{a}.whole").eqNullSafe(F.col(f"{b}.whole"))
    return F.when(F.size(f"{a}.kept") > 0, F.size(F.array_intersect(f"{a}.kept", f"{b}.kept")) / F.size(f"{a}.kept")).otherwise(none.cast("double"))


def as_text(sketch: str) -> Column:
    """Retained hashes, 16 digits each; where none is, the hash of all shingles after a tilde."""
    digits = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    none = F.coalesce(F.concat(F.lit("~"), digits(F.col(f"{sketch}.whole"))), F.lit(""))
    return F.when(F.size(f"{sketch}.kept") > 0, F.array_join(F.transform(f"{sketch}.kept", digits), "")).otherwise(none)


def with_next(rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """Adds next_<column>: the value in the next row by id_ (then text); after the last, the first.

    Rows are dealt over ascending key ranges. A range's bounds are ids that occur, so the row that
    follows a range is the first of the next one: it is copied into both. No range holds more than
    its share, and only n - 1 bounds reach the driver.
    """
    low = rows.agg(F.min("id_").alias("m")).head()[0]
    if low is None:
        for c in columns:
            rows = rows.withColumn(f"next_{c}", F.col(c))
        return rows
    bounds = [b for b in key_bounds(rows, "id_", n) if b > low]
    last = len(bounds)
    part = bucket_of("id_", bounds)
    place = lambda p, after: F.struct(p.cast("int").alias("part"), F.lit(after).alias("after"))
    places = [place(part, False), F.when(F.col("id_") == F.lit(low), place(F.lit(last), True))]
    if bounds:
        places.append(F.when(F.col("id_").isin(*bounds), place(part - 1, True)))
    rows = rows.withColumn("at_", F.explode(F.filter(F.array(*places), lambda x: x.isNotNull()))).select("*", "at_.part", "at_.after").drop("at_")
    rows = rows.repartitionById(last + 1, F.col("part"))
    order = Window.partitionBy("part").orderBy("after", "id_", "text")
    for c in columns:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(order))
    return rows.where(~F.col("after")).drop("part", "after")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text and of its edit: its last floor(n/2) code points replaced by the
    first as many (or all) of the next text by id (after the last: the first).

    Returns (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    in_edited, in_next): near_* is resemblance, in_* the share of this text's shingles found there.
    A null text is empty (an empty fingerprint, all likenesses 1 to another empty text and 0 to any
    other); short texts may retain no hash, then only equal shingles count as alike; a null id comes first in the order and back null; equal ids follow each other by text;
    an empty table gives no rows.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("sketch", sketch_of(F.col("text"), shingle, scale))
    rows = with_next(rows, ["text", "sketch"], partitions(docs.sparkSession))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.withColumn("edited_sketch", sketch_of(F.col("edited"), shingle, scale))
    return rows.select(
        F.when(F.col("id_") != F.lit(NO_ID), F.col("id_")).alias(id_col),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("sketch").alias("fingerprint"),
        as_text("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
        containment("sketch", "edited_sketch").alias("in_edited"),
        containment("sketch", "next_sketch").alias("in_next"),
    )
