"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, units and names become typed placeholders, so a question with other numbers in it keeps
its template. Windows of template words are hashed and joined with the benchmark's. A match counts
only where its slots are consistent: along one alignment of a document and an item, every value in
the item's slots stands for one value in the document's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.llm.cluster import fresh, let

WINDOW, SHORTEST = 8, 4
COVERAGE = 0.5
BROADCAST_BYTES = 64 << 20
NUMBER, NAME, UNIT = "\u0001", "\u0002", "\u0003"
UNITS = "kg|mg|g|lb|lbs|oz|km|cm|mm|m|mi|mile|miles|meter|meters|metre|metres|inch|inches|foot|feet|yard|yards|l|ml|liter|liters|litre|litres|s|sec|second|seconds|min|minute|minutes|h|hour|hours|day|days|week|weeks|month|months|year|years|dollar|dollars|cent|cents|euro|euros|usd|eur|percent|mph|kmh"
#: A capital word within a sentence: after a word in lower case, a number or a comma.
NAME_RULE = r"(?<=[\p{Ll}\p{N},;)] )(\p{Lu}\p{Ll}+)"
UNIT_RULE = rf"(?i)(?<=[0-9])\s?({UNITS})(?![\p{{L}}\p{{N}}])"
NUMBER_RULE = r"([0-9]+(?:[.,:/][0-9]+)*)"
_UPPER = "".join(chr(c) for c in (*range(65, 91), *range(0xC0, 0xDF)) if c != 0xD7)
_DROPPED = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
SLOT = f"[{NUMBER}-{UNIT}]"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")


def marked(text: Column) -> Column:
    """The text with every slot's value marked by its type, ASCII and Latin-1 letters in lower case
    and ASCII punctuation dropped."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), NAME_RULE, NAME + "$1")
    counted = lambda t: F.regexp_replace(F.regexp_replace(t, UNIT_RULE, f" {UNIT}$1"), NUMBER_RULE, NUMBER + "$1")
    return F.translate(let(text, lambda t: F.when(t.rlike("[0-9]"), counted(t)).otherwise(t)), _UPPER + _DROPPED, _UPPER.lower())


def template(text: Column) -> Column:
    """A marked text with each slot's value taken out."""
    return F.regexp_replace(text, f"({SLOT})[^ \\t-\\r]*", "$1")


def _window_hashes(words: Column, window: int, each) -> Column:
    """each(i, hash of the window at word i) for every window. Words are hashed once."""

    def at(h: Column) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: each(i, F.xxhash64(*(F.get(h, i + j) for j in range(window)))))
        return F.when(F.size(h) >= window, found)

    return let(F.transform(words, lambda w: F.xxhash64(w)), at)


def _window_structs(text: Column, window: int) -> Column:
    """array<struct<pos, h, slots>>: place and hash of each window of template words, and the values of its
    slots in order (null where the text has no slot). Null: fewer words than a window."""
    none = F.lit(None).cast("array<string>").alias("slots")
    plain = lambda t: _window_hashes(_words(t), window, lambda i, h: F.struct(i.alias("pos"), h.alias("h"), none))
    held = lambda v, i: F.filter(F.slice(v, i + 1, window), lambda w: w.rlike(f"^{SLOT}")).alias("slots")
    slotted = lambda t: let(_words(t), lambda v: _window_hashes(_words(template(t)), window, lambda i, h: F.struct(i.alias("pos"), h.alias("h"), held(v, i))))
    return let(text, lambda t: F.when(t.rlike(SLOT), slotted(t)).otherwise(plain(t)))


def windows(df: DataFrame, id_col: str, text: str, window: int) -> DataFrame:
    """(id_, pos, h, slots): a row for each window of template words, with its slots' values."""
    # inline rather than explode: taking fields out of exploded structs would compute them once per field
    return df.select(F.col(id_col).cast("bigint").alias("id_"), F.inline(_window_structs(marked(F.col(text)), window)))


def _literal(window: int) -> Column:
    """Whether half of a window's words or more are no slots."""
    return F.coalesce(F.size("slots"), F.lit(0)) * 2 <= window


def item_windows(benchmark: DataFrame, item_col: str, text: str, window: int) -> DataFrame:
    """(item_, ipos, h, islots, exact, n): the windows that stand for an item, of n words: of
    ``window`` words, or the whole template of an item with fewer (but SHORTEST at least). Windows
    of slots for the most part stand only for items that have no others, and then match only with
    their own values (exact)."""
    size = F.size(_words(template(marked(F.col(text)))))
    found = None
    for n in range(min(SHORTEST, window), window + 1):
        own = benchmark.where(size >= n if n == window else size == n)
        part = windows(own, item_col, text, n).select("*", _literal(n).alias("plain"), F.lit(n).alias("n"))
        found = part if found is None else found.unionByName(part)
    found = found.where(F.col("id_").isNotNull()).withColumn("any", F.max("plain").over(Window.partitionBy("id_")))
    return found.where("plain or not any").select(F.col("id_").alias("item_"), F.col("pos").alias("ipos"), "h", F.col("slots").alias("islots"), (~F.col("plain")).alias("exact"), "n")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (id, item id, matched, item_windows, coverage, slots, changed): the documents that hold
    at least ``coverage`` of an item's windows with consistent slots; changed counts the slots whose
    value differs from the item's.

    An item with fewer template words than a window has its whole template as its only window; with
    fewer than SHORTEST it never matches, nor do null texts and rows with a null id. Windows of slots
    for the most part stand only for items without others and match only with the same values. Rows
    that share a document id count as one document, those that share an item id as one item. The
    benchmark's windows are broadcast if they take at most broadcast_bytes, else both sides are
    shuffled by the hash. Empty tables give no rows.
    """
    items = item_windows(benchmark, item_col, item_text_col, window)
    size = items.groupBy("item_").agg(F.countDistinct("ipos").alias("item_windows"))
    lengths = items.groupBy("n").agg(F.sum(48 + F.coalesce(F.length(F.array_join("islots", " ")), F.lit(0)) + 16 * F.coalesce(F.size("islots"), F.lit(0))).alias("bytes")).collect()  # a row for each length
    small = F.broadcast if sum(r.bytes for r in lengths) <= broadcast_bytes else (lambda x: x)
    found = None
    for n in sorted({window} | {r.n for r in lengths}):
        part = windows(docs, id_col, text_col, n).where(F.col("id_").isNotNull()).join(small(items.where(F.col("n") == n)), "h")
        found = part if found is None else found.unionByName(part)
    found = found.where(~F.col("exact") | F.col("islots").eqNullSafe(F.col("slots")))
    pairs = F.coalesce(F.arrays_zip(F.col("islots").alias("i"), F.col("slots").alias("d")), F.array().cast("array<struct<i:string,d:string>>"))
    lined = found.groupBy("id_", "item_", (F.col("pos") - F.col("ipos")).alias("shift")).agg(F.collect_set("ipos").alias("at"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("slots"))
    lined = lined.where(F.size(F.array_distinct(F.transform("slots", lambda x: x.i))) == F.size("slots"))
    whole = lined.groupBy("id_", "item_").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("matched"), F.array_distinct(F.flatten(F.collect_list("slots"))).alias("slots"))
    out = whole.join(small(size), "item_").withColumn("coverage", F.col("matched") / F.col("item_windows")).where(F.col("coverage") >= coverage)
    return out.select(F.col("id_").alias(id_col), F.col("item_").alias(item_col), F.col("matched").cast("bigint").alias("matched"), "item_windows", "coverage", F.size("slots").alias("slots"), F.size(F.filter("slots", lambda x: x.i != x.d)).alias("changed"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without those that ``contaminated`` names; documents with a null id stay."""
    name = fresh(docs.columns, "found")
    found = contaminated(docs, benchmark, id_col, **options).select(F.col(id_col).alias(name)).distinct()
    return docs.join(found, docs[id_col].cast("bigint") == F.col(name), "left_anti")
