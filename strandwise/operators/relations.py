"""As-of joins, inverted-index search, unique names, fragments in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, on: str, columns: list[str], at: str) -> DataFrame:
    """left with the columns of the last row of right (key, on: unique) whose ``on`` isn't larger, and
    that row's ``on`` as ``at``; left rows before all of right are left out.

    Both sides run once through a window by key and place, which spills; a key is cut at no point, so
    a key's rows meet in one task, sorted, with one row of state."""
    held = [c for c in left.columns if c not in (key, on)]
    one = left.select(key, F.col(on).cast("bigint").alias(on), F.lit(1).alias("side"), F.struct(*(F.col(c) for c in held)).alias("own"), F.lit(None).cast(_struct(right, columns)).alias("found"))
    two = right.select(key, F.col(on).cast("bigint").alias(on), F.lit(0).alias("side"), F.lit(None).cast(_struct(left, held)).alias("own"), F.struct(F.col(on).cast("bigint").alias("at_"), *(F.col(c) for c in columns)).alias("found"))
    one = one.withColumn("found", F.lit(None).cast(two.schema["found"].dataType))
    two = two.withColumn("own", F.lit(None).cast(one.schema["own"].dataType))
    w = Window.partitionBy(key).orderBy(on, "side").rowsBetween(Window.unboundedPreceding, 0)
    out = one.unionByName(two).withColumn("found", F.last("found", ignorenulls=True).over(w)).where("side = 1 AND found IS NOT NULL")
    return out.select(key, on, "own.*", *(F.col(f"found.{c}") for c in columns), F.col("found.at_").alias(at))


def _struct(df: DataFrame, columns: list[str]) -> str:
    kinds = dict(df.dtypes)
    return "struct<" + ",".join(f"`{c}`:{kinds[c]}" for c in columns) + ">"


def text_search(docs: DataFrame, items: DataFrame, doc: str, item: str, first: int, least: int) -> DataFrame:
    """item, doc, hits: documents (doc, text) with ``least`` or more of the distinct first words of an
    item (item, text). Words are runs of a-z in lower case; only words that some item has are kept of
    the index, and a document's words are counted once each."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("[a-z]+"), F.lit(0)))
    wanted = items.select(item, F.explode(F.array_distinct(F.slice(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0)), 1, first))).alias("word"))
    index = docs.select(doc, F.explode(words(F.col("text"))).alias("word")).join(wanted.select("word").distinct(), "word", "left_semi")
    return index.join(wanted, "word").groupBy(item, doc).agg(F.count("*").alias("hits")).where(F.col("hits") >= least)


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """The second of equal names gets _2 behind it, and so on, by ``order``."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn("k_", k).withColumn(name, F.when(F.col("k_") == 1, F.col(name)).otherwise(F.concat(name, F.lit("_"), "k_"))).drop("k_")


def fragment(columns: list[str], ends: Column, sequence: Column) -> Column:
    """A piece of a molecule as JSON text: its columns, ends and bases."""
    return F.to_json(F.struct(*columns, ends.alias("ends"), sequence.alias("sequence")))


def quarter_generations(ids: DataFrame, most: int) -> DataFrame:
    """depth, n, least, most: the tree of ids (id) in which those under 4 are roots and any other comes
    from id / 4, by generation, ``most`` of them after the roots. An id counts if all it comes from are
    there; where an id occurs several times, each path to it counts.

    A chain of ids follows from the last one, so all chains are looked up in one join instead of a join
    for each generation."""
    seen = ids.groupBy("id").agg(F.count("*").alias("copies"))
    depth = F.size(F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.call_function("shiftright", F.col("id"), k * 2)), lambda x: x > 3))
    chain = seen.where("id IS NOT NULL").select("id", depth.alias("depth")).where(F.col("depth") <= most)
    chain = chain.select("id", "depth", F.explode(F.transform(F.sequence(F.lit(0), F.col("depth")), lambda k: F.call_function("shiftright", F.col("id"), k * 2))).alias("from"))
    paths = chain.join(seen.select(F.col("id").alias("from"), "copies").hint("merge"), "from").groupBy("id", "depth").agg(F.count("*").alias("found"), F.collect_list("copies").alias("copies"))
    whole = paths.where(F.col("found") == F.col("depth") + 1).withColumn("paths", F.aggregate("copies", F.lit(1).cast("bigint"), lambda a, x: a * x))
    return whole.groupBy("depth").agg(F.sum("paths").alias("n"), F.min("id").alias("least"), F.max("id").alias("most"))
