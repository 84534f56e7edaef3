"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (h, g, n, last): the 128-bit hash of a line's key, in how many documents it was
found and the largest of their ids, bucketed by the hash and sorted within a bucket. Documents come
in batches of descending ids. A batch's hashes are merge-anti-joined with the runs' closed entries
(those already found in enough documents: the largest id is known by then, so nothing more can
change) and the rest becomes a new run of level 0. Two runs of one level are compacted into one of
the next, so that after n batches there are log2(n) runs at most. The last compaction leaves the
closed entries, which are all that the removal of lines looks up. Runs have as many buckets as a
shuffle has partitions: a batch is shuffled once to meet them, a compaction shuffles nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.cluster import NO_ID, bucket_of, cut, key_bounds, partitions, shared_dir
from strandwise.llm.text import lean, parts, slices, texts

SHORTEST, DOCUMENTS = 40, 5
BATCHES = 8
STRIPPED = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z in lower case."""
    return line.strip(STRIPPED).lower()  # of bytes: ASCII letters only


def key_hashes(text: bytes, shortest: int) -> list[int]:
    """For each line of a text the 128-bit hash of its key; 0 for a key of fewer code points."""
    out = []
    for line in text.split(b"\n"):
        key = line_key(line)
        long = len(key) >= shortest and (key.isascii() or len(key.decode()) >= shortest)
        out.append(xxhash.xxh3_128_intdigest(key) or 1 if long else 0)
    return out


def _halves(h: int) -> tuple[int, int]:
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def hashed_lines(docs: DataFrame, shortest: int) -> DataFrame:
    """docs (id_, text) to (id_, h, g): a row for each document and different key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            ids, docs_ = batch.column(0).to_pylist(), texts(batch.column(1))
            for a, b in slices([len(d) for d in docs_]):
                rows = [(i, *_halves(x)) for i, d in zip(ids[a:b], docs_[a:b], strict=True) for x in set(key_hashes(d, shortest)) if x]
                cols = zip(*rows, strict=True) if rows else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id_", "h", "g"])

    return docs.mapInArrow(lean(run), "id_ bigint, h bigint, g bigint")


class Runs:
    """The levelled runs. ``add`` takes batches in descending order of ids; ``close`` compacts all
    that is left. Runs are tables of the session's catalog whose files lie in the shared folder."""

    def __init__(self, spark: SparkSession, documents: int = DOCUMENTS):
        self.spark, self.documents = spark, documents
        self.buckets = partitions(spark)
        self.levels: list[str | None] = []  # a run or none for each level
        self.names: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, "h", "g").sortBy("h", "g").option("path", shared_dir(self.spark)).saveAsTable(name)
        self.names.append(name)
        return name

    def add(self, lines: DataFrame) -> None:
        """Merge-anti-joins a batch's lines (id_, h, g) with the closed entries of all runs, writes
        the rest as a run of level 0 and compacts levels that would hold two."""
        own = lines.groupBy("h", "g").agg(F.count("*").alias("n"), F.max("id_").alias("last"))
        for name in filter(None, self.levels):
            closed = self.spark.table(name).where(F.col("n") >= self.documents).select("h", "g")
            own = own.join(closed.hint("merge"), ["h", "g"], "left_anti")
        name, k = self._write(own), 0
        while k < len(self.levels) and self.levels[k]:
            name, self.levels[k] = self._compact(self.levels[k], name), None
            k += 1
        self.levels[k : k + 1] = [name]

    def _compact(self, older: str, newer: str) -> str:
        """One run of two: a merge join of equal buckets."""
        one, two = self.spark.table(older).alias("a"), self.spark.table(newer).alias("b")
        both = one.join(two.hint("merge"), (F.col("a.h") == F.col("b.h")) & (F.col("a.g") == F.col("b.g")), "full")
        n = F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
        return self._write(both.select(F.coalesce("a.h", "b.h").alias("h"), F.coalesce("a.g", "b.g").alias("g"), n.alias("n"), F.greatest("a.last", "b.last").alias("last")))

    def close(self) -> DataFrame:
        """(h, g, last) of every entry found in enough documents; the runs leave the catalog."""
        left = [name for name in self.levels if name]  # the smallest first
        while len(left) > 1:
            left[:2] = [self._compact(left[1], left[0])]
        found = cut(self.spark.table(left[0]).where(F.col("n") >= self.documents).select("h", "g", "last"))
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        return found


def repeated_lines(docs: DataFrame, shortest: int = SHORTEST, documents: int = DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """(id_, drop): for each id of docs (id_, text) the hashes of the keys whose lines go there."""
    spark = docs.sparkSession
    bounds = key_bounds(docs, "id_", batches)
    path = shared_dir(spark)
    hashed = hashed_lines(docs, shortest).withColumn("batch", bucket_of("id_", bounds))
    hashed.write.partitionBy("batch").parquet(path)
    hashed = spark.read.schema("id_ bigint, h bigint, g bigint, batch int").parquet(path)
    runs = Runs(spark, documents)
    for k in reversed(range(len(bounds) + 1)):
        runs.add(hashed.where(F.col("batch") == k))
    held = hashed.select("id_", "h", "g").join(runs.close(), ["h", "g"]).where("id_ < last")
    return held.groupBy("id_").agg(F.collect_set("h").alias("drop"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, shortest: int = SHORTEST, documents: int = DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """Lines whose key (see ``line_key``) has at least ``shortest`` code points and stands in at least
    ``documents`` documents go from all of them but the one with the largest id. Returns (id, n_lines,
    n_dropped, kept_sha256) and, with_text, the other lines joined by line feeds.

    A null or empty text is one empty line. Every row is a document: rows that share an id count each,
    and all rows of a key's largest id keep its lines. A key that repeats within a document counts
    once there and stays or goes with all its lines. A null id is the smallest and comes back null.
    An empty table gives no rows. Other columns are not read. Keys are equal if their 128-bit hashes
    are (within one document: 64 bits of them).
    """
    held = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id_"), F.col(text_col).alias("text"))
    joined = held.join(repeated_lines(held, shortest, documents, batches), "id_", "left").select("id_", "text", "drop")
    schema = "id_ bigint, n_lines bigint, n_dropped bigint, kept_sha256 string" + ", kept string" * with_text

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(rows):
            n_lines, n_dropped, sha, kept = [], [], [], []
            for text, drop in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if drop:
                    gone = set(drop)
                    lines = [x for x, h in zip(lines, key_hashes(text, shortest), strict=True) if not h or _halves(h)[0] not in gone]
                n_dropped.append(n_lines[-1] - len(lines))
                rest = b"\n".join(lines)
                sha.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    kept.append(rest.decode())
            cols = [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.string())] * with_text, names=["id_", "n_lines", "n_dropped", "kept_sha256", "kept"][: 4 + with_text])

    out = joined.mapInArrow(lean(run), schema)
    return out.select(F.when(F.col("id_") != F.lit(NO_ID), F.col("id_")).alias(id_col), *out.columns[1:])
