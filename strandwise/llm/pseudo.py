"""Language-model scores by masked pseudo-likelihood.

A network sees the two words before and the two after a place, never the word itself, and predicts
it: embeddings of the four, one hidden layer, a softmax over word classes and a softmax over the
words of the class, which starts from their shares of the corpus count. A document's score is the
sum of the log-probabilities of all its words.

Everything is gathered from the whole corpus. Word counts: every task counts its words and shuffles
them packed by hash into a table of all words; the network tells the most frequent apart and sees
the others as hash buckets, where each word has its share of the bucket's count. Scores join the
table for the words it does not tell apart; one that the table lacks counts ``UNSEEN``, less than any word of the corpus. The network: in each round every
task takes the last round's parameters, runs one pass of gradient steps over its own rows, and the
results are averaged by words. What is gathered so grows with the corpus; what reaches the driver
is bounded by the vocabulary and the network.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.cluster import cut, partitions
from strandwise.llm.text import LOWER, Words, lean, parts, slices, texts

VOCAB, RARE, CLASSES = 4096, 256, 48
DIM, HIDDEN = 8, 24
ROUNDS, STRIDE, BATCH, RATE = 4, 4, 512, 0.4
STEPS, ROWS, CELL = 16, 1024, 4096
SCORED = 16384
SIDE = 2
AROUND = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])
BUCKETS = 1024
UNSEEN = 0.5


@dataclass
class Model:
    """words: hashes of the vocabulary, ascending; number: their ids. Ids from VOCAB on are hash
    buckets of rare words, the last id stands beyond a text's ends."""

    words: np.ndarray
    number: np.ndarray
    group: np.ndarray  # class of each id
    share: np.ndarray  # log share of each id in its class
    mass: np.ndarray  # log count of each bucket of rare words, 0 for single words
    params: list[np.ndarray]  # embeddings, hidden weights and bias, output weights and bias, word weights by class
    table: DataFrame | None = None  # the counts of all words (word_table); stays on the driver

    def __post_init__(self) -> None:
        order = np.argsort(self.group, kind="stable")
        self.low = np.searchsorted(self.group[order], np.arange(CLASSES + 1))
        self.place = np.empty(len(order), dtype=np.int64)
        self.place[order] = np.arange(len(order))
        self.bias = self.share[order].astype(np.float32)

    def within(self, hidden: np.ndarray, target: np.ndarray, rate: float = 0.0) -> np.ndarray:
        """Log-probabilities of the targets within their classes; with a rate, also a step down
        their gradient for each class."""
        out, weights = np.zeros(len(target)), self.params[5]
        group = self.group[target]
        order = np.argsort(group.astype(np.uint8), kind="stable")
        edge = np.searchsorted(group[order], np.arange(CLASSES + 1))
        for c in np.flatnonzero((np.diff(edge) > 0) & (np.diff(self.low) > 1)):
            own = slice(self.low[c], self.low[c + 1])
            for low in range(edge[c], edge[c + 1], ROWS):
                at = order[low : min(low + ROWS, edge[c + 1])]
                h, k = hidden.take(at, axis=0), (self.place[target[at]] - self.low[c], np.arange(len(at)))
                z = weights[own] @ h.T  # a row for each word: maxima and sums run along memory
                z += self.bias[own, None]
                z -= z.max(axis=0)
                p = np.exp(z)
                total = p.sum(axis=0)
                out[at] = z[k] - np.log(total)
                if rate:
                    p /= total
                    p[k] -= 1
                    weights[own] -= (rate / len(at)) * (p @ h)
        return out

    def ids(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids with SIDE end marks after each text, the places of words, words by text, and hashes."""
        words = Words(docs, table=LOWER)
        h = words.hashes()
        n = words.counts()
        pad = VOCAB + RARE
        out = np.full(len(h) + SIDE * (len(docs) + 1), pad, dtype=np.int64)
        at = np.arange(len(h)) + SIDE * (words.owner() + 1)
        found = VOCAB + (h % np.uint64(RARE)).astype(np.int64)
        if len(self.words):
            near = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            found = np.where(self.words[near] == h, self.number[near], found)
        out[at] = found
        return out, at, n, h


def start_params(seed: int = 3) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    width = 2 * SIDE * DIM
    shapes = [((VOCAB + RARE + 1, DIM), 0.3), ((width, HIDDEN), width**-0.5), ((HIDDEN,), 0.0), ((HIDDEN, CLASSES), 0.1), ((CLASSES,), 0.0), ((VOCAB + RARE + 1, HIDDEN), 0.0)]
    return [(rng.normal(0, 1, s) * scale).astype(np.float32) for s, scale in shapes]


def forward(params: list[np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, hidden values and log-probabilities of classes."""
    embed, w1, b1, w2, b2, _ = params
    x = embed.take(context, axis=0).reshape(len(context), -1)
    hidden = x @ w1
    hidden += b1
    np.tanh(hidden, out=hidden)
    z = w2.T @ hidden.T  # a row for each class: maxima and sums run along memory
    z += b2[:, None]
    z -= z.max(axis=0)
    z -= np.log(np.exp(z).sum(axis=0))
    return x, hidden, z.T


def around(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ids[at[:, None] + AROUND]


def step(params: list[np.ndarray], context: np.ndarray, target: np.ndarray, rate: float) -> np.ndarray:
    """One step down the gradient of the classes' mean negative log-probability, in place. Returns
    the hidden values."""
    embed, w1, b1, w2, b2, _ = params
    x, hidden, z = forward(params, context)
    d = np.exp(z)
    d[np.arange(len(target)), target] -= 1
    d /= len(target)
    d_hidden = (d @ w2.T) * (1 - hidden**2)
    d_x = (d_hidden @ w1.T).reshape(-1, DIM)
    w2 -= rate * (hidden.T @ d)
    b2 -= rate * d.sum(axis=0)
    w1 -= rate * (x.T @ d_hidden)
    b1 -= rate * d_hidden.sum(axis=0)
    flat = context.reshape(-1)
    for k in range(DIM):  # bincount sums repeated rows
        embed[:, k] -= rate * 8 * np.bincount(flat, d_x[:, k], len(embed)).astype(np.float32)
    return hidden


def _bucket_spans(h: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The buckets of ascending hashes, and where each lies."""
    bucket = (h >> np.uint64(54)).astype(np.int32)
    edge = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(h)]]) if len(h) else np.zeros(1, dtype=int)
    return bucket[edge[:-1]], list(zip(edge[:-1], edge[1:], strict=True))


def word_table(docs: DataFrame) -> DataFrame:
    """(bucket, h binary, n binary): hashes and counts of all words, a row for each of BUCKETS ranges."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            h, n = total
            bucket, spans = _bucket_spans(h)
            cols = [pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (h, n.astype("<i8"))]
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *cols], names=["bucket", "h", "n"])

        for batch in parts(batches):
            docs_ = texts(batch.column(0))
            for a, b in slices([len(d) for d in docs_]):
                h, n = np.unique(Words(docs_[a:b], table=LOWER).hashes(), return_counts=True)
                both, place = np.unique(np.concatenate([total[0], h]), return_inverse=True)
                sums = np.bincount(place, np.concatenate([total[1], n]), len(both)).astype(np.int64)
                total = both, sums
                if len(both) > 2_000_000:  # an unbounded task's memory stays bounded
                    yield from rows()
                    total = both[:0], sums[:0]
        yield from rows()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def row() -> pa.RecordBatch:
            h, place = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x, _ in held]), return_inverse=True)
            n = np.bincount(place, np.concatenate([np.frombuffer(y, "<i8") for _, y in held]), len(h)).astype("<i8")
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([h.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["bucket", "h", "n"])

        for batch in batches:
            for bucket, h, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if bucket != now and held:
                    yield row()
                    held = []
                now = bucket
                held.append((h, n))
        if held:
            yield row()

    packed = docs.mapInArrow(lean(count), "bucket int, h binary, n binary")
    dealt = packed.repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket")
    return cut(dealt.mapInArrow(lean(total), "bucket int, h binary, n binary"))


def word_counts(docs: DataFrame, most: int = VOCAB, table: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` most frequent words' hashes and counts, and the counts of the rest by bucket.
    table: the documents' word_table, where there is one."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top_h, top_n = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        rest = np.zeros(RARE, dtype=np.int64)
        for batch in batches:
            for more_h, more_n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h, n = np.concatenate([top_h, np.frombuffer(more_h, "<u8")]), np.concatenate([top_n, np.frombuffer(more_n, "<i8")])
                order = np.lexsort((h, -n))
                keep, out = order[:most], order[most:]
                top_h, top_n = h[keep], n[keep]
                rest = rest + np.bincount((h[out] % np.uint64(RARE)).astype(np.int64), n[out], RARE).astype(np.int64)
        used = np.flatnonzero(rest)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([top_h.view(np.int64), used])), pa.array(np.concatenate([top_n, rest[used]])), pa.array([False] * len(top_h) + [True] * len(used))], names=["h", "n", "rest"])

    table = word_table(docs) if table is None else table
    found = table.mapInArrow(lean(add), "h bigint, n bigint, rest boolean").persist()
    # few partitions, as each sends its own ``most`` to the driver
    top = found.where("not rest").coalesce(8).orderBy(F.desc("n"), "h").limit(most).collect()
    last = F.lit(False) if len(top) < most else (F.col("n") < top[-1].n) | ((F.col("n") == top[-1].n) & (F.col("h") > top[-1].h))
    bucket = F.when(F.col("rest"), F.col("h")).otherwise(F.expr(f"cast(pmod(cast(h as decimal(20,0)) + if(h < 0, cast(18446744073709551616 as decimal(20,0)), 0), {RARE}) as bigint)"))
    rare = np.zeros(RARE, dtype=np.int64)
    for r in found.where(F.col("rest") | last).groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).collect():  # RARE rows
        rare[r.b] = r.n
    found.unpersist()
    return np.array([r.h for r in top], dtype=np.int64).view(np.uint64), np.array([r.n for r in top], dtype=np.int64), rare


def classes_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of about equal sums of square roots of counts, by frequency, which keeps the words to be
    weighed for a target few; and each id's log share in its class."""
    weight = np.sqrt(counts)
    order = np.argsort(-counts, kind="stable")
    mass = np.cumsum(weight[order]) - weight[order] / 2
    group = np.zeros(len(counts), dtype=np.int64)
    group[order] = np.minimum(mass / max(1, weight.sum()) * CLASSES, CLASSES - 1).astype(np.int64)
    return group, np.log(counts / np.bincount(group, counts, CLASSES)[group])


def _rounds(docs: DataFrame, model: Model, rounds: int, stride: int) -> None:
    spark, shapes = docs.sparkSession, [p.shape for p in model.params]
    for turn in range(rounds):
        held = spark.sparkContext.broadcast(replace(model, table=None))

        def run(batches: Iterator[pa.RecordBatch], held=held, turn=turn) -> Iterator[pa.RecordBatch]:
            own = replace(held.value, params=[p.copy() for p in held.value.params])
            seen = 0
            for batch in parts(batches):
                docs_ = texts(batch.column(0))
                for a, b in slices([len(d) for d in docs_], 1 << 20):
                    ids, at, _, _ = own.ids(docs_[a:b])
                    k = np.arange(len(at))
                    at = at[(k + k // stride) % stride == turn % stride]  # another one of each stride places in each round
                    for low in range(0, len(at), STEPS * BATCH):
                        hidden = []
                        for k in range(low, min(low + STEPS * BATCH, len(at)), BATCH):
                            part = at[k : k + BATCH]
                            hidden.append(step(own.params, around(ids, part), own.group[ids[part]], RATE * len(part) / BATCH))
                        own.within(np.concatenate(hidden), ids[at[low : low + STEPS * BATCH]], RATE)
                    seen += len(at)
            if seen:
                flat = np.concatenate([p.reshape(-1) for p in own.params]).astype("<f8") * seen
                cells = [flat[k : k + CELL].tobytes() for k in range(0, len(flat), CELL)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array([seen] * len(cells), pa.int64()), pa.array(cells, pa.binary())], names=["part", "seen", "x"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, tuple[int, np.ndarray]] = {}
            for batch in batches:
                for part, seen, x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    n, sums = total.get(part, (0, 0.0))
                    total[part] = n + seen, sums + np.frombuffer(x, "<f8")
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([x.tobytes() for _, x in total.values()], pa.binary())], names=["part", "seen", "x"])

        each = docs.mapInArrow(lean(run), "part int, seen bigint, x binary").repartition(partitions(spark), "part")
        got = sorted(each.mapInArrow(lean(add), "part int, seen bigint, x binary").collect())  # as large as the network
        if not got:
            return
        flat = np.concatenate([np.frombuffer(r.x, "<f8") / r.seen for r in got]).astype(np.float32)
        edge = np.cumsum([0, *(p.size for p in model.params)])
        model.params = [flat[a:b].reshape(s) for a, b, s in zip(edge[:-1], edge[1:], shapes, strict=True)]


def fit(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, stride: int = STRIDE) -> Model:
    """Counts all words and trains on one of each stride places of every text, another one in each
    round: at least as many rounds as the stride, so that every place is trained on. Null and empty
    texts add nothing; an empty table makes an untrained network."""
    if rounds < stride:
        raise ValueError("fewer rounds than the stride leave places out")
    held = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"))
    table = word_table(held)
    words, counts, rare = word_counts(held, table=table)
    order = np.argsort(words)
    full = np.concatenate([np.pad(counts, (0, VOCAB - len(counts))), rare, [0]]) + 1
    group, share = classes_of(full)
    mass = np.zeros(len(full))
    mass[VOCAB : VOCAB + RARE] = np.log(full[VOCAB : VOCAB + RARE])
    model = Model(words[order], order, group, share, mass, start_params(), table)
    _rounds(held, model, rounds, stride)
    return model


#: kind: 0 counts of a bucket, 1 scores of some texts, 2 words of those texts to look up, or sums found.
PACKED = "kind int, bucket int, base bigint, h binary, x binary, ids array<bigint>, counts array<bigint>, sums array<double>"
TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, log_prob, mean_log_prob) of every row: log_prob is the sum over all words, the
    mean is null where there are none. Null texts have no words; null ids come back null; repeated
    rows score alike; an empty table gives no rows; other columns are not read."""
    held = docs.sparkSession.sparkContext.broadcast(replace(model, table=None))
    spark, names = docs.sparkSession, [x.split()[0] for x in PACKED.split(", ")]

    def row(kind: int, bucket: int, base: int | None, h=None, x=None, ids=None, n=None, sums=None) -> tuple:
        return kind, bucket, base, h, x, ids, n, sums

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True) if rows else [[]] * len(TYPES)
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, TYPES, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of up to 1024 texts a row of their scores so far, and rows of the words to look up."""
        own, base = held.value, TaskContext.get().partitionId() << 32
        for batch in parts(batches):
            docs_ = texts(batch.column(1))
            n_words, sums, rare_h, rare_at, low = [np.zeros(0, dtype=np.int64)], [np.zeros(0)], [], [], 0
            for a, b in slices([len(d) for d in docs_], 1 << 20):
                ids, at, n, h = own.ids(docs_[a:b])
                logs = np.zeros(len(at) + 1)
                for k in range(0, len(at), SCORED):
                    part = at[k : k + SCORED]
                    _, hidden, z = forward(own.params, around(ids, part))
                    target = ids[part]
                    logs[k : k + len(part)] = z[np.arange(len(part)), own.group[target]] + own.within(hidden, target) - own.mass[target]
                edge = np.concatenate([[0], np.cumsum(n)])
                n_words.append(n)
                sums.append(np.where(n > 0, np.add.reduceat(logs, edge[:-1]), 0.0))
                rare = np.flatnonzero(ids[at] >= VOCAB)
                rare_h.append(h[rare])
                rare_at.append((np.repeat(np.arange(a, b), n)[rare]).astype("<u2"))
            rows = [row(1, base % BUCKETS, base, ids=batch.column(0).to_pylist(), n=np.concatenate(n_words).tolist(), sums=np.concatenate(sums).tolist())]
            if rare_h:
                h, at = np.concatenate(rare_h), np.concatenate(rare_at)
                order = np.argsort(h)
                h, at = h[order], at[order]
                rows += [row(2, bucket, base, h[a:b].tobytes(), at[a:b].tobytes()) for bucket, (a, b) in zip(*_bucket_spans(h), strict=True)]
            yield batch_of(rows)
            base += 1

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The logarithms of the counts, summed by text over the task's words."""
        now, h, logs = None, np.zeros(0, dtype=np.uint64), np.zeros(1)
        found: dict[int, np.ndarray] = {}

        def rows() -> list[tuple]:
            out = [row(2, 0, base, x=x.tobytes()) for base, x in found.items()]
            found.clear()
            return out

        for batch in batches:
            passed = []
            for r in zip(*(batch.column(c).to_pylist() for c in range(len(names))), strict=True):
                kind, bucket, base, own, x = r[:5]
                if kind == 1:
                    passed.append(r)
                    continue
                if bucket != now:
                    now, h, logs = bucket, np.zeros(0, dtype=np.uint64), np.zeros(1)
                own = np.frombuffer(own, "<u8")
                if kind == 0:
                    h, logs = own, np.append(np.log(np.frombuffer(x, "<i8")), 0.0)
                    continue
                near = np.minimum(np.searchsorted(h, own), max(len(h) - 1, 0))
                known = h[near] == own if len(h) else np.zeros(len(own), dtype=bool)
                part = np.bincount(np.frombuffer(x, "<u2"), np.where(known, logs[near], np.log(UNSEEN)), 1024)
                found[base] = found[base] + part if base in found else part
                if len(found) > 4096:  # an unbounded task's memory stays bounded
                    passed += rows()
            if passed:
                yield batch_of(passed)
        yield batch_of(rows())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts' rows: their scores and what was looked up for them."""
        now, ids, n, sums = None, [], [], np.zeros(0)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sums)], names=[id_col, "n_words", "log_prob"])

        for batch in batches:
            for _, _, base, _, x, own_ids, own_n, own_sums in zip(*(batch.column(c).to_pylist() for c in range(len(names))), strict=True):
                if base != now:
                    if ids:
                        yield out()
                    now, ids, n, sums = base, own_ids, own_n, np.array(own_sums)
                else:
                    sums = sums + np.frombuffer(x, "<f8")[: len(sums)]
        if ids:
            yield out()

    rows = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).alias("text")).mapInArrow(lean(run), PACKED)
    if model.table is not None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("ids", "array<bigint>"), ("counts", "array<bigint>"), ("sums", "array<double>"))]
        rows = rows.unionByName(model.table.select(F.lit(0).alias("kind"), "bucket", F.lit(None).cast("bigint").alias("base"), "h", F.col("n").alias("x"), *none))
    dealt = rows.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "kind")
    back = dealt.mapInArrow(lean(look_up), PACKED).repartition(partitions(spark), "base").sortWithinPartitions("base", "kind")
    out = back.mapInArrow(lean(add), f"`{id_col}` bigint, n_words bigint, log_prob double")
    return out.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))
