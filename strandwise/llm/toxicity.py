"""Toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its first 4, 5 and 6 bytes,
so that inflected forms share what their stem has learnt. Filters of widths 1, 2 and 3 slide over
the words, each filter keeps its largest value in the text, and a linear layer turns those into a
logit. Thresholds on the logit are calibrated by language; the language is guessed from function
words in the text itself. A score is the logistic of the logit less its language's threshold, so
that 0.5 is the threshold everywhere.

The classifier is fitted on the driver on a bounded sample of the labelled rows: ``PER_CLASS`` of
either class at most, by the order of a hash of their ids, and of those as many as fit into
``SAMPLE_BYTES`` of text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.cluster import cut
from strandwise.llm.text import Words, give_back, lean, parts, slices, span_hashes, texts

PER_CLASS, SAMPLE_BYTES = 2500, 64 << 20
STEPS, STARTS = 1500, 3
FEW, OFTEN, LEFT_OUT, GOOD, WORST = 20, 3, 0.3, 0.1, 0.25
FOLDS = 5
ROWS, DIM, FILTERS = 1 << 16, 12, 6
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6)
PAD = max(WIDTHS) - 1
LANGUAGES = ("en", "de", "fr", "es")
FUNCTION_WORDS = {
    "en": "the and of to in is that it was for on are with as at be this from or have",
    "de": "der die das und ist nicht ein eine zu den mit von auf im dem sich des auch für",
    "fr": "le les et est un une des qui dans pour pas sur au avec ce il du ou la",
    "es": "el los las y es una por con para del se su al lo como no en un la",
}

_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[ord("A") : ord("Z") + 1] += 32
_SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def features(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of embedding indices (a word's own and its prefixes'; PAD rows of zeros before each
    text, so that no filter's window reaches from one text's words to another's), where each text's
    rows start, and each text's language (number, -1: none guessed)."""
    words = Words(docs, _SEPARATOR, _TABLE)
    counts = words.counts()
    spans = [words.ends] + [np.minimum(words.starts + p, words.ends) for p in PREFIXES]
    hashed = [span_hashes(words.buf, words.starts, e, 0) for e in spans]
    own = np.stack([((h ^ np.uint64(k * 0x9E3779B9)) % np.uint64(ROWS)).astype(np.int32) for k, h in enumerate(hashed)], axis=1)
    start = np.concatenate([[0], np.cumsum(counts + PAD)])
    rows = np.full((start[-1], 1 + len(PREFIXES)), ROWS, dtype=np.int32)
    rows[np.arange(len(own)) + PAD * (words.owner() + 1)] = own
    votes = np.zeros((len(docs), len(LANGUAGES)), dtype=np.int64)
    for k, name in enumerate(LANGUAGES):
        listed = [w.encode() for w in FUNCTION_WORDS[name].split()]
        known = Words(listed).hashes()
        hit = np.concatenate([[0], np.cumsum(np.isin(hashed[0], known))])
        votes[:, k] = hit[words.first[1:]] - hit[words.first[:-1]]
    return rows, start, np.where(votes.any(axis=1), votes.argmax(axis=1), -1)


@dataclass
class Model:
    embed: np.ndarray  # ROWS + 1, DIM; the last row stays zero
    filters: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    weight: np.ndarray
    offset: float
    thresholds: np.ndarray  # by language; the last holds where none is guessed

    def maps(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        vec = self.embed[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            vec += self.embed[rows[:, k]]
        out = []
        for w, f in enumerate(self.filters):
            total = vec @ f[0]
            for j in range(1, len(f)):
                total[:-j] += vec[j:] @ f[j]
            out.append(np.maximum(total + self.bias[w], 0))
        return vec, out

    def logits(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        rows, start, language = features(docs)
        _, maps = self.maps(rows)
        pooled = np.concatenate([np.maximum.reduceat(m, start[:-1], axis=0) for m in maps], axis=1)
        return pooled @ self.weight + self.offset, language

    def scores(self, docs: list[bytes]) -> np.ndarray:
        out = []
        for a, b in slices([len(d) for d in docs], 2 << 20):
            logit, language = self.logits(docs[a:b])
            out.append(1 / (1 + np.exp(-np.clip(logit - self.thresholds[language], -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


def train(docs: list[bytes], labels: np.ndarray, epochs: int | None = None, rate: float = 0.1, batch: int = 32, seed: int = 7, decay: float = 1e-4) -> Model:
    """Fits the network; a fifth of the rows is set aside. A run that starts badly can settle on
    chance words, so up to ``STARTS`` seeds are tried until one errs on under 2 % of the rows set
    aside (both classes weighing alike); the best is kept and its thresholds calibrated there. With
    under ``FEW`` rows of a class there, see ``_train_few``."""
    order = np.random.default_rng(seed).permutation(len(docs))
    aside, fit = order[: len(docs) // 5], order[len(docs) // 5 :]
    ready = _ready(docs)
    if min((labels[aside] == 1).sum(), (labels[aside] == 0).sum()) < FEW:
        return _train_few(docs, ready, labels, order, epochs, rate, batch, seed, decay)
    best, least = None, np.inf
    for k in range(STARTS):
        model = _run(ready, labels, fit, epochs, rate, batch, seed + k, decay)
        _calibrate(model, [docs[x] for x in aside], labels[aside])
        wrong = (model.scores([docs[x] for x in aside]) >= 0.5) != (labels[aside] == 1)
        error = float(np.mean([wrong[labels[aside] == c].mean() for c in (0, 1) if (labels[aside] == c).any()] or [0]))
        if error < least:
            best, least = model, error
        if least < 0.02:
            break
    return best


def _train_few(docs: list[bytes], ready: list[np.ndarray], labels: np.ndarray, order: np.ndarray, epochs: int | None, rate: float, batch: int, seed: int, decay: float) -> Model:
    """Few labels are soon learnt by heart, by words that stand in one text alone. So words of under
    ``OFTEN`` texts are unknown to the network, and thresholds come from ``FOLDS`` models' logits of the
    rows that each hasn't seen. Where they err on over ``GOOD`` of those (both classes weighing alike),
    leaving out a share ``LEFT_OUT`` of the words in each step is tried too; the better way stays. If it
    errs on over ``WORST``, the labels don't tell enough: then no text is predicted that scores no
    higher than a clean one did."""
    often = lambda rows: np.bincount(np.concatenate([np.unique(ready[k]) for k in rows] or [np.zeros(0, np.int64)]), minlength=ROWS + 1) >= OFTEN

    def run(rows: np.ndarray, seed: int, left_out: float) -> Model:
        known = often(rows)
        known[ROWS] = False
        model = _run([np.where(known[r], r, ROWS) for r in ready], labels, rows, epochs, rate, batch, seed, decay, left_out)
        model.embed[~known] = 0
        return model

    best, least = None, np.inf
    for left_out in (0.0, LEFT_OUT):
        logit, language = np.zeros(len(docs)), np.zeros(len(docs), dtype=np.int64)
        for f in range(FOLDS):
            out = order[f::FOLDS]
            if len(out):
                model = run(np.setdiff1d(order, out), seed + 1 + f, left_out)
                for k in out:
                    (logit[k],), (language[k],) = model.logits([docs[k]])
        tried = run(order, seed, left_out)
        if not len(docs):
            return tried
        _thresholds(tried, logit, language, labels)
        wrong = (logit >= tried.thresholds[language]) != (labels == 1)
        error = float(np.mean([wrong[labels == c].mean() for c in (0, 1) if (labels == c).any()]))
        if error < least:
            best, least, highest = tried, error, max(logit[labels == 0], default=0.0)
        give_back()
        if least < GOOD:
            break
    if least > WORST:
        best.thresholds[:] = np.nextafter(highest, np.inf)
    return best


def _ready(docs: list[bytes]) -> list[np.ndarray]:
    """Each text's rows of embedding indices."""
    out = []
    for a, b in slices([len(d) for d in docs]):
        rows, start, _ = features(docs[a:b])
        out += [rows[x:y] for x, y in zip(start[:-1], start[1:], strict=True)]
    return out


def _run(ready: list[np.ndarray], labels: np.ndarray, fit: np.ndarray, epochs: int | None, rate: float, batch: int, seed: int, decay: float, left_out: float = 0.0) -> Model:
    """One run of Adagrad on the log loss, both classes weighing alike, of ``STEPS`` steps unless
    epochs are given (60 epochs at most)."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (ROWS + 1, DIM)).astype(np.float32)
    embed[ROWS] = 0
    model = Model(embed, [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0, np.zeros(len(LANGUAGES) + 1))
    if epochs is None:
        epochs = max(4, min(60, -(-STEPS * batch // max(1, len(fit)))))
    fit = fit.copy()
    share = {c: max(1, int((labels[fit] == c).sum())) for c in (0, 1)}
    weight_of = np.where(labels == 1, len(fit) / 2 / share[1], len(fit) / 2 / share[0])
    g_embed = np.full(ROWS + 1, 1e-6, np.float32)
    g_rest = [np.full_like(x, 1e-6) for x in (*model.filters, *model.bias, model.weight)]
    g_offset = 1e-6
    for _ in range(epochs):
        rng.shuffle(fit)
        for low in range(0, len(fit), batch):
            pick = fit[low : low + batch]
            parts = [ready[k] for k in pick]
            if left_out:
                parts = [np.where((rng.random(len(p)) >= left_out)[:, None], p, ROWS) for p in parts]
            start = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            rows = np.concatenate(parts)
            vec, maps = model.maps(rows)
            best = [np.stack([a + m[a:b].argmax(axis=0) for a, b in zip(start[:-1], start[1:], strict=True)]) for m in maps]
            pooled = np.concatenate([m[p, np.arange(FILTERS)] for m, p in zip(maps, best, strict=True)], axis=1)
            logit = pooled @ model.weight + model.offset
            error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[pick]) * weight_of[pick] / len(pick)).astype(np.float32)
            d_weight, d_offset = pooled.T @ error + decay * model.weight, float(error.sum())
            d_pooled = error[:, None] * model.weight[None, :] * (pooled > 0)
            grads = [np.zeros_like(x) for x in (*model.filters, *model.bias)]
            touched, deltas = [], []
            for w, (f, p) in enumerate(zip(model.filters, best, strict=True)):
                d = d_pooled[:, w * FILTERS : (w + 1) * FILTERS]
                grads[len(WIDTHS) + w] += d.sum(axis=0)
                for j in range(len(f)):
                    at = np.minimum(p + j, len(rows) - 1)
                    grads[w][j] += np.einsum("bfd,bf->df", vec[at], d) + decay * f[j]
                    touched.append(rows[at].reshape(-1))
                    deltas.append(np.repeat((d[:, :, None] * f[j].T[None]).reshape(-1, DIM), rows.shape[1], axis=0))
            index, place = np.unique(np.concatenate(touched), return_inverse=True)
            d_embed = np.zeros((len(index), DIM), np.float32)
            np.add.at(d_embed, place, np.concatenate(deltas))
            g_embed[index] += (d_embed**2).mean(axis=1)
            model.embed[index] -= rate * d_embed / np.sqrt(g_embed[index])[:, None]
            model.embed[ROWS] = 0
            for x, g, held in zip((*model.filters, *model.bias, model.weight), (*grads, d_weight), g_rest, strict=True):
                held += g**2
                x -= rate * g / np.sqrt(held)
            g_offset += d_offset**2
            model.offset -= rate * d_offset / g_offset**0.5
    return model


def _calibrate(model: Model, docs: list[bytes], labels: np.ndarray) -> None:
    """Sets the thresholds from the model's logits of these texts."""
    found = [model.logits(docs[a:b]) for a, b in slices([len(d) for d in docs], 2 << 20)]
    if found:
        _thresholds(model, *(np.concatenate([f[k] for f in found]) for k in (0, 1)), labels)


def _thresholds(model: Model, logit: np.ndarray, language: np.ndarray, labels: np.ndarray) -> None:
    """Thresholds with the fewest balanced errors, in the middle of the widest gap; a language with
    under 20 rows of either class takes the common threshold."""

    def best(keep: np.ndarray) -> float:
        order = np.argsort(logit[keep], kind="stable")
        x, y = logit[keep][order], labels[keep][order]
        missed = np.concatenate([[0], np.cumsum(y == 1)]) / max(1, (y == 1).sum())
        wrong = (y == 0).sum() - np.concatenate([[0], np.cumsum(y == 0)])
        cost = missed + wrong / max(1, (y == 0).sum())
        at = np.flatnonzero(cost <= cost.min() + 1e-9)
        edge = np.concatenate([[x[0] - 1], (x[:-1] + x[1:]) / 2, [x[-1] + 1]])
        gap = np.concatenate([[0], x[1:] - x[:-1], [0]])
        return float(edge[at[gap[at].argmax()]])

    model.thresholds[:] = best(np.ones(len(labels), dtype=bool))
    for k in range(len(LANGUAGES)):
        keep = language == k
        if min((labels[keep] == 1).sum(), (labels[keep] == 0).sum()) >= 20:
            model.thresholds[k] = best(keep)


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fits on at most per_class labelled rows of either class that aren't held out, and on at most
    sample_bytes of their text. Null labels, ids and texts are left out; an id with different labels
    counts as toxic, one with different texts has the least of them; rows without any label of a
    class make a model that scores every text alike."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).cast("bigint").alias("id_")).agg(F.max(label_col).alias("y"))
    chosen = None
    for c in (0, 1):
        part = known.where(F.col("y") == c).orderBy(F.xxhash64("id_"), "id_").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id_"), F.col(text_col).alias("text"))
    found = cut(own.join(F.broadcast(chosen), "id_").groupBy("id_", "y").agg(F.min("text").alias("text")))
    sizes = found.select("id_", "y", F.octet_length("text").alias("n")).collect()  # 2 * per_class rows at most
    sizes.sort(key=lambda r: zlib.crc32(str(r.id_).encode()) * (1 << 64) + r.id_)
    total, fits = 0, {}
    for r in sizes:
        if total + r.n <= sample_bytes:
            total, fits[r.id_] = total + r.n, r.y
    rows = found.where(F.col("id_").isin(list(fits))) if len(fits) < len(sizes) else found
    texts_ = {r.id_: r.text.encode() for r in rows.toLocalIterator()}
    try:
        return train([texts_.pop(i) for i in fits], np.array(list(fits.values()), dtype=np.int64))
    finally:
        give_back()  # the driver goes on with other work


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row. A null text scores as an empty one; a null id
    comes back null and isn't held out; only the text enters the score; an empty table gives no
    rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            s = held.value.scores(texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    out = docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).alias("text")).mapInArrow(lean(run), f"`{id_col}` bigint, score double, predicted int")
    return out.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text isn't predicted to be toxic, with all their columns."""
    held, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            if batch.num_rows:
                yield batch.filter(pa.array(held.value.scores(texts(batch.column(place))) < 0.5))

    return docs.mapInArrow(lean(run), docs.schema)
