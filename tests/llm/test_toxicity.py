"""Thresholds and few labels of the toxicity classifier."""

import random

import numpy as np

from strandwise.llm import toxicity as T


def blank():
    return T.Model(np.zeros((T.ROWS + 1, T.DIM), np.float32), [], [], np.zeros(0), 0.0, np.zeros(len(T.LANGUAGES) + 1))


def test_thresholds_by_trying_all():
    rng = np.random.default_rng(2)
    for n in (3, 40, 200):
        labels = rng.integers(0, 2, n)
        labels[:2] = [0, 1]
        logit = np.round(rng.normal(labels, 1.0), 1)  # with ties
        language = rng.integers(-1, len(T.LANGUAGES), n)
        model = blank()
        T._thresholds(model, logit, language, labels)

        def cost(keep, t):
            x, y = logit[keep], labels[keep]
            return (x[y == 1] < t).mean() + (x[y == 0] >= t).mean()

        every = np.ones(n, dtype=bool)
        cuts = lambda keep: [logit[keep].min() - 1, *((np.unique(logit[keep])[:-1] + np.unique(logit[keep])[1:]) / 2), logit[keep].max() + 1]
        assert cost(every, model.thresholds[-1]) <= min(cost(every, t) for t in cuts(every)) + 1e-9 or len(np.unique(logit)) < n
        for k in range(len(T.LANGUAGES)):
            keep = language == k
            if min((labels[keep] == 1).sum(), (labels[keep] == 0).sum()) < 20:
                assert model.thresholds[k] == model.thresholds[-1]


def texts(rng, n, bad, share, plain):
    out, labels = [], []
    for k in range(n):
        y = int(rng.random() < share)
        w = [rng.choice(plain) for _ in range(60)] + [f"once{k}x{j}" for j in range(30)]
        for _ in range(6 * y):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        out.append(" ".join(w).encode())
        labels.append(y)
    return out, np.array(labels)


def test_few_labels_that_tell():
    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    bad = ["scoundrel", "villain", "rotter", "blighter", "cad", "knave", "wretch"]
    docs, labels = texts(rng, 200, bad, 0.15, plain)
    fresh, truth = texts(rng, 300, bad, 0.15, plain)
    wrong = (T.train(docs, labels).scores(fresh) >= 0.5) != (truth == 1)
    assert np.mean([wrong[truth == c].mean() for c in (0, 1)]) < 0.1


def test_labels_that_tell_nothing_reject_nothing():
    rng = random.Random(5)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    docs, _ = texts(rng, 60, plain, 0.0, plain)
    labels = np.array([int(k % 6 == 0) for k in range(60)])
    fresh, _ = texts(rng, 200, plain, 0.0, plain)
    assert (T.train(docs, labels).scores(fresh) >= 0.5).mean() < 0.05
    for odd in ([], [0], [1], [0, 0, 0], [1, 1]):
        model = T.train([b"a text"] * len(odd), np.array(odd, dtype=np.int64))
        assert len(model.scores([b"", b"a text"])) == 2
