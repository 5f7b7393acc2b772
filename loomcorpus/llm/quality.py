"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages of PASSAGE words (the whole text, however long; the last passage may be
shorter; a text without words is one empty passage). Every passage is encoded into features (shares of characters,
repetition, and its words, hashed with a sign into BUCKETS), lifted by a hidden layer, weighted by gated attention (Ilse, Tomczak and Welling) and summed; a logistic layer scores
the weighted representation. Only document labels are used; all layers are learnt here by Adam.

Null text is empty text. Equal texts get equal scores. With labels of one class only, or none, every score
is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .words import Words

PASSAGE, BUCKETS = 64, 32
#: Labelled rows of either class that the fit may read (and common.SAMPLE_BYTES of text), hidden width, attention width, rounds.
SAMPLE, HIDDEN, GATE, ROUNDS = 2500, 16, 8, 60
_CLASSES = [range(65, 91), range(97, 123), range(48, 58), [9, 10, 11, 12, 13, 32], b"#*$%&|<>", b"!?", b".,;:", range(128, 256), b"\n", b"|"]
_BIT = np.zeros((len(_CLASSES), 256), np.uint8)
for _k, _bytes in enumerate(_CLASSES):
    _BIT[_k, list(_bytes)] = 1


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features, text) of every passage of the texts, in order."""
    w = Words(texts)
    counts = np.diff(w.first)
    bags = np.maximum(1, -(-counts // PASSAGE))
    doc = np.repeat(np.arange(w.n), bags)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(bags) - bags, bags)
    low = w.first[doc] + nth * PASSAGE
    high = np.minimum(low + PASSAGE, w.first[doc + 1])
    some = high > low
    left, right = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
    left[some], right[some] = w.start[low[some]], w.end[high[some] - 1]
    right = np.maximum(right, left)
    size, n = np.maximum(1, right - left), np.maximum(1, high - low)
    columns = [np.minimum(high - low, PASSAGE) / PASSAGE]
    for bit in _BIT:
        sums = np.zeros(len(w.buf) + 1, np.int32)
        np.cumsum(bit[w.buf], dtype=np.int32, out=sums[1:])
        columns.append((sums[right] - sums[left]) / size)
    over = lambda x: (lambda s: s[high] - s[low])(np.concatenate(([0.0], np.cumsum(x))))
    length = (w.end - w.start).astype(np.float64)
    mean = over(length) / n
    columns += [mean / 10, np.sqrt(np.maximum(0, over(length**2) / n - mean**2)) / 10]
    again, home = np.zeros(len(w.hash)), np.repeat(np.arange(len(doc)), high - low)
    if len(w.hash):
        again[1:] = w.hash[1:] == w.hash[:-1]
        last = w.buf[w.end - 1]
        first = w.buf[w.start]
        marked = (_BIT[4] | _BIT[5])[last].astype(np.float64)
        capital = _BIT[0][first].astype(np.float64)
        key = w.hash ^ (home.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        repeat = np.zeros(len(key))
        repeat[order[1:][key[order][1:] == key[order][:-1]]] = 1
        at, hashes = w.windows(6)
        own = hashes ^ (w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(own, kind="stable")
        echo = np.zeros(len(w.hash))
        echo[at[order[1:][own[order][1:] == own[order][:-1]]]] = 1
    else:
        marked = capital = repeat = echo = again
    columns += [over(x) / n for x in (again, marked, capital, repeat, echo)]
    bucket, sign = (w.hash >> np.uint64(59)).astype(np.int64) % BUCKETS, 1.0 - 2.0 * (w.hash & np.uint64(1)).astype(np.float64)
    words = np.bincount(home * BUCKETS + bucket, sign, len(doc) * BUCKETS).reshape(-1, BUCKETS)
    return np.concatenate((np.stack(columns, 1), words / np.sqrt(n)[:, None]), 1), doc


class AttentionMIL:
    """Bags of feature rows to a score of 0 to 1."""

    def __init__(self, features: int, seed: int = 11):
        r = np.random.default_rng(seed)
        d = lambda a, b: r.normal(0, (2 / (a + b)) ** 0.5, (a, b))
        self.mean, self.scale, self.prior = np.zeros(features), np.ones(features), 0.5
        self.p = {"W": d(features, HIDDEN), "b": np.zeros(HIDDEN), "V": d(HIDDEN, GATE), "U": d(HIDDEN, GATE), "w": d(GATE, 1)[:, 0], "c": d(HIDDEN, 1)[:, 0], "k": np.zeros(1)}
        self.trained = False

    def _forward(self, x: np.ndarray, first: np.ndarray, doc: np.ndarray):
        p = self.p
        h = np.maximum(0, x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, first)[doc])
        a = e / np.add.reduceat(e, first)[doc]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return h, t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["k"], -30, 30)))

    def fit(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 5) -> AttentionMIL:
        self.prior = float(y.mean()) if len(y) else 0.5
        if not len(y) or y.min() == y.max():
            return self
        self.trained = True
        rows = np.concatenate(bags)
        self.mean, self.scale = rows.mean(0), rows.std(0) + 1e-3
        bags = [np.clip((b - self.mean) / self.scale, -6, 6) for b in bags]
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        r, m, v, step = np.random.default_rng(seed), {}, {}, 0
        for turn in range(ROUNDS):
            order = r.permutation(len(bags))
            for k in range(0, len(order), 128):
                part = order[k : k + 128]
                x = np.concatenate([bags[i] for i in part])
                n = np.array([len(bags[i]) for i in part])
                first, doc, p = np.cumsum(n) - n, np.repeat(np.arange(len(part)), n), self.p
                h, t, g, a, z, s = self._forward(x, first, doc)
                d = (s - y[part]) * weight[part] / len(part)
                dz = d[:, None] * p["c"]
                da = (dz[doc] * h).sum(1)
                de = a * (da - np.add.reduceat(a * da, first)[doc])
                dtg = de[:, None] * p["w"]
                dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
                dh = (a[:, None] * dz[doc] + dt @ p["V"].T + dg @ p["U"].T) * (h > 0)
                grad = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ d, "k": np.array([d.sum()])}
                step += 1
                for name, value in grad.items():
                    value = value + 1e-4 * p[name]
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * value
                    v[name] = 0.999 * v.get(name, 0) + 0.001 * value**2
                    p[name] = p[name] - 0.01 * 0.97**turn * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(doc[-1] + 1 if len(doc) else 0, self.prior)
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        return self._forward(np.clip((x - self.mean) / self.scale, -6, 6), first, doc)[-1]


def learn(texts: list[str], y: np.ndarray) -> AttentionMIL:
    """The model of labelled texts, which are encoded a few at a time."""
    bags = []
    for k in range(0, len(texts), 64):
        x, doc = passages([t.encode() for t in texts[k : k + 64]])
        bags += np.split(x, np.flatnonzero(np.diff(doc)) + 1)
    return AttentionMIL(bags[0].shape[1]).fit(bags, y.astype(np.float64))


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, sample: int = SAMPLE) -> AttentionMIL:
    """Learns from at most 2 * sample labelled rows (those of `where`), in one task."""
    return common.trained(docs, labels, "quality", sample, learn, where) or AttentionMIL(1)


def score(docs: DataFrame, model: AttentionMIL) -> DataFrame:
    """doc_id, score, predicted (1 if score >= 0.5) for every row of `docs` (doc_id, text)."""
    return common.scan(docs, lambda texts: {"score": model.score(*passages(texts))}, "score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
