"""Toxicity: a subsequence string-kernel machine with Nyström landmarks, trained on labelled sentences.

The kernel (Lodhi et al.) counts subsequences of ORDER characters that two strings share, each weighted by
DECAY to the power of the stretch it takes, so an insult with gaps or inserted characters still matches;
stretches go up to SPAN characters. Text is folded to a small alphabet: case, accents and characters that stand for
letters; a run of white space is one character, a run of other marks another, and either can be passed over as
any inserted character is ("id iot", "i d i o t", "i.d.i.o.t"). The kernel compares windows: the subsequences that
start at WINDOW characters in a row.

A sentence is as toxic as its most telling window, and a document as its own, over its whole text. Labels are given to documents, so
sentences get theirs by turns (multiple instances): those of clean documents are clean; a sentence of a
toxic document is toxic if its window tells more than nearly all clean sentences' (CLEAN), or if none of its document tells more. Before
there is a machine, how many more toxic documents hold each subsequence tells. Each turn trains on
the most telling windows of toxic sentences, those of clean documents, and windows at random places of these: features are Nyström's,
kernels to landmark windows, whitened; the machine is linear in them with a squared hinge. As it is linear in the kernel, it folds into
one weight a subsequence, and scoring a text adds these up: equal to summing over the landmarks.

Null and empty texts score as a window of nothing does; equal texts score alike; repeated rows and ids each get their score. Texts are read
whole, in pieces that lap over by a window. An empty table gives no rows; only doc_id and text are read. Without labels of
both classes every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import itertools
import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ORDER, SPAN, DECAY, WINDOW = 4, 7, 0.65, 12
#: Labelled toxic documents that the fit may read (and twice as many clean ones, and common.SAMPLE_BYTES of text); landmarks; turns; one in
#: so many documents is kept for scaling; share of clean sentences that a toxic one must outdo; cost of an error.
SAMPLE, LANDMARKS, TURNS, SCALED, CLEAN, COST = 1500, 256, 3, 4, 0.99, 30.0
END, BLANK, OTHER, WIDE = 30, 29, 28, 27
#: Characters that are looked at together.
PIECE = 1 << 18
#: Room between texts, and windows with their last subsequences.
ROOM = WINDOW + SPAN - 1
_SHAPES = [c for c in itertools.combinations(range(1, SPAN), ORDER - 1)]
_WEIGHTS = [DECAY ** (s[-1] + 1) for s in _SHAPES]
#: The root of the self-kernel of a window none of whose subsequences repeats.
NORM = float(np.sqrt(WINDOW * sum(w * w for w in _WEIGHTS)))
#: Characters that stand for letters.
_STANDS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _letter(c: str) -> int:
    """The code of a character; 0 for one that can't be seen by itself."""
    if c.isspace():
        return BLANK
    if unicodedata.category(c) in ("Cf", "Mn", "Me", "Cc", "Cs"):
        return 0
    c = _STANDS.get(c, c.lower())
    base = unicodedata.normalize("NFKD", c)[:1]
    return ord(base) - 96 if "a" <= base <= "z" else WIDE if base.isalnum() else OTHER


_LOW = 0x2100
_STOPS = np.array([ord(c) for c in ".!?"], np.uint32)
_TABLE = np.array([_letter(chr(i)) for i in range(_LOW)], np.uint8)


def codes(text: str, ends: bool = False) -> np.ndarray:
    """The text's codes: a blank at either end; runs of blanks and of other marks drawn together; marks between letters, and
    what stands between letters that stand alone, left out. With `ends`, the ends of sentences are codes of their own."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    out = _TABLE[np.minimum(points, _LOW - 1)]
    high = np.flatnonzero(points >= _LOW)
    if len(high):
        some, at = np.unique(points[high], return_inverse=True)
        out[high] = np.array([_letter(chr(p)) for p in some.tolist()], np.uint8)[at]
    if ends:
        stop = np.isin(points, _STOPS) & np.concatenate((out[1:] == BLANK, [True]))
        out = np.where(stop | (points == 10), END, out)
    out = np.concatenate(([BLANK], out[out > 0], [BLANK])).astype(np.uint8)
    out = out[np.concatenate(([True], (out[1:] != out[:-1]) | (out[1:] < OTHER)))]
    if len(out) < 3:
        return out
    letter = out < OTHER
    out = out[np.concatenate(([True], (out[1:-1] != OTHER) | ~(letter[:-2] & letter[2:]), [True]))]
    out = out[np.concatenate(([True], (out[1:-1] != OTHER) | ~((out[:-2] == BLANK) | (out[2:] == BLANK)), [True]))]
    letter = out < OTHER
    alone = np.concatenate(([False], letter[1:-1] & ~letter[:-2] & ~letter[2:], [False]))
    return out[np.concatenate(([True], letter[1:-1] | (out[1:-1] == END) | ~(alone[:-2] & alone[2:]), [True]))]


def sentences_of(text: str) -> list[np.ndarray]:
    """The codes of the text's sentences, each with a blank at either end; of a text without any, a blank."""
    whole = codes(text, True)
    at = np.flatnonzero(whole == END)
    whole[at] = BLANK
    edges = [0, *at.tolist(), len(whole) - 1]
    return [whole[a : b + 1] for a, b in zip(edges, edges[1:], strict=False) if b - a > 1] or [whole[:1]]


def _keys(stream: np.ndarray):
    """(subsequence at each place, weight) of the codes, shape by shape; one over a gap has a code of 0 in it."""
    small = stream.astype(np.int32)
    n = len(small) - SPAN + 1
    first, second, third = small[:n] << 15, small << 10, small << 5
    for (a, b, c), weight in zip(_SHAPES, _WEIGHTS, strict=True):
        yield first | second[a : n + a] | third[b : n + b] | small[c : n + c], weight


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(one stream, where each part starts), with room between."""
    room = np.zeros(ROOM, np.uint8)
    at = np.cumsum([0, *(len(p) + ROOM for p in parts)])
    return np.concatenate([x for p in parts for x in (p, room)] + [room]), at[:-1]


def _window_sums(stream: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What the weights give the window that starts at each place."""
    n = len(stream) - SPAN + 1
    total = np.zeros(n, np.float32)
    for key, weight in _keys(stream):
        total += weights[key] * np.float32(weight / NORM)
    sums = np.concatenate(([0.0], np.cumsum(total, dtype=np.float64)))
    return sums[WINDOW:] - sums[:-WINDOW]


def _pieces(parts: list[np.ndarray]):
    """Runs of parts of about PIECE codes, as (index of the first, run)."""
    start, held = 0, 0
    for i, p in enumerate(parts):
        held += len(p) + ROOM
        if held >= PIECE:
            yield start, parts[start : i + 1]
            start, held = i + 1, 0
    if start < len(parts):
        yield start, parts[start:]


def best_windows(parts: list[np.ndarray], weights: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(value, place) of the most telling window of each part, of those that start at its first `most` codes if that is given."""
    value, place = np.zeros(len(parts)), np.zeros(len(parts), np.int64)
    for start, run in _pieces(parts):
        stream, at = _joined(run)
        sums = _window_sums(stream, weights)
        sums[stream[: len(sums)] == 0] = -np.inf  # a window starts within its part
        for p, k in zip(run, at.tolist(), strict=True):
            if most is not None and len(p) > most:
                sums[k + most : k + len(p)] = -np.inf
        best = np.maximum.reduceat(sums, at)
        own = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(sums))))
        hit = np.flatnonzero(sums == best[own])
        first = hit[np.concatenate(([True], own[hit][1:] != own[hit][:-1]))]
        value[start : start + len(run)], place[start : start + len(run)] = best, first - at
    return value, place


def _cut(parts: list[np.ndarray], place: np.ndarray) -> np.ndarray:
    """The windows at these places, a row each."""
    out = np.zeros((len(parts), ROOM), np.uint8)
    for row, p, k in zip(out, parts, place.tolist(), strict=True):
        got = p[k : k + ROOM]
        row[: len(got)] = got
    return out


def window_features(window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(subsequences, weights) of one window, normed."""
    pairs = [(key, np.full(len(key), weight)) for key, weight in _keys(window)]
    key, weight = np.concatenate([k for k, _ in pairs]), np.concatenate([w for _, w in pairs])
    whole = np.ones(len(key), bool)
    for shift in (0, 5, 10, 15):
        whole &= (key >> shift) & 31 > 0
    key, at = np.unique(key[whole], return_inverse=True)
    return key, np.bincount(at, weight[whole], len(key)) / NORM


def kernels(windows: np.ndarray, keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Kernels of the windows to the landmarks, whose weights by subsequence are the table's columns."""
    index = np.full(1 << 20, len(keys), np.int32)
    index[keys] = np.arange(len(keys))
    padded = np.concatenate((table, np.zeros((1, table.shape[1]), table.dtype)))
    out = np.zeros((len(windows), table.shape[1]), np.float32)
    for k in range(0, len(windows), 512):
        part = windows[k : k + 512]
        row, place = np.nonzero(part[:, :WINDOW])
        flat = part.astype(np.int32)
        for (a, b, c), weight in zip(_SHAPES, _WEIGHTS, strict=True):
            at = index[flat[row, place] << 15 | flat[row, place + a] << 10 | flat[row, place + b] << 5 | flat[row, place + c]]
            some = np.flatnonzero(at < len(keys))
            if len(some):
                r = row[some]
                first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
                out[k + r[first]] += np.add.reduceat(padded[at[some]], first, axis=0) * np.float32(weight / NORM)
    return out.astype(np.float64)


class KernelMachine:
    """weights: one a subsequence; bias; scale and shift turn a document's value into a score."""

    def __init__(self):
        self.weights, self.bias, self.scale, self.shift, self.prior = None, 0.0, 1.0, 0.0, 0.0

    def documents(self, texts: list[str]) -> np.ndarray:
        """The value of each text's most telling window; a long text is cut into pieces that lap over by a window."""
        out = np.full(len(texts), -np.inf)
        parts, owner = [], []
        for i, t in enumerate(texts):
            whole = codes(t)
            for k in range(0, len(whole), PIECE):
                parts.append(whole[k : k + PIECE + ROOM])
                owner.append(i)
        np.maximum.at(out, owner, best_windows(parts, self.weights, PIECE)[0])
        return out + self.bias

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.documents(texts) + self.shift, -30, 30)))


def _hinge(x: np.ndarray, y: np.ndarray, c: np.ndarray, turns: int = 12) -> np.ndarray:
    """Newton's method for half the squared weights plus c times the squared hinge; the last feature is the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.ones(len(w))
    ridge[-1] = 1e-3
    for _ in range(turns):
        inside = y * (x @ w) < 1
        xi, ci = x[inside], c[inside]
        new = np.linalg.solve(np.diag(ridge) + (xi.T * ci) @ xi, (xi.T * ci) @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _telling(parts: list[np.ndarray], doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many more toxic documents than clean ones hold each subsequence: a logarithm."""
    seen = np.zeros((2, 1 << 20), np.int32)
    edges = [0, *(np.flatnonzero(np.diff(doc)) + 1).tolist(), len(doc)]
    for a, b in zip(edges, edges[1:], strict=False):
        here = np.zeros(1 << 20, bool)
        for key, _ in _keys(_joined(parts[a:b])[0]):
            here[key] = True
        seen[int(y[doc[a]])] += here
    own = np.unique(doc)
    share = (y[own] == 1).sum() / max(1, (y[own] == 0).sum())
    low = min(1.0, share)
    return np.log((seen[1] * (low / share) + 1) / (seen[0] * low + 1)).astype(np.float32)


def learn_sentences(parts: list[np.ndarray], doc: np.ndarray, y: np.ndarray, seed: int = 3) -> tuple[np.ndarray, float]:
    """(weights, bias) from sentences (codes), the document of each, and the documents' labels."""
    rng = np.random.default_rng(seed)
    toxic = y[doc] == 1
    weights, bias = _telling(parts, doc, y), 0.0
    for _ in range(TURNS):
        value, place = best_windows(parts, weights)
        # The most telling sentence of each document.
        order = np.lexsort((-value, doc))
        top = np.zeros(len(parts), bool)
        top[order[np.concatenate(([True], doc[order][1:] != doc[order][:-1]))]] = True
        held = toxic & (top | (value > np.quantile(value[~toxic], CLEAN)))
        yes, no = np.flatnonzero(held), np.flatnonzero(~toxic & top)
        some = np.flatnonzero(~toxic)[rng.permutation(int((~toxic).sum()))[: len(no)]]
        anywhere = np.array([rng.integers(max(1, len(parts[i]) - WINDOW)) for i in some])
        positive = np.unique(_cut([parts[i] for i in yes], place[yes]), axis=0)
        negative = np.unique(np.concatenate((_cut([parts[i] for i in no], place[no]), _cut([parts[i] for i in some], anywhere))), axis=0)
        # Landmarks: more of the class whose windows are alike.
        marks = np.concatenate([w[rng.permutation(len(w))[:n]] for w, n in ((positive, LANDMARKS * 3 // 4), (negative, LANDMARKS // 4))])
        made = [window_features(m) for m in marks]
        keys = np.unique(np.concatenate([k for k, _ in made]))
        table = np.zeros((len(keys), len(marks)), np.float32)
        for j, (k, v) in enumerate(made):
            table[np.searchsorted(keys, k), j] = v
        root, vector = np.linalg.eigh(table.T.astype(np.float64) @ table)
        keep = root > 1e-6 * root.max()
        white = vector[:, keep] / np.sqrt(root[keep])
        rows = kernels(np.concatenate((positive, negative)), keys, table)
        x = np.concatenate((rows @ white, np.ones((len(rows), 1))), 1)
        sign = np.where(np.arange(len(x)) < len(positive), 1.0, -1.0)
        cost = COST * np.where(sign > 0, max(1.0, len(negative) / len(positive)), 1.0)
        w = _hinge(x, sign, cost)
        weights, bias = np.zeros(1 << 20, np.float32), float(w[-1])
        weights[keys] = table @ (white @ w[:-1])
    return weights, bias


def learn(texts: list[str], y: np.ndarray, seed: int = 3) -> KernelMachine:
    """The machine from labelled documents (1: toxic). Scores are scaled (Platt) by the values of documents that it isn't trained on."""
    out = KernelMachine()
    out.prior = float(y.mean()) if len(y) else 0.0
    if not len(y) or y.min() == y.max():
        return out
    parts, doc, known = [], [], set()
    for i, (text, label) in enumerate(zip(texts, y.tolist(), strict=True)):
        for own in sentences_of(text):
            # A sentence counts once, so that a much copied document doesn't look like many.
            if (key := (own.tobytes(), label)) not in known:
                known.add(key)
                parts.append(own)
                doc.append(i)
    doc = np.array(doc)
    # Of either class a part is kept for scaling, so what is scaled are values of documents the machine hasn't seen.
    rng = np.random.default_rng(seed)
    held = np.zeros(len(y), bool)
    for label in (0, 1):
        own = rng.permutation(np.flatnonzero(y == label))
        held[own[: len(own) // SCALED]] = True
    at = np.flatnonzero(~held[doc])
    out.weights, out.bias = learn_sentences([parts[i] for i in at], doc[at], y, seed)
    if not held.any() or y[held].min() == y[held].max():
        held[:] = True
    value = out.documents([texts[i] for i in np.flatnonzero(held)])
    out.scale, out.shift = _scaled(value, y[held])
    return out


def _scaled(value: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(scale, shift) by Platt's method. The rarer class weighs more, by the root of the ratio of their numbers: half way to the scores
    that documents would have if either class were as frequent."""
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    weight = np.sqrt(n.max() / n)[y]
    t = np.where(y == 1, 1 - 1 / (n[1] + 2), 1 / (n[0] + 2))
    a, b = 2.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * value + b, -30, 30)))
        e, q = weight * (p - t), weight * p * (1 - p) + 1e-9
        h = np.array([[(q * value * value).sum() + 1e-3, (q * value).sum()], [(q * value).sum(), q.sum()]])
        d = np.linalg.solve(h + 1e-6 * np.eye(2), np.array([(e * value).sum() + 1e-3 * a, e.sum()]))
        a, b = a - float(np.clip(d[0], -2, 2)), b - float(np.clip(d[1], -2, 2))
    return a, b


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, sample: int = SAMPLE) -> KernelMachine:
    """Learns, in one task, from at most 3 * sample labelled documents (those of `where`)."""
    return common.trained(docs, labels, "toxic", sample, learn, where, 2 * sample) or KernelMachine()


def score(docs: DataFrame, model: KernelMachine, least: float = 0.3) -> DataFrame:
    """doc_id, score, predicted (1 if score >= least) for every row of `docs` (doc_id, text)."""
    step = lambda texts: {"score": model.score([t.decode("utf-8", "replace") for t in texts])}
    return common.scan(docs, step, "score double").withColumn("predicted", (F.col("score") >= least).cast("int"))
