"""Quality rules, and an isolation forest over their statistics.

The base rules are fixed by their definition. Every document's statistics are turned into ratios, so that
length alone is no anomaly. The forest (Liu, Ting and Zhou) splits at random, blind to labels, ROWS rows a tree, drawn from what is made up as
corpora are: labelled good rows, and one bad row to twenty. The threshold on the anomaly score is calibrated on all labelled rows. A document is kept
if no base rule fails and its score is at most the threshold.

Null or empty text: all statistics 0, base_failed (fewer than MIN_WORDS words). Equal rows get equal verdicts, null and repeated ids
each theirs; scores equal to the threshold are kept. Texts are read whole, however long. An empty table gives no rows, other columns aren't
read. Without labelled rows of either class the forest rejects nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import Words

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Trees; rows of a tree; share of good rows the threshold may lose; share of good rows whose repeats are ordinary.
TREES, ROWS, LOSS, ORDINARY = 100, 256, 0.002, 0.999
#: Words of an ordinary text that every document's ratios are mixed with.
PRIOR = 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_STATISTICS = ", ".join(f"{k} long" for k in (*COUNTS, "n_lines", "n_capitals"))
_RATIOS = ("r_chars", "r_symbols", "r_capitals", "r_repeat_words", "r_dup_lines")
_COUNTED = np.zeros((4, 256), np.uint8)
_COUNTED[0, [9, 10, 11, 12, 13, 32]] = 1  # white space
_COUNTED[1, 128:192] = 1  # continuation bytes
_COUNTED[2, list(SYMBOLS)] = 1
_COUNTED[3, 65:91] = 1  # capitals


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of COUNTS, and n_lines and n_capitals, of each text."""
    w = Words(texts)
    first = np.diff(w.first)
    per = lambda row: np.add.reduceat(row[w.buf], w.at[:-1], dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
    lengths = np.diff(w.at) - 1
    chars = lengths - (per(_COUNTED[0]) - 1) - per(_COUNTED[1])
    at, hashes = w.windows(WINDOW)
    own = hashes ^ (w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    same = np.zeros(len(own), bool)
    pairs = own[order][1:] == own[order][:-1]
    same[order[1:][pairs]] = True
    same[order[:-1][pairs]] = True
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, at[same], 1)
    np.add.at(cover, at[same] + WINDOW, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(cover)[:-1] > 0)))
    dup, lines = [], []
    for t in texts:
        real = [x for x in t.split(b"\n") if x and not x.isspace()]
        lines.append(len(real))
        dup.append(len(real) - len(set(real)))
    return {"n_words": first, "word_chars": chars, "n_symbols": per(_COUNTED[2]), "n_dup_lines": np.array(dup, np.int64), "n_repeat_words": covered[w.first[1:]] - covered[w.first[:-1]], "n_lines": np.array(lines, np.int64), "n_capitals": per(_COUNTED[3])}


def ratios(s: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest sees: a row of ratios a document, one a statistic, none of which follows its length. Each is drawn to an
    ordinary value by PRIOR words (or lines), so that a short text isn't odd by chance."""
    words = s["n_words"] + PRIOR
    columns = [(s["word_chars"] + 5.5 * PRIOR) / words, s["n_symbols"] / words, s["n_capitals"] / words, s["n_repeat_words"] / words, s["n_dup_lines"] / (s["n_lines"] + PRIOR)]
    return np.stack(columns, 1).astype(np.float64)


class IsolationForest:
    """Random splits, kept as arrays by tree and node: feature (-1: a leaf), cut, and the path length at leaves."""

    def __init__(self, x: np.ndarray, trees: int = TREES, rows: int = ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.rows = min(rows, len(x))
        self.depth = int(np.ceil(np.log2(max(2, self.rows))))
        size = 2 ** (self.depth + 1) - 1
        self.feature, self.cut, self.path = np.full((trees, size), -1, np.int32), np.zeros((trees, size)), np.zeros((trees, size))
        for t in range(trees):
            self._grow(t, 0, 0, x[rng.choice(len(x), self.rows, replace=False)], rng)

    def _grow(self, t: int, node: int, depth: int, x: np.ndarray, rng) -> None:
        low, high = x.min(0), x.max(0)
        open_ = np.flatnonzero(high > low)
        if depth == self.depth or len(x) <= 1 or not len(open_):
            self.path[t, node] = depth + expected(len(x))
            return
        f = rng.choice(open_)
        cut = rng.uniform(low[f], high[f])
        left = x[:, f] < cut
        self.feature[t, node], self.cut[t, node] = f, cut
        self._grow(t, 2 * node + 1, depth + 1, x[left], rng)
        self._grow(t, 2 * node + 2, depth + 1, x[~left], rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for what few splits isolate."""
        total = np.zeros(len(x))
        for feature, cut, path in zip(self.feature, self.cut, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[np.arange(len(x)), np.maximum(f, 0)] >= cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += path[node]
        return 2 ** (-total / len(self.path) / max(1e-9, expected(self.rows)))


def expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > REPEAT_PERCENT * s["n_words"])


class Rules:
    """forest; threshold of its score; bound: of repeated words and lines, what ordinary texts have."""

    def __init__(self, forest: IsolationForest | None, threshold: float = 1.0, bound: np.ndarray | None = None):
        self.forest, self.threshold, self.bound = forest, threshold, bound

    def score(self, s: dict[str, np.ndarray]) -> np.ndarray:
        x = ratios(s)
        return self.forest.score(_beyond(x, self.bound)) if self.forest else np.zeros(len(x))


def _beyond(x: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The rows with the last columns, of repeats, from their bound on. Most texts repeat nothing, and some good ones a line: to a forest
    that sees all of it any repeat is odd."""
    return np.concatenate((x[:, : -len(bound)], np.maximum(0, x[:, -len(bound) :] - bound)), 1)


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row of `docs` (doc_id, text)."""
    return common.scan(docs, lambda texts: statistics(texts), _STATISTICS)


def _statistics_of(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {k: batch.column(k).to_numpy() for k in (*COUNTS, "n_lines", "n_capitals")}


def quantiles(rows: DataFrame, wanted: dict[str, float]) -> dict[str, float]:
    """The quantile of each column, exactly and between two values as numpy's, over all rows. Columns hold the bits of doubles from 0 on, whose
    order is the doubles'; 16 bits at a time are counted, so at most 65,536 counts a value looked for reach the driver, of however many rows."""
    n = rows.count()
    place = {c: (n - 1) * q for c, q in wanted.items()}
    found = {(c, r): (0, r) for c, p in place.items() for r in (int(p), min(int(p) + 1, n - 1))}
    for shift in (48, 32, 16, 0):
        one = None
        for c in wanted:
            some = rows if shift == 48 else rows.where(F.shiftright(c, shift + 16).isin(sorted({at for (k, _), (at, _) in found.items() if k == c})))
            counts = some.groupBy(F.lit(c).alias("c"), F.shiftright(c, shift).alias("bin")).agg(F.count("*").alias("n"))
            one = counts if one is None else one.unionAll(counts)
        got = sorted(map(tuple, one.collect()))
        for key, (at, left) in found.items():
            for c, bin_, many in got:
                if c == key[0] and bin_ >> 16 == at:
                    if left < many:
                        found[key] = (bin_, left)
                        break
                    left -= many
    value = {key: float(np.int64(at).view(np.float64)) for key, (at, _) in found.items()}
    low, high = ({c: value[c, min(int(p) + i, n - 1)] for c, p in place.items()} for i in (0, 1))
    return {c: low[c] + (high[c] - low[c]) * (p - int(p)) for c, p in place.items()}


def fit(counts: DataFrame, labels: DataFrame, scratch: common.Scratch, loss: float = LOSS) -> Rules:
    """The forest; the threshold, half way from the score that all but `loss` of the good labelled rows keep within to the least
    score of a bad row above it; and the bounds of repeats, that all but 1 - ORDINARY of the good ones keep within. Every labelled row of
    `counts` (of counted()) counts for threshold and bounds. The trees draw their rows from TREES * ROWS, as many as they can read at all, of the
    smallest hashes; these alone, and counts, reach the driver. A doc_id with several labels counts with the largest one."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _statistics_of(b)
            x, ok = ratios(s), ~failed(s)
            yield pa.record_batch([pa.array(c[ok]) for c in (b.column("h").to_numpy(), b.column("y").to_numpy(), *x.T, *np.ascontiguousarray(x[:, -2:].T).view(np.int64))], ["h", "y", *_RATIOS, "repeat_words", "dup_lines"])

    kinds = ", ".join(f"{r} double" for r in _RATIOS)
    met = counts.join(known, "doc_id").select(F.xxhash64("doc_id").alias("h"), "y", *COUNTS, "n_lines", "n_capitals")
    rows = scratch.put(common.arrow(met, seen, f"h long, y int, {kinds}, repeat_words long, dup_lines long"), "labelled")
    good, bad = rows.where("y = 1"), rows.where("y = 0")
    first = lambda some, n: some.orderBy("h", *_RATIOS).limit(n).select(*_RATIOS).toPandas().to_numpy(np.float64)
    pool = first(good, TREES * ROWS)
    if not len(pool):
        return Rules(None)
    # The forest is to see the corpus as it is: mostly good rows.
    pool = np.concatenate((pool, first(bad, max(1, len(pool) // 20))))
    if len(pool) < 2:
        return Rules(None)
    bounds = quantiles(good, {"repeat_words": ORDINARY, "dup_lines": ORDINARY})
    bound = np.array([bounds["repeat_words"], bounds["dup_lines"]])
    forest = IsolationForest(_beyond(pool, bound))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = forest.score(_beyond(np.stack([b.column(r).to_numpy() for r in _RATIOS], 1), bound))
            yield pa.record_batch([b.column("y"), pa.array(score.view(np.int64)), pa.array(score)], ["y", "bits", "score"])

    scores = scratch.put(common.arrow(rows, scored, "y int, bits long, score double"), "scores")
    floor = quantiles(scores.where("y = 1"), {"bits": 1 - loss})["bits"] + 1e-9
    above = scores.where((F.col("y") == 0) & (F.col("score") > floor)).agg(F.min("score")).first()[0]
    return Rules(forest, floor if above is None else floor + (above - floor) / 2, bound)


def judge(counts: DataFrame, model: Rules) -> DataFrame:
    """doc_id, the counts, base_failed, kept, score of every row of `counts` (of counted())."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _statistics_of(b)
            bad, score = failed(s), model.score(s)
            yield pa.record_batch([b.column("doc_id"), *(b.column(k) for k in COUNTS), pa.array(bad), pa.array(~bad & (score <= model.threshold)), pa.array(score)], ["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])

    return common.arrow(counts, run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, anomaly double")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on `labels` and judges `docs`, whose texts are read once: their statistics are kept."""
    with common.Scratch(docs.sparkSession) as scratch:
        counts = scratch.last(counted(docs), "counts")
        return judge(counts, fit(counts, labels, scratch))
