"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every vector is then put into its leaf. How many leaves a search visits is calibrated with a few
queries against brute force over all vectors. A query goes down to the nearest
child and keeps the others in a priority queue by distance; it takes the nearest open branch next, until
it has visited as many leaves as calibration asks for, and until these hold enough candidates.

Vectors are dealt by the hash of their id over SHARES shares, so neither a full leaf nor a popular one lands in one task; queries, in parts of
about QUERIES, go to every share with the set of their leaves. A task reads a share's vectors leaf by leaf and keeps each query's k best so
far, so what it gives is k rows a query and share, however many leaves there are. Equal vectors are at one distance, ties go to the smaller id, so only the k + 1
smallest ids of each can be results: the others are left out before anything is joined, which loses nothing.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do null ids.
Rows that repeat an id are rows of their own: each is a candidate, and a query's results leave out its own row alone; so an id can be
in a result more than once, and a repeated query id has a result for each of its rows. Other columns aren't read. An empty table gives
an empty result; of fewer candidates than k there are as many results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors the tree is fitted on at most; children of a node; sample vectors of a leaf; recall to calibrate to; queries to calibrate with.
SAMPLE, BRANCH, LEAF, RECALL, PROBES = 20_000, 16, 32, 0.95, 300
#: Shares that vectors are dealt over; queries of a part, that a task holds; vectors and queries that are compared at a time; pairs measured at a time.
SHARES, QUERIES, VECTORS, ROWS, PAIRS = 64, 32_768, 512, 1024, 65_536


class Tree:
    """centre of each node, its children (none: a leaf); visits: leaves that a search goes to."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 13):
        rng = np.random.default_rng(seed)
        self.centre, self.children = [x.mean(0)], [[]]
        open_ = [(0, np.arange(len(x)))]
        while open_:
            node, rows = open_.pop()
            if len(rows) <= leaf:
                continue
            label = _kmeans(x[rows], branch, rng)
            groups = [rows[label == k] for k in np.unique(label)]
            if len(groups) < 2:
                continue
            for g in groups:
                self.children[node].append(len(self.centre))
                open_.append((len(self.centre), g))
                self.centre.append(x[g].mean(0))
                self.children.append([])
        self.centre = np.array(self.centre)
        self.visits = 1

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, going to the nearest child all the way down."""
        at = np.zeros(len(x), np.int64)
        moving = np.arange(len(x))
        while len(moving):
            still = []
            for node in np.unique(at[moving]):
                rows = moving[at[moving] == node]
                if kids := self.children[node]:
                    c = self.centre[kids]
                    at[rows] = np.array(kids)[((c**2).sum(1) - 2 * x[rows] @ c.T).argmin(1)]
                    still.append(rows)
            moving = np.concatenate(still) if still else []
        return at

    def search(self, q: np.ndarray, counts: dict[int, int], visits: int, least: int) -> list[int]:
        """Leaves best bin first: `visits` of them, and more until they hold `least` vectors."""
        heap, out, have = [(0.0, 0)], [], 0
        while heap and (len(out) < visits or have < least):
            _, node = heapq.heappop(heap)
            while kids := self.children[node]:
                d = ((self.centre[kids] - q) ** 2).sum(1)
                near = int(d.argmin())
                for k, kid in enumerate(kids):
                    if k != near:
                        heapq.heappush(heap, (float(d[k]), kid))
                node = kids[near]
            out.append(node)
            have += counts.get(node, 0)
        return out

    def calibrate(self, probes: np.ndarray, near: list[np.ndarray], counts: dict[int, int], recall: float = RECALL) -> None:
        """Widens the visits until `recall` of the probes' nearest vectors are in the visited leaves."""
        ranks = []
        for q, v in zip(probes, near, strict=True):
            order = {n: r for r, n in enumerate(self.search(q, counts, len(self.centre), 0))}
            ranks += [order[n] for n in self.leaf_of(v).tolist()] if len(v) else []
        if ranks:
            self.visits = int(np.quantile(ranks, recall, method="higher")) + 1


def _kmeans(x: np.ndarray, k: int, rng, turns: int = 8) -> np.ndarray:
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(turns):
        label = ((centre**2).sum(1) - 2 * x @ centre.T).argmin(1)
        new = np.stack([x[label == j].mean(0) if (label == j).any() else centre[j] for j in range(len(centre))])
        if np.allclose(new, centre):
            break
        centre = new
    return label


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, nth, embedding) of the vectors that take part; nth tells rows of one vec_id apart."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0)
    nth = F.row_number().over(Window.partitionBy("vec_id").orderBy("embedding"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(ok).withColumn("nth", nth).select("vec_id", "nth", "embedding")


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def nearest(rows: DataFrame, query: Column, k: int = 10, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest found to the rows where `query` (of vec_id) holds."""
    with common.Scratch(rows.sparkSession) as scratch:
        return scratch.last(_nearest(rows, query, k, sample, recall, scratch))


def _nearest(rows: DataFrame, query: Column, k: int, sample: int, recall: float, scratch: common.Scratch) -> DataFrame:
    spark = rows.sparkSession
    taken = scratch.put(usable(rows), "vectors")
    drawn = taken.orderBy(F.xxhash64("vec_id"), "vec_id", "nth").limit(sample).toPandas()
    if not len(drawn):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = drawn["embedding"].map(len)
    width = int(sizes.mode().iloc[0])
    taken = taken.where(F.size("embedding") == width)
    x = np.array(drawn["embedding"][sizes == width].tolist(), np.float64)
    tree = Tree(x)
    kind = dict(taken.dtypes)["embedding"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.record_batch([pa.array(tree.leaf_of(_vectors(b.column(2)))), *b.columns], ["leaf", "vec_id", "nth", "embedding"])

    equal = Window.partitionBy("embedding").orderBy("vec_id", "nth")
    first = taken.withColumn("_of_equal", F.row_number().over(equal)).where(F.col("_of_equal") <= k + 1).drop("_of_equal")
    index = scratch.put(common.arrow(first, place, f"leaf long, vec_id long, nth int, embedding {kind}"), "index")
    # As many rows as the tree has leaves, which the sample bounds.
    sizes_of = lambda rows: {r["leaf"]: r["n"] for r in rows.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    counts, nodes = sizes_of(index), len(tree.centre)
    tree.calibrate(*_probed(index, taken, nodes, k), counts, recall)
    visits, least = tree.visits, k + 1

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                seen = np.zeros((len(b), nodes), bool)
                for row, q in zip(seen, _vectors(b.column(2)), strict=True):
                    row[tree.search(q, counts, visits, least)] = True
                yield pa.record_batch([pa.array([x.tobytes() for x in np.packbits(seen, axis=1)], pa.binary()), *b.columns], ["leaves", "id", "nth", "embedding"])

    asked = scratch.put(common.arrow(taken.where(query), visit, f"leaves binary, id long, nth int, embedding {kind}"), "asked")
    found = _found(index, asked, max(1, -(-asked.count() // QUERIES)), k)
    rank = F.row_number().over(Window.partitionBy("query_id", "nth").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _probed(index: DataFrame, taken: DataFrame, nodes: int, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """PROBES vectors and, of each, its k nearest of all vectors, by brute force: of the sample alone leaves would hold more of them,
    because they were fitted to it."""
    drawn = taken.orderBy(F.xxhash64("vec_id").desc(), "vec_id", "nth").limit(PROBES).select("vec_id", "nth", "embedding").toPandas()
    every = F.lit(b"\xff" * (nodes // 8 + 1)).alias("leaves")
    probes = taken.sparkSession.createDataFrame(drawn, taken.select("vec_id", "nth", "embedding").schema).select(every, F.col("vec_id").alias("id"), "nth", "embedding")
    rank = F.row_number().over(Window.partitionBy("query_id", "nth").orderBy("score", "vec_id"))
    found = _found(index, probes, 1, k).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("nth").alias("of"), "vec_id")
    # PROBES * k rows, and more for repeated ids.
    met = index.join(F.broadcast(found), "vec_id").select("query_id", "of", "embedding").toPandas()
    near = {key: np.array(g["embedding"].tolist(), np.float64) for key, g in met.groupby(["query_id", "of"])}
    x = np.array(drawn["embedding"].tolist(), np.float64)
    return x, [near.get(key, x[:0]) for key in zip(drawn["vec_id"], drawn["nth"], strict=True)]


def _found(index: DataFrame, asked: DataFrame, parts: int, k: int) -> DataFrame:
    """query_id, nth, vec_id, score of each query's k nearest in each share, of the vectors in its leaves."""
    place = F.xxhash64("id", "nth")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    vectors = index.withColumnRenamed("vec_id", "id").select(F.pmod(place, F.lit(SHARES)).cast("int").alias("share"), every(parts).alias("part"), "leaf", "id", "nth", "embedding", F.lit(None).cast("binary").alias("leaves"))
    queries = asked.select(every(SHARES).alias("share"), F.pmod(place, F.lit(parts)).cast("int").alias("part"), F.lit(-1).cast("long").alias("leaf"), "id", "nth", "embedding", "leaves")
    # A share's queries come first, then its vectors by their leaves.
    met = queries.unionAll(vectors).repartition(SHARES * parts, "share", "part").sortWithinPartitions("share", "part", "leaf")
    return common.arrow(met, _meet(k), "query_id long, nth int, vec_id long, score double")


class _Best:
    """The k nearest so far of some queries (ids, nth, q), that visit the leaves of a bit each."""

    def __init__(self, ids: np.ndarray, nth: np.ndarray, q: np.ndarray, leaves: np.ndarray, k: int):
        self.ids, self.nth, self.q, self.leaves, self.k = ids, nth, q, leaves, k
        self.square = (q**2).sum(1)
        self.score, self.vec = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)

    def meet(self, leaf: np.ndarray, ids: np.ndarray, nth: np.ndarray, v: np.ndarray) -> None:
        """Takes in some vectors, ordered by leaf."""
        ends = np.concatenate((np.flatnonzero(np.diff(leaf)) + 1, [len(leaf)]))
        runs = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
        square, own = (v**2).sum(1), np.flatnonzero(np.isin(ids, self.ids)).tolist()
        for a in range(0, len(self.q), ROWS):
            part = slice(a, a + ROWS)
            q = self.q[part]
            about = np.full((len(q), len(v)), np.inf)  # the squared distance less the query's own square
            for i, j in runs:
                at = np.flatnonzero(self.leaves[part, leaf[i] >> 3] >> (7 - (leaf[i] & 7)) & 1)
                about[at, i:j] = square[i:j] - 2 * q[at] @ v[i:j].T
            for j in own:
                about[(self.ids[part] == ids[j]) & (self.nth[part] == nth[j]), j] = np.inf
            self._take(part, about, ids, v)

    def _take(self, part: slice, about: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        k, q = self.k, self.q[part]
        # All that can be nearer than the k-th, or as near, are measured.
        limit = self.score[part, -1] ** 2 - self.square[part]
        if about.shape[1] > k:
            limit = np.minimum(limit, np.partition(about, k - 1, axis=1)[:, k - 1])
        known = np.isfinite(limit)
        limit[known] += 1e-9 * (1 + np.abs(limit[known]) + self.square[part][known])
        of, at = np.nonzero((about <= limit[:, None]) & np.isfinite(about))
        if not len(of):
            return
        exact = np.concatenate([np.sqrt(((v[at[i : i + PAIRS]] - q[of[i : i + PAIRS]]) ** 2).sum(1)) for i in range(0, len(of), PAIRS)])
        rows = np.concatenate((np.repeat(np.arange(len(q)), k), of))
        score, vec = np.concatenate((self.score[part].ravel(), exact)), np.concatenate((self.vec[part].ravel(), ids[at]))
        many = k + np.bincount(of, minlength=len(q))
        best = np.lexsort((vec, score, rows))[((np.cumsum(many) - many)[:, None] + np.arange(k)).ravel()]
        self.score[part], self.vec[part] = score[best].reshape(-1, k), vec[best].reshape(-1, k)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.q), ROWS):
            of, at = np.nonzero(np.isfinite(self.score[a : a + ROWS]))
            of += a
            yield pa.record_batch([pa.array(self.ids[of], pa.int64()), pa.array(self.nth[of], pa.int32()), pa.array(self.vec[of, at], pa.int64()), pa.array(self.score[of, at], pa.float64())], ["query_id", "nth", "vec_id", "score"])


def _meet(k: int):
    """Of rows ordered by share, part and leaf (-1: a query), the k nearest of each share's vectors to each of its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, best = None, [], None
        for b in batches:
            share, part, leaf, ids, nth = (b.column(i).to_numpy() for i in range(5))
            # Runs of one share, part and kind.
            ends = np.flatnonzero((np.diff(share) != 0) | (np.diff(part) != 0) | (np.diff(leaf < 0))) + 1
            for i, j in zip([0, *ends.tolist()], [*ends.tolist(), len(b)], strict=True):
                if i == j:
                    continue
                if now != (now := (share[i], part[i])):
                    if best:
                        yield from best.rows()
                    asked, best = [], None
                if leaf[i] < 0:
                    bits = np.frombuffer(b"".join(b.column(6)[i:j].to_pylist()), np.uint8).reshape(j - i, -1)
                    asked.append((ids[i:j], nth[i:j], _vectors(b.column(5)[i:j]), bits))
                elif asked or best:
                    if asked:
                        best, asked = _Best(*map(np.concatenate, zip(*asked, strict=True)), k), []
                    for a in range(i, j, VECTORS):
                        z = min(j, a + VECTORS)
                        best.meet(leaf[a:z], ids[a:z], nth[a:z], _vectors(b.column(5)[a:z]))
        if best:
            yield from best.rows()

    return run
