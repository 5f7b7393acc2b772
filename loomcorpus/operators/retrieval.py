"""Exact nearest neighbours by inner product, distinct results, assignment without conflicts, score statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries, and vectors, of a block.
QUERIES, VECTORS = 4096, 16_384


def quantised(vector: Column) -> Column:
    """Each component times 127, rounded half to even, between -127 and 127: whole numbers, so inner products (16129 times
    those of the components) are exact and ties are ties."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x.cast("double") * 127))))


def _blocks(rows: DataFrame, key: str, size: int, least: int, *by: str) -> tuple[DataFrame, int]:
    """(by, block, ids, vectors) of `rows` (key, embedding), about `size` a block and `least` blocks where there are so many rows; their number."""
    many = max(1, -(-(n := rows.count()) // size), min(least, n // 256))
    block = F.pmod(F.xxhash64(key), F.lit(many)).cast("int").alias("block")
    listed = rows.groupBy(*by, block).agg(F.collect_list(F.struct(F.col(key).cast("long").alias("id"), "embedding")).alias("a"))
    return listed.select(*by, "block", F.transform("a", lambda x: x["id"]).alias("ids"), F.transform("a", lambda x: x["embedding"]).alias("vectors")), many


def local_hits(queries: DataFrame, rows: DataFrame, k: int, *by: str, but_own: bool = False) -> DataFrame:
    """by, query_id, vec_id, score: from each block of rows (vec_id, embedding) the k of largest inner product with each query
    (query_id, embedding), which hold all of the block that can be in a result. With but_own, rows of the query's own id,
    however many, are left out before the k are chosen.

    Both sides are put into blocks of bounded size; each block of queries meets each block of rows in a task of its own, by a join on the two
    blocks' numbers, and no side passes through the driver or is sent whole to a task."""
    q, of_q = _blocks(queries, "query_id", QUERIES, 1)
    v, of_v = _blocks(rows, "vec_id", VECTORS, 16, *by)
    q = q.select(F.col("block").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(of_v - 1))).alias("vb"), F.col("ids").alias("qi"), F.col("vectors").alias("qv"))
    v = v.select(*by, F.col("block").alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(of_q - 1))).alias("qb"), F.col("ids").alias("vi"), F.col("vectors").alias("vv"))
    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in by)
    return v.join(q, ["qb", "vb"]).select(*by, "qi", "qv", "vi", "vv").mapInArrow(_meet(len(by), k, but_own), (kinds + ", " if by else "") + "query_id long, vec_id long, score double")


def top_k(queries: DataFrame, rows: DataFrame, k: int, but_own: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score of the k rows (vec_id, embedding) of largest inner product with each query
    (query_id, embedding); ties go to the smaller id. With but_own, the row of the query's own id isn't a hit."""
    found = local_hits(queries, rows, k + but_own)
    return merged(found.where("query_id <> vec_id") if but_own else found, k)


def shard_hits(queries: DataFrame, rows: DataFrame, k: int, but_own: bool = False) -> DataFrame:
    """query_id, shard, vec_id, score: the k best rows (shard, vec_id, embedding) of each shard, to be kept and merged; with but_own, of
    those that haven't the query's own id."""
    rank = F.row_number().over(Window.partitionBy("query_id", "shard").orderBy(F.desc("score"), "vec_id"))
    return local_hits(queries, rows.select("shard", "vec_id", "embedding"), k, "shard", but_own=but_own).withColumn("_n", rank).where(F.col("_n") <= k).drop("_n")


def merged(hits: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of `hits` from any number of places."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(about: np.ndarray, ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int, slack: float, own: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and inner products of the k best rows of x whose id isn't `own`. A matrix product adds up in an order of its own, so equal vectors may differ in
    their last bits: all rows that may be among the k by it are summed again from the first component to the last, as SQL does."""
    near = np.arange(len(x))
    if own is not None and (same := ids == own).any():
        near, about = np.flatnonzero(~same), about[~same]
    if len(near) > k and np.isfinite(about).all():
        near = near[about >= np.partition(about, -k)[-k] - 2 * slack]
    exact = np.cumsum(x[near] * q, axis=1)[:, -1]
    order = np.lexsort((ids[near], -exact))[:k]
    return near[order], exact[order]


def _meet(by: int, k: int, but_own: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                qi, qv, vi, vv = (b.column(by + j)[i].values for j in range(4))
                ids, vec, x, q = qi.to_numpy(), vi.to_numpy(), _vectors(vv), _vectors(qv)
                near, scores, slack = [], [], 2 * x.shape[1] * np.finfo(float).eps * np.sqrt((x**2).sum(1).max())
                for a in range(0, len(q), 256):
                    for about, one, own in zip(q[a : a + 256] @ x.T, q[a : a + 256], ids[a : a + 256], strict=True):
                        best, exact = _best(about, vec, x, one, k, slack * np.sqrt(one @ one), own if but_own else None)
                        near.append(best)
                        scores.append(exact)
                many, at = [len(n) for n in near], np.concatenate(near)
                key = [pa.array([b.column(j)[i].as_py()] * len(at), b.column(j).type) for j in range(by)]
                values = [pa.array(np.repeat(ids, many)), pa.array(vec[at]), pa.array(np.concatenate(scores))]
                yield pa.record_batch(key + values, [*b.schema.names[:by], "query_id", "vec_id", "score"])

    return run


def distinct_top_k(hits: DataFrame, k: int) -> DataFrame:
    """Of `hits` (query_id, vec_id, score, content_id) the best of each text, ranked anew, up to k; no padding."""
    best = F.row_number().over(Window.partitionBy("query_id", "content_id").orderBy(F.desc("score"), "vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("_b", best).where("_b = 1").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "content_id", "score")


def conflicts(best: DataFrame) -> DataFrame:
    """Pairs of one row's windows (row_id, win, content_id) that hold the same text."""
    a, b = best.alias("a"), best.alias("b")
    met = a.join(b, ["row_id", "content_id"]).where("a.win < b.win")
    return met.select("row_id", F.col("a.win").alias("win_a"), F.col("b.win").alias("win_b"), "content_id")


def assign(candidates: DataFrame) -> DataFrame:
    """row_id, win, vec_id, score: each window of a row gets a candidate so that no two hold the same text.

    Windows ask for their candidates (row_id, win, rank, vec_id, content_id, score) best first; a text stays with the window
    that scores higher (ties: the smaller window), and the other asks for its next. A window that runs out gets none.
    The result doesn't depend on the order of asking. A row's candidates are few, so a task holds a row at a time.
    """

    def row(rows: pd.DataFrame) -> pd.DataFrame:
        lists = {w: g.sort_values("rank")[["vec_id", "content_id", "score"]].to_numpy(object) for w, g in rows.groupby("win")}
        at, holder, open_ = dict.fromkeys(lists, 0), {}, sorted(lists, reverse=True)
        while open_:
            w = open_.pop()
            if at[w] >= len(lists[w]):
                continue
            _, content, score = lists[w][at[w]]
            other = holder.get(content)
            if other is None or (-score, w) < (-lists[other][at[other]][2], other):
                holder[content] = w
                loser = other
            else:
                loser = w
            if loser is not None:
                at[loser] += 1
                open_.append(loser)
        out = [(rows["row_id"].iloc[0], w, *lists[w][at[w]][[0, 2]]) for w in sorted(holder.values())]
        return pd.DataFrame(out, columns=["row_id", "win", "vec_id", "score"])

    return candidates.groupBy("row_id").applyInPandas(row, "row_id long, win long, vec_id long, score double")


def colour(score: Column) -> Column:
    return F.when(score >= 0.5, "green").when(score >= 0.3, "yellow").otherwise("red")
