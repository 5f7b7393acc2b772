"""Articles to chunks, chunks to vectors, and what was found to rows: the steps around the index."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .corpus import chunk_starts, running_sum, strip_sections


def chunks(articles: DataFrame, size: int, overlap: int) -> DataFrame:
    """article_row, chunk_idx, chunk of `articles` (article_row, title_ids, body_ids: token arrays): each chunk starts with the title,
    held to half of it; the rest laps over the last chunk's. Articles shorter than a chunk have none."""
    title = F.slice("title_ids", 1, size // 2)
    room = F.lit(size) - F.size("_t")
    n = F.size("body_ids").cast("long")
    cut = articles.withColumn("_t", title).withColumn("_room", room.cast("long"))
    starts = cut.select("article_row", "_t", "_room", "body_ids", F.posexplode(chunk_starts(n, F.col("_room"), overlap)).alias("chunk_idx", "_s"))
    return starts.select("article_row", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.concat("_t", F.slice("body_ids", (F.col("_s") + 1).cast("int"), F.col("_room").cast("int"))).alias("chunk"))


def numbered(rows: DataFrame) -> DataFrame:
    """`rows` (article_row, chunk_idx) with chunk_id, dense in their order; parts of 4096 articles are numbered on their own."""
    part = rows.withColumn("_part", F.expr("article_row div 4096")).withColumn("_one", F.lit(1))
    return running_sum(part, "_one", "_n", "_part", ("article_row", "chunk_idx")).withColumn("chunk_id", F.col("_n") - 1).drop("_part", "_one", "_n")


def windows(docs: DataFrame, size: int = 256, most: int = 8, drop: int | None = None) -> DataFrame:
    """doc_id, win, tokens: the first `most` runs of `size` tokens, without the token `drop`."""
    cut = docs.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda w: F.slice("tokens", w * size + 1, size))).alias("win", "tokens"))
    cut = cut.where(F.size("tokens") > 0)
    return cut if drop is None else cut.withColumn("tokens", F.array_remove("tokens", drop))


class HashingEmbedder:
    """A vector of a text without a model: its words' hashes, added up by sign, of length 1. Stands in where an
    encoder is to be plugged in: anything with `width` and `embed(list of texts)`."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for i, t in enumerate(texts):
            for w in t.split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % self.width] += 1 if h >> 63 else -1
        return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))


def embedded(rows: DataFrame, text: str, embedder=None) -> DataFrame:
    """`rows` with embedding, from batches of texts."""
    made = embedder or HashingEmbedder()

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(made.embed(texts.fillna("").tolist()).astype(np.float32)))

    return rows.withColumn("embedding", run(text))


def filled(windows_: DataFrame, assigned: DataFrame, tokens: DataFrame) -> DataFrame:
    """row_id, win, ref_tokens: the chunks (vec_id, tokens) that windows were given; null where none was."""
    met = windows_.join(assigned, ["row_id", "win"], "left").join(tokens.select("vec_id", F.col("tokens").alias("ref_tokens")), "vec_id", "left")
    return met.select("row_id", "win", "vec_id", "ref_tokens")


def refs(hits: DataFrame) -> DataFrame:
    """physical, ids, scores of `hits` (query_id, rank, vec_id, score), best first."""
    listed = hits.groupBy(F.col("query_id").alias("physical")).agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("a"))
    return listed.select("physical", F.transform("a", lambda x: x["vec_id"]).alias("ids"), F.transform("a", lambda x: x["score"]).alias("scores"))


def without_done(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't among `done`."""
    return rows.join(done.select(*key).distinct(), key, "left_anti")


def segments(rows: DataFrame, column: str, mark: int) -> DataFrame:
    """`rows` with segments: the array cut at each `mark`, empty parts left out."""
    cut = F.aggregate(
        column,
        F.array(F.array().cast("array<int>")),
        lambda a, x: F.when(x == mark, F.concat(a, F.array(F.array().cast("array<int>")))).otherwise(F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.array_append(F.element_at(a, -1), x.cast("int"))))),
    )
    return rows.withColumn("segments", F.filter(cut, lambda s: F.size(s) > 0))


def cleaned(text):
    return strip_sections(text)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in an order, as a newer file replaces an older one."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
