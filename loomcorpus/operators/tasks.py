"""Tasks as tables of items: concatenation with offsets, seeded mixtures, subsets, letters and tokens, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .evals import shuffled


def sequence(parts: list[DataFrame]) -> DataFrame:
    """idx, task, local: the tasks (local, dense from 0) one after the other; a task's items start where those before it end."""
    rows, sizes = None, None
    for k, part in enumerate(parts):
        one = part.select(F.lit(k).alias("task"), F.col("local").cast("long").alias("local"))
        rows = one if rows is None else rows.unionAll(one)
    sizes = rows.groupBy("task").agg(F.count("*").alias("n"))
    after = sizes.alias("a").join(sizes.alias("b"), F.col("b.task") < F.col("a.task"), "left").groupBy(F.col("a.task").alias("task")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("start"))
    return rows.join(F.broadcast(after), "task").select((F.col("start") + F.col("local")).alias("idx"), "task", "local")


def shuffled_places(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """place, idx: the order that Python's own seeded shuffle gives n items."""
    return shuffled(spark, n, seed).withColumnRenamed("physical", "idx")


def mixture(spark: SparkSession, parts: list[DataFrame], seed: int = 42) -> DataFrame:
    """place, task, local: all items of the tasks (a task given n times counts n times) in the order of the seeded shuffle."""
    rows = sequence(parts)
    return shuffled_places(spark, rows.count(), seed).join(rows, "idx").select("place", "task", "local")


def head_of_order(rows: DataFrame, order: DataFrame, n: int) -> DataFrame:
    """place and the columns of the rows (idx) that come first in a seeded order (place, idx)."""
    return order.where(F.col("place") < n).join(rows, "idx")


def shard_ids(spark: SparkSession, wanted: int, last: int) -> DataFrame:
    """shard: the first `wanted` of the shards 0 to last - 1, and always the last, which is for validation."""
    return spark.range(min(wanted, last)).select(F.col("id").alias("shard")).union(spark.range(last, last + 1)).distinct()


def unknown(asked: DataFrame, known: DataFrame) -> DataFrame:
    """The values of `asked` that `known` doesn't have."""
    return asked.select(asked.columns[0]).subtract(known.select(known.columns[0]))


def check_keys(keys: list[str], known: list[str], reserved: tuple[str, ...] = ("train", "val")) -> None:
    """An error for keys that are reserved or unknown."""
    if bad := sorted(set(keys) & set(reserved)):
        raise ValueError(f"reserved: {', '.join(bad)}")
    if bad := sorted(set(keys) - set(known)):
        raise ValueError(f"unknown: {', '.join(bad)}")


def letter_tokens(letters: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """letter, token_id: the token that is the letter (letter) and nothing else, in a vocabulary (token_id, bytes, is_special). A letter
    without one is an error, when it is read."""
    met = letters.join(vocabulary.where("NOT is_special").select("token_id", "bytes"), F.encode("letter", "UTF-8") == F.col("bytes"), "left")
    return met.groupBy("letter").agg(F.min("token_id").alias("token_id")).select("letter", F.coalesce("token_id", F.raise_error(F.concat(F.lit("more than one token: "), "letter")).cast("int")).alias("token_id"))


def target_bytes(targets: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """`targets` (target) with n_bytes of the token; 0 for special tokens and for ignored targets (below 0). The vocabulary, a row a token, is
    joined by the size that Spark finds it to have."""
    return targets.join(vocabulary.select(F.col("token_id").alias("target"), "n_bytes"), "target", "left").withColumn("n_bytes", F.when(F.col("target") >= 0, F.coalesce("n_bytes", F.lit(0))).otherwise(0))


def titles(hits: DataFrame, chunks: DataFrame, articles: DataFrame) -> DataFrame:
    """`hits` (chunk_id) with article_row, chunk_idx and title, by the chunks' and the articles' tables."""
    return hits.join(chunks.select("chunk_id", "article_row", "chunk_idx"), "chunk_id").join(articles.select("article_row", "title"), "article_row")


def bounds(total: Column, world: int) -> Column:
    """array of (start, stop) of `world` parts of `total` rows that differ by one at most, the larger first."""
    few, more = F.floor(total / world).cast("long"), total % world
    start = lambda r: r * few + F.least(r, more)
    return F.transform(F.sequence(F.lit(0), F.lit(world - 1)), lambda r: F.struct(start(r).cast("long").alias("start"), start(r + 1).cast("long").alias("stop")))


def inner_mark(tokens: Column, mark: int) -> Column:
    """Whether the mark stands anywhere but at the first place."""
    return F.array_contains(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), mark)


def ref_summary(hits: DataFrame, wanted: int) -> DataFrame:
    """key, items, short (items with fewer than `wanted` references), p5, p50, p95 of the scores, of hits (key, item, score)."""
    per = hits.groupBy("key", "item").agg(F.count("*").alias("n"))
    few = per.groupBy("key").agg(F.count("*").alias("items"), F.count_if(F.col("n") < wanted).alias("short"))
    at = F.percentile("score", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    scores = hits.groupBy("key").agg(at.alias("p"))
    return few.join(scores, "key").select("key", "items", "short", F.col("p")[0].alias("p5"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p95"))


def missing_refs(assigned: DataFrame, chunks: DataFrame) -> DataFrame:
    """Assigned references (vec_id) that no chunk is there for; -1 is one."""
    return assigned.join(chunks.select("vec_id"), "vec_id", "left_anti")
