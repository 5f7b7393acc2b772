"""Queries over the embeddings: exact search, distinct results, assignment, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..sources.tables import table
from .registry import query

#: Queries are the vectors whose id 20 divides, against all others; texts are the same where ids agree but for their last remainder by 3.
_HITS = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0), v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT query_id, vec_id, list_dot_product(q.e, v.e) AS score FROM q, v WHERE query_id <> vec_id),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 16)"""


def _hits(spark, sf_dir, k=16):
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.top_k(queries, rows, k, but_own=True)


def _distinct(spark, sf_dir, k=4):
    return R.distinct_top_k(_hits(spark, sf_dir).withColumn("content_id", F.col("vec_id") - F.col("vec_id") % 3), k)


@query(f"WITH {_HITS} SELECT query_id, rank::INT AS rank, vec_id, round(score, 6) AS score FROM h WHERE rank <= 8")
def knn_topk(spark, sf_dir):
    return _hits(spark, sf_dir, 8).withColumn("score", F.round("score", 6))


@query(f"""WITH {_HITS}, c AS (SELECT *, vec_id - vec_id % 3 AS content_id FROM h), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id, content_id ORDER BY score DESC, vec_id) = 1),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n, vec_id, content_id, score FROM b)
SELECT query_id, n::INT AS rank, vec_id, content_id, round(score, 6) AS score FROM r WHERE n <= 4""")
def knn_distinct_topk(spark, sf_dir):
    return _distinct(spark, sf_dir).withColumn("score", F.round("score", 6))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x : greatest(-127.0, least(127.0, round_even(x::DOUBLE * 127, 0))))::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) AS score FROM e q, e v WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, round(score / 16129, 6) AS score FROM s QUALIFY rank <= 4""")
def int8_quantised_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", R.quantised(F.col("embedding")).alias("embedding"))
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.top_k(queries, rows, 4, but_own=True).withColumn("score", F.round(F.col("score") / 16129, 6))


_BEST = f"WITH {_HITS}, w AS (SELECT query_id // 160 AS row_id, (query_id // 20) % 8 AS win, vec_id - vec_id % 30 AS content_id, score FROM h WHERE rank = 1)"


def _windows(spark, sf_dir, k):
    return _hits(spark, sf_dir, k).select(F.expr("query_id div 160").alias("row_id"), F.expr("(query_id div 20) % 8").alias("win"), "rank", "vec_id", F.expr("vec_id - vec_id % 30").alias("content_id"), "score")


@query(f"{_BEST} SELECT a.row_id, a.win AS win_a, b.win AS win_b, a.content_id FROM w a JOIN w b ON a.row_id = b.row_id AND a.content_id = b.content_id AND a.win < b.win")
def conflict_pairs(spark, sf_dir):
    return R.conflicts(_windows(spark, sf_dir, 1).select("row_id", "win", "content_id"))


@query()
def distinct_assignment(spark, sf_dir):
    return R.assign(_windows(spark, sf_dir, 16)).withColumn("score", F.round("score", 6))


@query()
def displacement_stats(spark, sf_dir):
    windows = _windows(spark, sf_dir, 16)
    got = R.assign(windows).select("row_id", "win", F.col("score").alias("got"))
    met = windows.where("rank = 1").join(got, ["row_id", "win"], "left")
    cost = F.col("score") - F.col("got")
    return met.agg(F.count("*").alias("windows"), F.avg(F.col("got").isNull().cast("int")).alias("missing"), F.avg((F.col("got") < F.col("score") - 1e-6).cast("int")).alias("displaced"), F.round(F.avg(cost), 6).alias("mean_cost"), F.round(F.percentile(cost, F.lit(0.95)), 6).alias("p95_cost"))


@query(f"WITH {_HITS} SELECT p, round(quantile_cont(score, p), 6) AS score FROM h, (VALUES (0.01), (0.05), (0.25), (0.5), (0.75), (0.95), (0.99)) t(p) WHERE rank = 1 GROUP BY p".replace("quantile_cont(score, p)", "list_extract(quantile_cont(score, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]), CASE p WHEN 0.01 THEN 1 WHEN 0.05 THEN 2 WHEN 0.25 THEN 3 WHEN 0.5 THEN 4 WHEN 0.75 THEN 5 WHEN 0.95 THEN 6 ELSE 7 END)").replace("SELECT p,", "SELECT p::DOUBLE AS p,"))
def score_percentiles(spark, sf_dir):
    points = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    at = F.array(*map(F.lit, points))
    got = _hits(spark, sf_dir, 1).agg(F.percentile("score", at).alias("v"))
    return got.select(F.explode(F.arrays_zip(at.alias("p"), F.col("v"))).alias("x")).select("x.p", F.round("x.v", 6).alias("score"))


@query(f"WITH {_HITS} SELECT CASE WHEN score >= 0.5 THEN 'green' WHEN score >= 0.3 THEN 'yellow' ELSE 'red' END AS bucket, count(*) AS hits FROM h GROUP BY 1")
def score_buckets(spark, sf_dir):
    return _hits(spark, sf_dir).groupBy(R.colour(F.col("score")).alias("bucket")).agg(F.count("*").alias("hits"))


@query(f"WITH {_HITS} SELECT vec_id // 5 AS article, count(*) AS hits FROM h GROUP BY 1 ORDER BY hits DESC, article LIMIT 10")
def top_referenced(spark, sf_dir):
    return _hits(spark, sf_dir).groupBy(F.expr("vec_id div 5").alias("article")).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "article").limit(10)


@query(f"WITH {_HITS} SELECT query_id // 160 AS row_id, round(max(score), 6) AS best FROM h GROUP BY 1 HAVING max(score) >= 0.35")
def min_score_rows(spark, sf_dir):
    return _hits(spark, sf_dir, 1).groupBy(F.expr("query_id div 160").alias("row_id")).agg(F.max("score").alias("best")).where("best >= 0.35").withColumn("best", F.round("best", 6))
