"""Queries over scores, derived from the tables' ids so that any engine makes the same ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources.tables import table
from .registry import query


@query("""SELECT lang, sum(b)::BIGINT AS n_bytes, round(sum(nats) / (ln(2) * sum(b)), 6) AS bpb FROM (SELECT lang, (doc_id % 97) / 10.0 AS nats, octet_length(encode(text)) AS b FROM documents WHERE doc_id % 7 <> 0) GROUP BY lang""")
def bits_per_byte(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select("lang", (F.col("doc_id") % 97 / 10).alias("nats"), F.octet_length("text").alias("n_bytes"), F.when(F.col("doc_id") % 7 == 0, -1).otherwise(1).alias("target"))
    return M.bits_per_byte(tokens, "lang").select("lang", F.col("n_bytes"), F.round("bpb", 6).alias("bpb"))


def _scored(spark, sf_dir):
    """task, correct for each document: its source is the task."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("task"), ((F.col("doc_id") * 7 + F.col("n_chars")) % 5 < 2).alias("correct"))


_SCORED = "SELECT source AS task, (doc_id * 7 + n_chars) % 5 < 2 AS correct FROM documents"
_BASE = "CASE WHEN task IN ('src1', 'src2', 'src3') THEN 25.0 ELSE 0.0 END"


@query(f"WITH a AS (SELECT task, avg(correct::INT) AS accuracy, count(*) AS n FROM ({_SCORED}) GROUP BY task) SELECT task, n, round(accuracy, 6) AS accuracy, round((accuracy - 0.01 * {_BASE}) / (1 - 0.01 * {_BASE}), 6) AS centred FROM a")
def centered_core(spark, sf_dir):
    rows = M.accuracy(_scored(spark, sf_dir), "task").withColumn("baseline", F.expr(_BASE).cast("double"))
    return M.centred(rows, percent=True).select("task", "n", F.round("accuracy", 6).alias("accuracy"), F.round("centred", 6).alias("centred"))


@query(f"WITH a AS (SELECT task, avg(correct::INT) AS accuracy FROM ({_SCORED}) WHERE task IN ('src1', 'src2', 'src3', 'src4', 'src5') GROUP BY task) SELECT round(avg((accuracy - 0.01 * {_BASE}) / (1 - 0.01 * {_BASE})), 6) AS composite, count(*) AS n_tasks FROM a HAVING count(*) = 5")
def chatcore_composite(spark, sf_dir):
    rows = M.accuracy(_scored(spark, sf_dir), "task").withColumn("baseline", (F.expr(_BASE) / 100).cast("double"))
    return M.composite(M.centred(rows, percent=False), [f"src{i}" for i in range(1, 6)]).withColumn("composite", F.round("composite", 6))


_SAMPLES = "SELECT doc_id // 8 AS problem, doc_id % 8 AS sample, (doc_id * 31 + n_chars) % 11 < 2 AS correct, ((doc_id * 31 + n_chars) % 11) / 4.0 AS reward FROM documents"


def _samples(spark, sf_dir):
    x = (F.col("doc_id") * 31 + F.col("n_chars")) % 11
    return table(spark, sf_dir, "documents").select(F.expr("doc_id div 8").alias("problem"), (F.col("doc_id") % 8).alias("sample"), (x < 2).alias("correct"), (x / 4).alias("reward"))


@query(f"WITH s AS ({_SAMPLES}), p AS (SELECT problem, k, bool_or(correct AND sample < k) AS ok FROM s, range(1, 9) r(k) GROUP BY ALL) SELECT k, round(avg(ok::INT), 6) AS passed FROM p GROUP BY k")
def pass_at_k(spark, sf_dir):
    return M.pass_at_k(_samples(spark, sf_dir), 8).withColumn("passed", F.round("passed", 6))


@query(f"SELECT problem, sample, round(reward - avg(reward) OVER (PARTITION BY problem), 6) AS advantage FROM ({_SAMPLES})")
def group_advantage(spark, sf_dir):
    return M.advantage(_samples(spark, sf_dir)).select("problem", "sample", F.round("advantage", 6).alias("advantage"))


@query("""WITH v AS (SELECT vec_id // 4 AS item, vec_id % 4 AS option, list_transform(embedding, lambda x : x::DOUBLE) AS l, 5 + vec_id % 3 AS s, 20 + vec_id % 5 AS e FROM embeddings),
m AS (SELECT item, option, list_sum(l[s:e - 1]) / (e - s) AS loss FROM v) SELECT item, option, round(loss, 6) AS loss FROM m QUALIFY row_number() OVER (PARTITION BY item ORDER BY loss, option) = 1""")
def span_mean_argmin(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 4").alias("item"), (F.col("vec_id") % 4).alias("option"), F.transform("embedding", lambda x: x.cast("double")).alias("l"), (F.col("vec_id") % 3 + 5).alias("s"), (F.col("vec_id") % 5 + 20).alias("e"))
    return M.best_option(rows.withColumn("loss", M.span_mean(F.col("l"), F.col("s"), F.col("e"))), "loss").select("item", "option", F.round("loss", 6).alias("loss"))


@query("""WITH w AS (SELECT a.doc_id, string_split(lower(a.text), '') AS x, string_split(lower(b.text), '') AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1), n AS (SELECT *, least(len(x), len(y)) AS n FROM w)
SELECT doc_id, coalesce(list_position(list_transform(x[1:n], lambda c, i : c = y[i]), false) - 1, n)::BIGINT AS prefix, coalesce(list_position(list_transform(list_reverse(x)[1:n], lambda c, i : c = y[len(y) + 1 - i]), false) - 1, n)::BIGINT AS suffix FROM n""")
def common_prefix_len(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chars = docs.select("doc_id", F.split(F.lower("text"), "").alias("x"))
    after = chars.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y"))
    return chars.join(after, "doc_id").select("doc_id", M.common_prefix(F.col("x"), F.col("y")).alias("prefix"), M.common_suffix(F.col("x"), F.col("y")).alias("suffix"))


@query("SELECT vec_id, len(a[greatest(len(a) - 20, 0) + 1:]) AS n, round(list_sum(list_transform(a[greatest(len(a) - 20, 0) + 1:], lambda x : x::DOUBLE)), 6) AS total FROM (SELECT vec_id, embedding[1:vec_id % 64 + 1] AS a FROM embeddings)")
def left_crop_pad(spark, sf_dir):
    cut = table(spark, sf_dir, "embeddings").select("vec_id", M.left_crop(F.slice("embedding", F.lit(1), (F.col("vec_id") % 64 + 1).cast("int")), 20).alias("a"))
    padded = M.right_pad(F.col("a"), F.lit(20), F.lit(0.0).cast("float"))
    return cut.select("vec_id", F.size("a").cast("long").alias("n"), F.round(F.aggregate(padded, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH a AS (SELECT task, avg(correct::INT) AS accuracy FROM ({_SCORED}) WHERE task IN ('src1', 'src2', 'src3') GROUP BY task) SELECT round(avg((accuracy - 0.25) / 0.75), 6) AS composite, count(*) AS n_tasks FROM a HAVING count(*) = 3")
def categorical_composite(spark, sf_dir):
    """The composite of the tasks that are answered by a letter alone."""
    rows = M.accuracy(_scored(spark, sf_dir), "task").withColumn("baseline", F.lit(0.25))
    return M.composite(M.centred(rows, percent=False), ["src1", "src2", "src3"]).withColumn("composite", F.round("composite", 6))


@query("""WITH a AS (SELECT vec_id, embedding[1:vec_id % 64 + 1] AS a, vec_id % 64 + 1 AS n FROM embeddings)
SELECT vec_id, greatest(n // 2 - greatest(n - 20, 0), 0)::BIGINT AS start, (n - greatest(n - 20, 0))::BIGINT AS stop, least(n, 20)::BIGINT AS n FROM a""")
def cropped_spans(spark, sf_dir):
    n = (F.col("vec_id") % 64 + 1).cast("int")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", F.lit(1), n).alias("a"), F.floor(n / 2).cast("long").alias("s"), n.cast("long").alias("e"))
    tokens, start, end = M.cropped_span(F.col("a"), F.col("s"), F.col("e"), 20)
    return rows.select("vec_id", start.alias("start"), end.alias("stop"), F.size(tokens).cast("long").alias("n"))
