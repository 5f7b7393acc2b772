"""Queries of files: what is written is read again. Folders lie below spark.checkpoint.dir."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..functions import bpe
from ..operators import corpus, metrics
from ..sources import tables as T
from .registry import query


@query("SELECT item_id AS query, text AS context, item_id % 4 AS gold FROM benchmark")
def jsonl_items(spark, sf_dir):
    path = T.shared_folder(spark)
    T.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("context"), (F.col("item_id") % 4).alias("gold")).write.json(path)
    return T.jsonl(spark, path, "query long, context string, gold long")


@query("WITH a AS (SELECT source AS task, avg(((doc_id * 7 + n_chars) % 5 < 2)::INT) AS accuracy FROM documents GROUP BY 1), b AS (SELECT source AS task, 25.0 AS baseline FROM documents WHERE source < 'src3' GROUP BY 1) SELECT a.task, round((accuracy - 0.01 * baseline) / (1 - 0.01 * baseline), 6) AS centred FROM a JOIN b USING (task)")
def baseline_join(spark, sf_dir):
    path = T.shared_folder(spark)
    docs = T.table(spark, sf_dir, "documents")
    docs.where("source < 'src3'").select(F.col("source").alias("Eval Task"), F.lit(" 25.0").alias("Random baseline")).distinct().write.option("header", True).csv(path)
    scored = docs.select(F.col("source").alias("task"), ((F.col("doc_id") * 7 + F.col("n_chars")) % 5 < 2).alias("correct"))
    known = T.baselines(spark, path)
    met = metrics.with_baseline(metrics.accuracy(scored.where("source < 'src3'"), "task"), known)
    return metrics.centred(met, percent=True).select("task", F.round("centred", 6).alias("centred"))


@query("SELECT * FROM (VALUES ('hellaswag', 'multiple_choice', 'a/b.jsonl', 10::BIGINT, ' '), ('jeopardy', 'language_modeling', 'c.jsonl', 0::BIGINT, chr(10) || 'Answer: '), ('winograd', 'schema', 'd.jsonl', 5::BIGINT, ' ')) t(label, kind, uri, shots, delimiter)")
def task_list(spark, sf_dir):
    text = """icl_tasks:
-
  label: hellaswag  # a comment
  dataset_uri: a/b.jsonl
  num_fewshot: [10]
  icl_task_type: multiple_choice
-
  label: jeopardy
  dataset_uri: c.jsonl
  num_fewshot: [0]
  icl_task_type: language_modeling
  continuation_delimiter: "\\nAnswer: "
- label: winograd
  dataset_uri: 'd.jsonl'
  num_fewshot:
  - 5
  icl_task_type: schema
"""
    return T.task_list(spark, text)


@query("SELECT 0 AS shard, doc_id AS id, md5(text) AS text_md5 FROM documents UNION ALL SELECT 1, item_id, md5(text) FROM benchmark")
def manifest_concat(spark, sf_dir):
    folder = T.shared_folder(spark)
    parts = [("documents", "doc_id"), ("benchmark", "item_id")]
    for name, key in parts:
        T.table(spark, sf_dir, name).select(F.col(key).alias("id"), "text").write.parquet(f"{folder}/{name}")
    rows = T.manifest(spark, [f"{folder}/{name}" for name, _ in parts])
    return rows.select("shard", "id", F.md5("text").alias("text_md5"))


@query("SELECT count(*) AS rows FROM lineitem")
def footer_count(spark, sf_dir):
    return T.row_count(spark, f"{sf_dir}/lineitem.parquet")


@query("SELECT doc_id, doc_id // 64 AS shard FROM documents")
def files_in_order(spark, sf_dir):
    folder = T.shared_folder(spark)
    docs = T.table(spark, sf_dir, "documents").select("doc_id", F.lpad(F.expr("doc_id div 64").cast("string"), 6, "0").alias("name"))
    sinks.named_files(docs, folder, "name", "doc_id")
    return T.files_in_order(spark, folder).select("doc_id", "shard")


@query("""WITH r AS (SELECT event_id AS step, value FROM events WHERE event_id < 400 AND value IS NOT NULL), n AS (SELECT event_id AS step, value * 2 AS value FROM events WHERE event_id BETWEEN 300 AND 500 AND value IS NOT NULL)
SELECT step, value FROM r WHERE step < 300 UNION ALL SELECT step, value FROM n""")
def resumed_metrics(spark, sf_dir):
    path = T.shared_folder(spark)
    rows = T.table(spark, sf_dir, "events").where("value IS NOT NULL").select(F.col("event_id").alias("step"), "value")
    rows.where("step < 400").write.json(path)
    old = T.jsonl(spark, path, "step long, value double")
    sinks.metrics(old, rows.where("step BETWEEN 300 AND 500").withColumn("value", F.col("value") * 2), 300, path)
    return T.jsonl(spark, path, "step long, value double")


@query("SELECT p_partkey AS run, p_size AS budget FROM part")
def appended_results(spark, sf_dir):
    path = T.shared_folder(spark)
    rows = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("run"), F.col("p_size").alias("budget"))
    for part in (rows.where("run % 3 = 0"), rows.where("run % 2 = 0"), rows):
        sinks.results(part, path, ["run"])
    return T.results(spark, path, "run long, budget int").withColumn("budget", F.col("budget").cast(rows.schema["budget"].dataType))


@query("SELECT block_id, new_shard, doc_id FROM (WITH RECURSIVE b AS (SELECT doc_id // 64 AS block_id, sum(length(text))::BIGINT AS chars, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT block_id, chars AS held, 0::BIGINT AS new_shard, chars >= 300000 AND n = 64 AS cut FROM b WHERE block_id = 0 UNION ALL SELECT b.block_id, CASE WHEN w.cut THEN b.chars ELSE w.held + b.chars END, CASE WHEN w.cut THEN w.new_shard + 1 ELSE w.new_shard END, CASE WHEN w.cut THEN b.chars ELSE w.held + b.chars END >= 300000 AND b.n = 64 FROM w JOIN b ON b.block_id = w.block_id + 1) SELECT block_id, new_shard FROM w) JOIN documents ON doc_id // 64 = block_id")
def written_shards(spark, sf_dir):
    folder = T.shared_folder(spark)
    docs = T.table(spark, sf_dir, "documents").withColumn("block_id", F.expr("doc_id div 64"))
    cut = corpus.cut_shards(docs, 300_000, 64, keep_tail=True)
    sinks.shards(docs.join(cut, "block_id").withColumn("place", F.col("doc_id")), folder)
    return spark.read.parquet(folder).select("block_id", F.col("new_shard").cast("long").alias("new_shard"), "doc_id")


@query("SELECT i AS token_id, upper(lpad(printf('%x', i), 2, '0')) AS bytes, false AS is_special, 1 AS n_bytes FROM range(0, 256) r(i)")
def saved_vocabulary(spark, sf_dir):
    path = T.shared_folder(spark)
    bpe.save(spark, [], path)
    return bpe.vocabulary_table(spark, bpe.load(spark, path)).where("NOT is_special").select(F.col("token_id").cast("long").alias("token_id"), F.hex("bytes").alias("bytes"), "is_special", "n_bytes")


@query("SELECT vec_id AS chunk_id, vec_id // 5 AS article_row, vec_id % 5 AS chunk_idx, 2::BIGINT AS chunk_len FROM embeddings")
def chunk_store(spark, sf_dir):
    path = T.shared_folder(spark)
    chunks = T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.expr("vec_id div 5").alias("article_row"), (F.col("vec_id") % 5).alias("chunk_idx"), F.array("vec_id", "vec_id").alias("tokens"))
    sinks.store(spark, path, {"chunk_len": 2}, chunks=chunks)
    config, parts = sinks.open_store(spark, path)
    return parts("chunks").select("chunk_id", "article_row", "chunk_idx", F.lit(config["chunk_len"]).cast("long").alias("chunk_len"))


@query("SELECT vec_id AS physical, (SELECT count(*) FROM embeddings) AS n FROM embeddings WHERE vec_id % 20 = 0")
def refs_store(spark, sf_dir):
    path = T.shared_folder(spark)
    rows = T.table(spark, sf_dir, "embeddings")
    sinks.store(spark, path, {"n": rows.count()}, refs=rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("physical")))
    config, parts = sinks.open_store(spark, path)
    return parts("refs").withColumn("n", F.lit(config["n"]).cast("long"))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 137")
def first_articles(spark, sf_dir):
    return corpus.first_in_order(T.ordered(T.table(spark, sf_dir, "documents")), 137).select("doc_id")


@query(r"WITH t AS (SELECT o_orderkey AS k, 'd' || (o_orderkey % 50) AS tag, 'model_' || lpad((o_orderkey * 7 % 5000)::VARCHAR, 6, '0') || CASE WHEN o_orderkey % 5 = 0 THEN '.tmp' ELSE '.pt' END AS file FROM orders) SELECT tag, max(nullif(regexp_extract(file, 'model_(\d+)\.pt$', 1), '')::BIGINT) AS step FROM t GROUP BY tag")
def last_steps(spark, sf_dir):
    k = F.col("o_orderkey")
    file = F.concat(F.lit("model_"), F.lpad((k * 7 % 5000).cast("string"), 6, "0"), F.when(k % 5 == 0, ".tmp").otherwise(".pt"))
    rows = T.table(spark, sf_dir, "orders").select(F.concat(F.lit("d"), k % 50).alias("tag"), file.alias("file"))
    return rows.groupBy("tag").agg(F.max(T.checkpoint_step(F.col("file"))).alias("step"))


@query("WITH t AS (SELECT o_orderstatus AS folder, CASE o_orderkey % 4 WHEN 0 THEN 'd' || (o_orderkey % 50) ELSE 'base_' || o_orderkey END AS tag, o_orderkey * 13 % 1000 AS mtime FROM orders) SELECT folder, coalesce(max_by(tag, (nullif(regexp_extract(tag, '^d(\\d+)', 1), '')::BIGINT, tag)) FILTER (WHERE tag LIKE 'd%'), max_by(tag, (mtime, tag))) AS tag FROM t GROUP BY folder".replace("\\\\", "\\"))
def chosen_checkpoints(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = T.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("folder"), F.when(k % 4 == 0, F.concat(F.lit("d"), k % 50)).otherwise(F.concat(F.lit("base_"), k)).alias("tag"), (k * 13 % 1000).alias("mtime"))
    return T.chosen_checkpoint(rows, "folder")
