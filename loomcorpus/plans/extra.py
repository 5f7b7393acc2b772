"""Queries over prompts, cost, logs and articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import articles as A
from ..operators import cost, evals
from ..operators.runs import windows as layer_windows
from ..sinks import fixed_width
from ..sources import tables as T
from .registry import query

_SHOT = "(SELECT b.text || ' so ' || lower(b.text) || chr(10) || chr(10) FROM benchmark b WHERE b.item_id = (a.item_id + 1) % (SELECT count(*) FROM benchmark))"


@query(f"SELECT item_id, o AS option, {_SHOT} || text || ' so ' || CASE o WHEN 0 THEN lower(text) ELSE 'none' END AS prompt FROM benchmark a, range(0, 2) r(o)")
def choice_prompts(spark, sf_dir):
    items = T.table(spark, sf_dir, "benchmark")
    n = items.count()
    other = items.select(F.pmod(F.col("item_id") - 1, F.lit(n)).alias("item_id"), F.concat("text", F.lit(" so "), F.lower("text")).alias("shot"))
    made = evals.prompts(F.col("text"), F.array(F.lower("text"), F.lit("none")), " so ", F.array("shot"))
    return items.join(other, "item_id").select("item_id", F.posexplode(made).alias("option", "prompt")).withColumn("option", F.col("option").cast("long"))


@query("SELECT item_id, t || ' ' || lower(text) AS with_end, t AS without_end FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM benchmark)")
def open_prompts(spark, sf_dir):
    made = evals.open_prompts(F.col("text"), F.lower("text"), " ")
    return T.table(spark, sf_dir, "benchmark").select("item_id", made[1].alias("with_end"), made[0].alias("without_end"))


_MODELS = "SELECT i AS depth, m AS mode, i * 1000000 AS matmul, 40000 AS head, 30000 AS ref, i * 64 AS width, 2048 AS seq, 1024 AS refs, 128 AS ref_len, 3 AS cross_, 2 AS enc FROM range(4, 13) r(i), (VALUES ('none'), ('prefix'), ('encoder')) t(m)"


def _att(length, per):
    return f"(SELECT sum(least(CASE WHEN ('SSSL')[l % 4 + 1] = 'S' AND l < depth - 1 THEN 512 ELSE 2048 END, {length}) * {per}.0 * width) FROM range(0, 16) w(l) WHERE l < depth)"


@query(f"""WITH c AS ({_MODELS}) SELECT depth, mode, round(CASE mode WHEN 'prefix' THEN 6 * ((matmul - head) * 1.5 + head) + 1.5 * {_att(3072, 12)}
 WHEN 'encoder' THEN 6 * (matmul - ref + ref * 0.5) + {_att(2048, 12)} + 12 * width * (refs * cross_ + ref_len * enc * 0.5) ELSE 6 * matmul + {_att(2048, 12)} END, 2)::DOUBLE AS train,
 round(2 * (matmul - ref) + {_att(900, 4)} + 4 * width * refs * cross_, 2)::DOUBLE AS decode FROM c""")
def flops_per_token(spark, sf_dir):
    depth = F.col("depth")
    rows = spark.range(4, 13).select(F.col("id").alias("depth")).withColumn("mode", F.explode(F.array(*map(F.lit, ("none", "prefix", "encoder")))))
    fixed = {"head": 40_000, "ref": 30_000, "seq": 2048, "refs": 1024, "ref_len": 128, "cross": 3, "enc_layers": 2}
    rows = rows.select("*", (depth * 1_000_000).alias("matmul"), (depth * 64).alias("width"), layer_windows(depth, "SSSL", 2048).alias("windows"), *(F.lit(v).alias(k) for k, v in fixed.items()))
    return rows.select("depth", "mode", F.round(cost.train_flops(F.col("mode")), 2).alias("train"), F.round(cost.decode_flops(F.lit(900)), 2).alias("decode"))


@query("""WITH h AS (SELECT i AS k, 1e9 * i AS tokens FROM range(1, 60) r(i)), b AS (SELECT *, power(2, round_even(log2(524288.0 * power(tokens / 7e9, 0.383)), 0))::BIGINT AS batch FROM h)
SELECT k, batch, round(sqrt(batch / 524288.0), 6) AS rate_scale, round(sqrt(batch / 524288.0) * 7e9 / tokens, 6) AS decay_scale FROM b""")
def batch_scaling(spark, sf_dir):
    tokens, base = F.col("k") * 1e9, F.lit(7e9)
    rows = spark.range(1, 60).select(F.col("id").alias("k")).withColumn("batch", cost.batch_tokens(tokens, base))
    return rows.select("k", "batch", F.round(cost.rate_scale(F.col("batch")), 6).alias("rate_scale"), F.round(cost.decay_scale(F.col("batch"), tokens, base), 6).alias("decay_scale"))


@query("SELECT i AS step, round(CASE WHEN i < 400 THEN 0.85::DOUBLE + i / 400::DOUBLE * 0.12::DOUBLE WHEN i >= 1200 THEN 0.97::DOUBLE - (i - 1200) / 800::DOUBLE * 0.07::DOUBLE ELSE 0.97::DOUBLE END, 8) AS momentum, round(0.1 * (1 + cos(pi() * i / 2000)), 6) AS weight_decay FROM range(0, 2001) r(i)")
def optimizer_schedules(spark, sf_dir):
    step = F.col("step")
    return spark.range(2001).select(F.col("id").alias("step")).select("step", F.round(cost.momentum(step, 2000, 0.4), 8).alias("momentum"), F.round(cost.weight_decay(step, 2000, 0.2), 6).alias("weight_decay"))


_LINES = "SELECT user_id % 15 AS run, event_id AS line, CASE WHEN event_id % 3 = 0 THEN 'params: ' || (event_id // 1000) || ',' || lpad((event_id % 1000)::VARCHAR, 3, '0') ELSE 'noise ' || event_id END AS value FROM events"


@query(f"SELECT run, max_by(replace(regexp_extract(value, 'params: ([0-9,]+)', 1), ',', '')::DOUBLE, line) AS value FROM ({_LINES}) WHERE value LIKE 'params%' GROUP BY run")
def log_scrape_last(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("params: "), F.expr("event_id div 1000"), F.lit(","), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"))).otherwise(F.concat(F.lit("noise "), "event_id"))
    return T.log_metric(e.select((F.col("user_id") % 15).alias("run"), F.col("event_id").alias("line"), said.alias("value")), "params: ([0-9,]+)")


_TAG = "CASE o_orderkey % 4 WHEN 0 THEN 'd' || (o_orderkey % 50) || '_x' WHEN 1 THEN 'base_d12' WHEN 2 THEN 'd' ELSE 'd' || (o_orderkey % 9) END"


@query(f"SELECT o_orderpriority AS folder, max(nullif(regexp_extract({_TAG}, '^d(\\d+)', 1), '')::BIGINT) AS depth FROM orders GROUP BY 1")
def checkpoint_discovery(spark, sf_dir):
    return T.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("folder")).agg(F.max(T.checkpoint_tag(F.expr(_TAG))).alias("depth"))


_CSV = "SELECT item_id AS line, CASE item_id % 4 WHEN 0 THEN 'task' || item_id || '  , ' || (item_id / 8.0) || ' ,' || (item_id / 16.0) WHEN 1 THEN 'task' || item_id || ', , x' WHEN 2 THEN 'only' || item_id ELSE '  ' END AS value FROM benchmark"


@query(f"""SELECT trim(split_part(value, ',', 1)) AS task, try_cast(nullif(trim(split_part(value, ',', 2)), '') AS DOUBLE) AS accuracy, try_cast(nullif(trim(split_part(value, ',', 3)), '') AS DOUBLE) AS centred
FROM ({_CSV}) WHERE line > 0 AND trim(value) <> ''""")
def scores_csv(spark, sf_dir):
    i = F.col("item_id")
    value = F.when(i % 4 == 0, F.concat(F.lit("task"), i, F.lit("  , "), i / 8, F.lit(" ,"), i / 16)).when(i % 4 == 1, F.concat(F.lit("task"), i, F.lit(", , x"))).when(i % 4 == 2, F.concat(F.lit("only"), i)).otherwise("  ")
    return T.scores_csv(T.table(spark, sf_dir, "benchmark").select(i.alias("line"), value.alias("value")))


@query("SELECT item_id, rpad('task' || item_id, 35, ' ') || ', ' || rpad(printf('%.6f', item_id / 8.0), 10, ' ') || ', ' || rpad(printf('%.6f', item_id / 64.0), 10, ' ') AS value FROM benchmark")
def fixed_width_scores(spark, sf_dir):
    i = F.col("item_id")
    rows = T.table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("task"), i).alias("task"), (i / 8).alias("accuracy"), (i / 64).alias("centred"))
    return fixed_width(rows).select("item_id", "value")


def _articles(spark, sf_dir):
    code = lambda c: F.transform(F.split(c, " "), lambda w: F.length(w))
    docs = T.table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("article_row"), code(F.concat(F.col("lang"), F.lit(" "), "source")).alias("title_ids"), code("text").alias("body_ids"))


@query("""WITH a AS (SELECT doc_id, [2, length(source)] AS t, list_transform(string_split(text, ' '), lambda w : length(w)) AS b FROM documents), n AS (SELECT *, len(b) AS n FROM a WHERE len(b) >= 62),
k AS (SELECT *, round_even((n - 62) / 54.0, 0)::BIGINT + 1 AS k FROM n), s AS (SELECT doc_id, t, b, i, CASE WHEN k <= 1 THEN 0 ELSE (i * (n - 62)) // (k - 1) END AS st FROM k, range(0, 3000) r(i) WHERE i < greatest(k, 1))
SELECT doc_id AS article_row, i AS chunk_idx, row_number() OVER (ORDER BY doc_id, i) - 1 AS chunk_id, md5(array_to_string(list_concat(t, b[st + 1:st + 62]), ' ')) AS chunk_md5 FROM s""")
def article_chunks(spark, sf_dir):
    rows = A.numbered(A.chunks(_articles(spark, sf_dir), 64, 8))
    return rows.select("article_row", "chunk_idx", "chunk_id", F.md5(F.array_join("chunk", " ")).alias("chunk_md5"))


@query("SELECT vec_id, len(list_filter(string_split(bits, '0'), lambda s : s <> '')) AS parts FROM (SELECT vec_id, array_to_string(list_transform(embedding, lambda x : CASE WHEN x < 0 THEN '0' ELSE '1' END), '') AS bits FROM embeddings)")
def sentinel_segments(spark, sf_dir):
    signs = T.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(x < 0, 0).otherwise(1)).alias("bits"))
    return A.segments(signs, "bits", 0).select("vec_id", F.size("segments").cast("long").alias("parts"))


@query()
def retrieval_refs(spark, sf_dir):
    """Eight references of different texts an item: of each text one document, that of its smallest id, is searched, so copies can't fill
    the list."""
    from ..operators.corpus import content_ids
    from ..operators.retrieval import top_k

    items = A.embedded(T.table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"), "text")
    docs = T.table(spark, sf_dir, "documents")
    first = content_ids(docs, "doc_id", "text").where("doc_id = content_id").select("doc_id")
    once = A.embedded(docs.select("doc_id", "text").join(first, "doc_id").select(F.col("doc_id").alias("vec_id"), "text"), "text")
    return A.refs(top_k(items, once, 8))


@query()
def few_shot_pairs(spark, sf_dir):
    return evals.few_shot(spark, T.table(spark, sf_dir, "benchmark").count(), 3)


@query()
def seeded_orders(spark, sf_dir):
    n = T.table(spark, sf_dir, "benchmark").count()
    return evals.permutation(spark, n, 42).join(evals.shuffled(spark, n, 42).withColumnRenamed("physical", "shuffled"), "place")


@query("SELECT q.vec_id AS physical, (q.vec_id % 4 = 0) AS done FROM embeddings q WHERE NOT vec_id % 4 = 0")
def already_done_skip(spark, sf_dir):
    rows = T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("physical"))
    return A.without_done(rows, rows.where("physical % 4 = 0"), ["physical"]).withColumn("done", F.col("physical") % 4 == 0)
