"""Queries of loading: shifts, masks, a reader's rows, resumption, batches, plain packing. The signs of a vector stand for a row's tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import articles, loading
from ..operators.tasks import inner_mark
from ..sources.tables import table
from .packing import _lengths
from .registry import query

_TOKENS = "list_transform(embedding, lambda x, i : CASE WHEN x < 0 THEN 0 ELSE (i - 1) % 9 + 1 END)"


def _rows(spark, sf_dir):
    tokens = F.transform("embedding", lambda x, i: F.when(x < 0, 0).otherwise(i % 9 + 1))
    return table(spark, sf_dir, "embeddings").select("vec_id", tokens.alias("tokens"))


def _text(array):
    return F.md5(F.array_join(array, ","))


@query(f"""WITH t AS (SELECT vec_id, {_TOKENS} AS r, 40 + vec_id % 30 AS content FROM embeddings)
SELECT vec_id, md5(array_to_string(r[1:len(r) - 1], ',')) AS inputs, md5(array_to_string(list_transform(r[2:], lambda t, i : CASE WHEN i % 3 = 0 OR content < len(r) AND i >= content THEN -1 ELSE t END), ',')) AS targets FROM t""")
def shifted_targets(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("mask", F.transform("tokens", lambda _, i: F.when(i % 3 == 0, 0).otherwise(1)))
    x, y = loading.shifted(F.col("tokens"))
    return rows.select("vec_id", _text(x).alias("inputs"), _text(loading.masked_targets(y, F.col("mask"), F.col("vec_id") % 30 + 40)).alias("targets"))


@query(f"SELECT vec_id // 7 AS batch, md5(string_agg(array_to_string(r[1:len(r) - 1], ','), ';' ORDER BY vec_id)) AS inputs, md5(string_agg(array_to_string(r[2:], ','), ';' ORDER BY vec_id)) AS targets FROM (SELECT vec_id, {_TOKENS} AS r FROM embeddings) GROUP BY 1 HAVING count(*) = 7")
def batch_assembly(spark, sf_dir):
    got = loading.batches_of(_rows(spark, sf_dir).withColumnRenamed("vec_id", "pos"), 7)
    text = lambda c: F.md5(F.array_join(F.transform(c, lambda r: F.array_join(r, ",")), ";"))
    return got.select("batch", text("inputs").alias("inputs"), text("targets").alias("targets"))


_OWN = "SELECT vec_id AS row_id, vec_id // 3 AS pos FROM embeddings WHERE vec_id % 3 = 1 AND vec_id // 3 < (SELECT count(*) // 3 FROM embeddings)"


def _own(spark, sf_dir):
    return loading.own_rows(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id")), 1, 3)


@query(_OWN)
def stream_rows(spark, sf_dir):
    return _own(spark, sf_dir).select("row_id", "pos")


@query(f"""WITH o AS ({_OWN}), n AS (SELECT count(*) AS n FROM o), e AS (SELECT o.*, e AS epoch, CASE WHEN e = 2 THEN 6 ELSE 0 END AS s, n FROM o, n, range(2, 5) r(e))
SELECT epoch, pos - (pos - s) % 4 AS batch_pos, (pos - s) % 4 AS slot, row_id, pos FROM e WHERE pos >= s AND pos - s < (n - s) // 4 * 4""")
def loader_resume(spark, sf_dir):
    got = loading.loader(_own(spark, sf_dir), 4, 4, pos=6, epoch=2)
    return got.select(F.col("epoch").cast("long").alias("epoch"), "batch_pos", "slot", "row_id", "pos")


@query("""WITH t AS (SELECT conv_id, turn, role, list_transform(string_split(text, ' '), lambda w : length(w)) AS t FROM conversations),
c AS (SELECT conv_id, flatten(list(t ORDER BY turn)) AS t, flatten(list(list_transform(t, lambda x : CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) ORDER BY turn)) AS m FROM t GROUP BY conv_id)
SELECT conv_id, least(len(t), 48) AS content, md5(array_to_string(list_resize(t[1:48], 48, -7), ',')) AS tokens, list_sum(m[1:48])::BIGINT AS spoken FROM c""")
def conversation_rows(spark, sf_dir):
    words = F.transform(F.split("text", " "), lambda w: F.length(w))
    each = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("t"), F.transform(words, lambda _: (F.col("role") == "assistant").cast("int")).alias("m"))
    listed = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "t", "m"))).alias("a"))
    flat = lambda k: F.flatten(F.transform("a", lambda x: x[k]))
    tokens, mask, content = loading.one_a_row(flat("t"), flat("m"), 48, -7)
    return listed.select("conv_id", content.cast("long").alias("content"), _text(tokens).alias("tokens"), F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("spoken"))


_STREAMS = r"d AS (SELECT ((doc_id // 64) % 4) % 2 AS stream, row_number() OVER (PARTITION BY ((doc_id // 64) % 4) % 2 ORDER BY doc_id) AS i, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM documents)"


@query(f"""WITH RECURSIVE {_STREAMS}, w AS (SELECT stream, i, 0::BIGINT AS row, least(n, 512) AS used FROM d WHERE i = 1
UNION ALL SELECT d.stream, d.i, CASE WHEN used = 512 THEN row + 1 ELSE row END, least(512, CASE WHEN used = 512 THEN n ELSE used + n END) FROM w JOIN d ON d.stream = w.stream AND d.i = w.i + 1)
SELECT stream, row, max(used) AS used FROM w GROUP BY ALL HAVING max(used) > 0""")
def greedy_crop_pack(spark, sf_dir):
    return loading.crop_packed(_lengths(spark, sf_dir), 512)


@query(f"""WITH RECURSIVE {_STREAMS}, w AS (SELECT stream, i, 0::BIGINT AS row, least(n, 512) AS used FROM d WHERE i = 1
UNION ALL SELECT d.stream, d.i, CASE WHEN used + least(n, 512) > 512 THEN row + 1 ELSE row END, CASE WHEN used + least(n, 512) > 512 THEN least(n, 512) ELSE used + n END FROM w JOIN d ON d.stream = w.stream AND d.i = w.i + 1)
SELECT stream, row, max(used) AS used FROM w GROUP BY ALL""")
def greedy_pad_pack(spark, sf_dir):
    return loading.pad_packed(_lengths(spark, sf_dir), 512)


@query("""WITH d AS (SELECT ((doc_id // 64) % 4) % 2 AS stream, row_number() OVER o AS i, count(*) OVER (PARTITION BY ((doc_id // 64) % 4) % 2) AS n FROM documents WINDOW o AS (PARTITION BY ((doc_id // 64) % 4) % 2 ORDER BY doc_id))
SELECT stream, ceil(i / 10)::BIGINT AS step, i AS taken, i / n AS done, i = n AS is_last FROM d WHERE i % 10 = 0 OR i = n""")
def consumption(spark, sf_dir):
    return loading.progress(_lengths(spark, sf_dir), 10)


@query(f"SELECT vec_id, list_contains(({_TOKENS})[2:], 0) AS inner_mark FROM embeddings")
def inner_marks(spark, sf_dir):
    return _rows(spark, sf_dir).select("vec_id", inner_mark(F.col("tokens"), 0).alias("inner_mark"))


@query(f"""WITH t AS (SELECT vec_id, {_TOKENS} AS r FROM embeddings), w AS (SELECT vec_id AS doc_id, win, r[win * 12 + 1:win * 12 + 12] AS t FROM t, range(0, 4) x(win))
SELECT doc_id, win, md5(array_to_string(list_filter(t, lambda x : x <> 3), ',')) AS tokens FROM w WHERE len(t) > 0""")
def token_windows(spark, sf_dir):
    got = articles.windows(_rows(spark, sf_dir).withColumnRenamed("vec_id", "doc_id"), size=12, most=4, drop=3)
    return got.select("doc_id", F.col("win").cast("long").alias("win"), _text("tokens").alias("tokens"))
