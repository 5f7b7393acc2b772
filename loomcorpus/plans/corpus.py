"""Queries over the corpus: order, budgets, shards, chunks, copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..sources.tables import ordered, table
from .registry import query

_PLACE = "SELECT *, doc_id // 256 AS shard, (doc_id // 64) % 4 AS rg, doc_id % 64 AS pos FROM documents"


def _docs(spark, sf_dir):
    return ordered(table(spark, sf_dir, "documents"))


@query(f"WITH d AS ({_PLACE}) SELECT CASE WHEN shard = (SELECT max(shard) FROM d) THEN 'val' ELSE 'train' END AS split, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM d GROUP BY 1")
def corpus_split_counts(spark, sf_dir):
    return C.split_last(_docs(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


@query(f"SELECT rg % 3 AS rank, count(*) AS docs, min(doc_id) AS first_id, max(doc_id) AS last_id FROM ({_PLACE}) GROUP BY 1")
def rank_strided_docs(spark, sf_dir):
    return C.stride(_docs(spark, sf_dir), 3).groupBy("rank").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query(f"""WITH d AS ({_PLACE}), t AS (SELECT * FROM d WHERE shard < (SELECT max(shard) FROM d))
SELECT e AS epoch, doc_id FROM t, range(1, 4) r(e) WHERE rg % 2 = 1 AND (e > 1 OR shard > 1 OR shard = 1 AND rg >= 3)""")
def epoch_resume_suffix(spark, sf_dir):
    train = C.split_last(_docs(spark, sf_dir)).where("split = 'train'")
    return C.resume(train, shard=1, rg=1, rank=1, world=2, epochs=3).select(F.col("epoch").cast("long").alias("epoch"), "doc_id")


@query(f"""WITH d AS (SELECT doc_id, length(left(text, 1500)) AS n_capped FROM ({_PLACE})), s AS (SELECT *, (sum(n_capped) OVER (ORDER BY doc_id))::BIGINT AS total FROM d)
SELECT doc_id, n_capped, total FROM s WHERE total - n_capped <= 500000""")
def doc_cap_budget(spark, sf_dir):
    return C.cap_and_budget(_docs(spark, sf_dir), 1500, 500_000)


@query(f"SELECT shard, count(*) AS docs, sum(length(text))::BIGINT AS chars, (sum(sum(length(text))) OVER (ORDER BY shard))::BIGINT AS chars_so_far FROM ({_PLACE}) GROUP BY shard")
def shard_char_totals(spark, sf_dir):
    return C.shard_totals(_docs(spark, sf_dir))


@query("""WITH RECURSIVE b AS (SELECT doc_id // 64 AS block_id, sum(length(text))::BIGINT AS chars, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT block_id, chars AS held, 0::BIGINT AS new_shard, chars >= 300000 AND n = 64 AS cut FROM b WHERE block_id = 0
 UNION ALL SELECT b.block_id, CASE WHEN w.cut THEN b.chars ELSE w.held + b.chars END, CASE WHEN w.cut THEN w.new_shard + 1 ELSE w.new_shard END,
  CASE WHEN w.cut THEN b.chars ELSE w.held + b.chars END >= 300000 AND b.n = 64 FROM w JOIN b ON b.block_id = w.block_id + 1)
SELECT block_id, new_shard FROM w WHERE new_shard IN (SELECT new_shard FROM w WHERE cut)""")
def reset_threshold_shards(spark, sf_dir):
    return C.cut_shards(table(spark, sf_dir, "documents"), 300_000, 64)


@query("""WITH d AS (SELECT doc_id, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w : w <> '') AS words FROM documents), n AS (SELECT doc_id, words, len(words) AS n FROM d),
k AS (SELECT *, round_even((n - 64) / 56.0, 0)::BIGINT + 1 AS k FROM n WHERE n >= 64),
s AS (SELECT doc_id, words, i AS chunk_idx, CASE WHEN k <= 1 THEN 0 ELSE (i * (n - 64)) // (k - 1) END AS start FROM k, range(0, 2000) r(i) WHERE i < greatest(k, 1))
SELECT doc_id, chunk_idx, start, md5(array_to_string(words[start + 1:start + 64], ' ')) AS chunk_md5 FROM s""")
def word_chunk_overlap(spark, sf_dir):
    return C.word_chunks(table(spark, sf_dir, "documents"), 64, 8).select("doc_id", "chunk_idx", "start", F.md5("chunk").alias("chunk_md5"))


_ENDS = "CASE doc_id % 4 WHEN 0 THEN chr(10) || 'References' || chr(10) || 'a' WHEN 1 THEN chr(10) || 'Notes' || chr(10) || 'b' || chr(10) || 'See also' || chr(10) WHEN 2 THEN chr(10) || 'Notes' ELSE '' END"


@query(f"SELECT doc_id, md5(string_split_regex(text || {_ENDS}, '\\n(References|External links|See also|Further reading|Notes)\\n')[1]) AS body_md5 FROM documents")
def section_strip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(C.strip_sections(F.concat("text", F.expr(_ENDS)))).alias("body_md5"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS content_id FROM documents")
def exact_dup_content_ids(spark, sf_dir):
    return C.content_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT lang, count(*) AS docs, count(*) FILTER (WHERE content_id <> doc_id) AS copies FROM (SELECT lang, doc_id, min(doc_id) OVER (PARTITION BY text) AS content_id FROM documents) GROUP BY lang")
def duplicate_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ids = C.content_ids(docs, "doc_id", "text")
    return docs.select("doc_id", "lang").join(ids, "doc_id").groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(F.col("content_id") != F.col("doc_id")).alias("copies"))


@query("SELECT lang, count(*) AS docs, sum(octet_length(encode(text)))::BIGINT AS n_bytes, sum(length(text))::BIGINT AS n_chars, round(sum(octet_length(encode(text))) / sum(length(text)), 6) AS bytes_per_char FROM documents GROUP BY lang")
def utf8_token_counts(spark, sf_dir):
    """Tokens of the vocabulary without merges: bytes."""
    rows = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.octet_length("text")).alias("n_bytes"), F.sum(F.length("text")).alias("n_chars"))
    return rows.withColumn("bytes_per_char", F.round(F.col("n_bytes") / F.col("n_chars"), 6))


@query(f"SELECT shard, rg, pos // 24 AS batch, count(*) AS docs, min(doc_id) AS first_id FROM ({_PLACE}) GROUP BY ALL")
def document_batches(spark, sf_dir):
    return C.batched(_docs(spark, sf_dir), 24).groupBy("shard", "rg", "batch").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_id"))


@query("SELECT doc_id, octet_length(encode(text)) AS n_tokens, md5(text) AS text_md5 FROM documents")
def detokenised(spark, sf_dir):
    """Texts from their tokens, as a source of tokens is made text before it is cut into shards anew; the vocabulary without merges."""
    from ..functions import bpe

    rows = table(spark, sf_dir, "documents").select("doc_id", bpe.encode(F.col("text"), []).alias("ids"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.md5(bpe.decode(F.col("ids"), [])).alias("text_md5"))
