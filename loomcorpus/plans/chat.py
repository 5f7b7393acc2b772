"""Queries over conversations, tasks and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chat as C
from ..sources.tables import table
from .registry import query

_MERGED = """n AS (SELECT *, row_number() OVER o AS n, lag(role) OVER o AS pr, lag(text) OVER o AS pt FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, CASE WHEN n = 2 AND pr = 'system' THEN pt || chr(10) || chr(10) || text ELSE text END AS text FROM n WHERE NOT (n = 1 AND role = 'system'))"""


@query(f"WITH {_MERGED} SELECT conv_id, turn, role, md5(text) AS text_md5 FROM m")
def conversation_merge_system(spark, sf_dir):
    return C.merge_system(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query(f"WITH {_MERGED} SELECT conv_id, count(*) AS turns, bool_and(role = CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END) AS alternates, max_by(role, turn) = 'user' AS ends_on_user FROM m GROUP BY conv_id")
def conversation_validate(spark, sf_dir):
    return C.validate(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, md5(min_by(text, turn)) AS query_md5 FROM conversations WHERE role = 'user' GROUP BY conv_id")
def first_user_query(spark, sf_dir):
    return C.first_user(table(spark, sf_dir, "conversations")).select("conv_id", F.md5("query").alias("query_md5"))


@query("""WITH t AS (SELECT 'smol' AS task, 1 AS copy, conv_id AS idx FROM conversations GROUP BY conv_id UNION ALL SELECT 'facts', c, item_id FROM benchmark, range(1, 4) r(c) UNION ALL SELECT 'sums', c, doc_id FROM documents, range(1, 3) r(c))
SELECT task, copy, idx, md5(concat_ws('/', '42', task, copy::VARCHAR, idx::VARCHAR)) AS place FROM t""")
def mixture_union_oversample(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("idx")).distinct()
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"))
    return C.mixture([("smol", conv, 1), ("facts", items, 3), ("sums", docs, 2)], 42)


@query("SELECT doc_id AS physical, (doc_id - 7) // 13 AS idx FROM documents WHERE doc_id >= 7 AND doc_id < least(5000, (SELECT count(*) FROM documents)) AND (doc_id - 7) % 13 = 0")
def task_slice(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return C.sliced(docs.select(F.col("doc_id").alias("physical")), 7, 5000, 13, docs.count())


@query("SELECT sha256(string_agg(text || chr(0), '' ORDER BY item_id)) AS sha256, count(*) AS n FROM benchmark WHERE item_id < 1000")
def query_fingerprint(spark, sf_dir):
    return C.fingerprint(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"), F.col("text").alias("query")))


_SAID = "CASE doc_id % 5 WHEN 0 THEN 'so #### ' || (doc_id * 37) || ',5' WHEN 1 THEN '#### -' || doc_id || '.' WHEN 2 THEN 'none' WHEN 3 THEN '#### 1 #### 2' ELSE '####' || doc_id END"
_TRUE = "CASE doc_id % 3 WHEN 0 THEN '#### ' || (doc_id * 37) || '5' WHEN 1 THEN '#### -' || doc_id || '.' ELSE 'no mark' END"


@query(f"""WITH a AS (SELECT doc_id, nullif(replace(regexp_extract({_SAID}, '#### (-?[0-9.,]+)', 1), ',', ''), '') AS said, nullif(replace(regexp_extract({_TRUE}, '#### (-?[0-9.,]+)', 1), ',', ''), '') AS truth FROM documents)
SELECT doc_id, said, truth, said IS NOT DISTINCT FROM truth AS correct FROM a""")
def answer_extract_score(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", C.answer(F.expr(_SAID)).alias("said"), C.answer(F.expr(_TRUE)).alias("truth"))
    return rows.withColumn("correct", F.col("said").eqNullSafe(F.col("truth")))


_CODE = "CASE doc_id % 3 WHEN 0 THEN 'x' || chr(10) || '```python' || chr(10) || 'a = ' || doc_id || chr(10) || 'b' || chr(10) || '```' || chr(10) || 'y' WHEN 1 THEN '```' || chr(10) || 'c' || doc_id || chr(10) || '``` ```' ELSE ' plain ' || doc_id || ' ' END"


@query(f"SELECT doc_id, trim(CASE WHEN regexp_matches(t, '(?s)```(?:python)?\\s*\\n(.*?)\\n```') THEN regexp_extract(t, '(?s)```(?:python)?\\s*\\n(.*?)\\n```', 1) ELSE t END) AS code FROM (SELECT doc_id, {_CODE} AS t FROM documents)")
def fenced_code_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.fenced_code(F.expr(_CODE)).alias("code"))


@query("SELECT item_id, text || chr(10) || '- ' || lower(text) || '=A' || chr(10) || '- ' || reverse(text) || '=B' || chr(10) || '- none=C' AS prompt FROM benchmark")
def choice_rendering(spark, sf_dir):
    text = F.col("text")
    letters, choices = F.array(*map(F.lit, "ABC")), F.array(F.lower(text), F.reverse(text), F.lit("none"))
    return table(spark, sf_dir, "benchmark").select("item_id", C.render_choices(text, letters, choices).alias("prompt"))
