"""Queries of the tokenizer, tool calls and program headers."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from ..functions import bpe, sandbox
from ..operators.chat import merge_system, validate
from ..sources.tables import table
from .registry import query

VOCABULARY = 400


@lru_cache(maxsize=8)
def _trained(application: str, sf_dir: str, spark) -> tuple[tuple[bytes, bytes], ...]:
    return tuple(bpe.train(table(spark, sf_dir, "documents"), VOCABULARY))


def _merges(spark, sf_dir):
    """One training serves all queries over a table."""
    return list(_trained(spark.sparkContext.applicationId, sf_dir, spark))


@query()
def bpe_vocabulary(spark, sf_dir):
    return bpe.vocabulary_table(spark, _merges(spark, sf_dir)).withColumn("bytes", F.hex("bytes"))


@query()
def bpe_encode_stats(spark, sf_dir):
    merges = _merges(spark, sf_dir)
    ids = table(spark, sf_dir, "documents").select("lang", "text", bpe.encode(F.col("text"), merges).alias("ids"))
    rows = ids.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n_bytes"), F.sum(F.size("ids")).alias("n_tokens"), F.count_if(bpe.decode(F.col("ids"), merges) != F.col("text")).alias("not_restored"))
    return rows.withColumn("ratio", F.round(F.col("n_bytes") / F.col("n_tokens"), 6))


@query()
def conversation_render(spark, sf_dir):
    rows = bpe.render(_valid_turns(spark, sf_dir), _merges(spark, sf_dir))
    return rows.select("conv_id", F.size("ids").alias("n"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("spoken"), F.xxhash64("ids").alias("ids_hash"))


_TURNS = """n AS (SELECT *, row_number() OVER o AS n, lag(role) OVER o AS pr, lag(text) OVER o AS pt FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, CASE WHEN n = 2 AND pr = 'system' THEN pt || chr(10) || chr(10) || text ELSE text END AS text FROM n WHERE NOT (n = 1 AND role = 'system')),
v AS (SELECT conv_id FROM m GROUP BY conv_id HAVING bool_and(role = CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END)),
t AS (SELECT m.*, list_transform(range(0, octet_length(encode(text))), lambda i : ('0x' || hex(encode(text))[2 * i + 1:2 * i + 2])::INT) AS b, list_transform(range(0, length(turn::VARCHAR)), lambda i : ascii((turn::VARCHAR)[i + 1])) AS d FROM m JOIN v USING (conv_id))"""


def _valid_turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return merge_system(rows).join(validate(rows).where("alternates").select("conv_id"), "conv_id")


@query(f"""WITH {_TURNS}, p AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN [257] || b || [258] ELSE [259] || b || [261] || d || [262, 263] || d || [264, 260] END AS i,
CASE WHEN role = 'user' THEN list_resize([0], len(b) + 2, 0) ELSE [0] || list_resize([1], len(b) + len(d) + 2, 1) || list_resize([0], len(d) + 2, 0) || [1] END AS m FROM t),
c AS (SELECT conv_id, ([256] || flatten(list(i ORDER BY turn)))[1:2048] AS ids, ([0] || flatten(list(m ORDER BY turn)))[1:2048] AS mask FROM p GROUP BY conv_id)
SELECT conv_id, len(ids) AS n, list_sum(mask)::BIGINT AS spoken, md5(array_to_string(ids, ',')) AS ids_md5, md5(array_to_string(mask, ',')) AS mask_md5 FROM c""")
def rendered_parts(spark, sf_dir):
    """Conversations whose assistant calls a tool, in the vocabulary without merges."""
    turn = F.col("turn").cast("string")
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    rows = _valid_turns(spark, sf_dir).withColumn("parts", F.array(part("text", F.col("text")), part("python", turn), part("python_output", turn)))
    got = bpe.render(rows, [])
    text = lambda c: F.md5(F.array_join(c, ","))
    return got.select("conv_id", F.size("ids").cast("long").alias("n"), F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("spoken"), text("ids").alias("ids_md5"), text("mask").alias("mask_md5"))


@query(f"""WITH {_TURNS}, l AS (SELECT conv_id, max(turn) AS last, max_by(role, turn) AS r FROM t GROUP BY conv_id),
p AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN [257] || b || [258] ELSE [259] || b || [260] END AS i FROM t JOIN l USING (conv_id) WHERE NOT (r = 'assistant' AND turn = last))
SELECT conv_id, md5(array_to_string(([256] || flatten(list(i ORDER BY turn)))[1:2048] || [259], ',')) AS ids_md5 FROM p GROUP BY conv_id""")
def rendered_for_completion(spark, sf_dir):
    got = bpe.for_completion(_valid_turns(spark, sf_dir), [])
    return got.select("conv_id", F.md5(F.array_join("ids", ",")).alias("ids_md5"))


@query("""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN (doc_id * 2 + 3)::VARCHAR WHEN 1 THEN (doc_id - 1000)::VARCHAR WHEN 2 THEN '2' WHEN 4 THEN (doc_id // 7)::VARCHAR WHEN 6 THEN '1' END AS value FROM documents""")
def calculator_values(spark, sf_dir):
    said = F.expr("""CASE doc_id % 8 WHEN 0 THEN concat(doc_id, '*2+3') WHEN 1 THEN concat(doc_id, '-1,000') WHEN 2 THEN '"abab".count("ab")' WHEN 3 THEN '2**9' WHEN 4 THEN concat(doc_id, '//7')
WHEN 5 THEN concat(doc_id, '%7') WHEN 6 THEN '"a,b".count("ab")' ELSE '1e5' END""")
    return table(spark, sf_dir, "documents").select("doc_id", sandbox.calculator(said).alias("value"))


@query("SELECT item_id, item_id % 3 <> 1 AS success, CASE WHEN item_id % 3 = 1 THEN 'AssertionError' END AS error, CASE WHEN item_id % 3 = 0 THEN 'out ' || item_id || chr(10) ELSE '' END AS stdout FROM benchmark")
def program_results(spark, sf_dir):
    """Programs of the items (a process each) that print, fail, or have no way to remove files."""
    i = F.col("item_id")
    program = F.when(i % 3 == 0, F.concat(F.lit("print('out', "), i, F.lit(")"))).when(i % 3 == 1, "assert False").otherwise("import os, shutil\nassert os.remove is None and shutil.rmtree is None and os.system is None")
    rows = table(spark, sf_dir, "benchmark").select("item_id", sandbox.executed(program).alias("r"))
    return rows.select("item_id", "r.success", "r.error", "r.stdout")
