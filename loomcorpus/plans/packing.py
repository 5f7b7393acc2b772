"""Queries of packing; a document's tokens are its words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import packing as P
from ..sources.tables import ordered, table
from .registry import query

ROOM = 512


def _lengths(spark, sf_dir, world=2):
    docs = ordered(table(spark, sf_dir, "documents"))
    return docs.select((F.col("rg") % world).alias("stream"), F.col("doc_id").alias("place"), "doc_id", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n"))


@query()
def bestfit_pack(spark, sf_dir):
    return P.interleave(P.pack(_lengths(spark, sf_dir), ROOM, least=32, batch=16))


@query()
def bestfit_audit(spark, sf_dir):
    docs = _lengths(spark, sf_dir)
    return P.audit(docs, P.pack(docs, ROOM, least=32, batch=16), ROOM)


@query()
def sft_pad_pack(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n"))
    return P.pack(turns.select(F.lit(0).cast("long").alias("stream"), F.col("doc_id").alias("place"), "doc_id", "n"), ROOM, least=20, batch=1, crop=False)


@query("SELECT rg % 2 AS stream, e AS epoch, row // 7 AS batch, row % 7 AS slot, row FROM (SELECT (doc_id // 64) % 4 AS rg, row_number() OVER (PARTITION BY ((doc_id // 64) % 4) % 2 ORDER BY doc_id) - 1 AS row, count(*) OVER (PARTITION BY ((doc_id // 64) % 4) % 2) AS n FROM documents), range(0, 2) r(e) WHERE row < n // 7 * 7")
def packed_batches(spark, sf_dir):
    from pyspark.sql import Window

    rows = _lengths(spark, sf_dir).select("stream", (F.row_number().over(Window.partitionBy("stream").orderBy("place")) - 1).cast("long").alias("row"))
    return P.batches(rows, 7, 2).withColumn("epoch", F.col("epoch").cast("long"))
