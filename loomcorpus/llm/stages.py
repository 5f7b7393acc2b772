"""The stages of corpus_pipeline.py. All but the last return the columns of `documents` alone."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe as _bpe
from . import common, jaccard, mixing
from . import pii as _pii
from . import toxicity as _toxicity

shared_folder, discard = common.shared_folder, common.discard
TOKENIZER = "word_bpe_49k.json"
#: Rows to leave out (an id and a hash each) that are sent to all tasks at most; with more, texts are shuffled to meet them.
BROADCAST_ROWS = 1_000_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.3) -> DataFrame:
    """Documents that the kernel machine doesn't find toxic. It learns from the labels of documents that are here; without labels of
    both classes all stay. Each row is judged by its text alone, so repeated rows, null ids and texts and other columns don't matter."""
    model = _toxicity.fit(docs, common.read(spark, sf_dir, "labels"))
    if model.weights is None:
        return docs
    return docs.where(common.over_texts(spark, F.col("text"), lambda texts: list(model.score(texts) < least), "boolean"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one row: that of the smallest id, and of an id's texts that with the smallest hash; null ids
    are the largest. Rows are told apart by id and text, so another text of an id stays if it is a copy of nothing, and of equal rows one
    stays. Texts without words are copies of nothing and all stay. An empty table stays empty; other columns pass by."""
    found = jaccard.classes(docs).where("label is not null").select("doc_id", "mark", "label")
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first"))
    with common.Scratch(spark) as scratch:
        met = common.join_split(found, first, "label", "mark").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")))
        gone = scratch.last(met.where("NOT stays").select("doc_id", "mark").distinct(), "gone")
        few = gone.count() <= BROADCAST_ROWS
        twice = scratch.last(met.where("stays").groupBy("doc_id", "mark").count().where("count > 1").drop("count"), "twice")
    key, mark = common.free(docs, "_key"), common.free(docs, "_mark")
    docs_ = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    renamed = lambda other: other.select(F.col("doc_id").alias("i"), F.col("mark").alias("m"))
    among = lambda rows, other, how: rows.join(other, F.col(key).eqNullSafe(F.col("i")) & (F.col(mark) == F.col("m")), how)
    kept = among(docs_, F.broadcast(renamed(gone)) if few else renamed(gone), "left_anti")
    if not twice.isEmpty():
        kept = among(kept, renamed(twice), "left_anti").unionAll(among(kept, renamed(twice), "left_semi").dropDuplicates([key, mark]))
    return kept.select(*common.named(docs.columns))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; n_chars, if there is one, follows the text (null for a null text). Rows stay as many as they
    are, repeated ones and null ids too; an empty table stays empty; other columns pass by."""
    done = _pii.redact(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the raked weights of source, language and topic sample. Rows of equal ids, null ones among them, are taken or left
    together; null keys and texts count as empty; an empty table stays empty; other columns pass by."""
    taken = mixing.names(docs)[2]
    return mixing.mix(docs).where(F.col(taken)).select(*common.named(docs.columns))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's id, token ids, and the text they decode to: none and an empty one for a null text. Repeated rows and null ids stay; an
    empty table gives no rows."""
    return _bpe.encode(docs, public_tokenizers.path(TOKENIZER))
