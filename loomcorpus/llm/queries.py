"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, common, jaccard, mixing, pii, quality, rules, secrets, token_counts, toxicity

#: Folds whose labels no fit may read.
QUALITY_HELD, TOXIC_HELD = (3, 1), (4, 2)


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [common.read(spark, sf_dir, n) for n in names]


def _held(scored: DataFrame, folds: int, held: int) -> DataFrame:
    rest = [c for c in scored.columns if c != "doc_id"]
    return scored.select("doc_id", (common.fold(F.col("doc_id"), folds) == held).alias("held_out"), *rest)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _tables(spark, sf_dir, "documents", "labels")
    model = quality.fit(docs, labels, common.fold(F.col("doc_id"), QUALITY_HELD[0]) != QUALITY_HELD[1])
    return _held(quality.score(docs, model), *QUALITY_HELD)


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(common.read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _tables(spark, sf_dir, "documents", "labels")
    model = toxicity.fit(docs, labels, common.fold(F.col("doc_id"), TOXIC_HELD[0]) != TOXIC_HELD[1])
    return _held(toxicity.score(docs, model), *TOXIC_HELD)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _tables(spark, sf_dir, "documents", "labels")
    return rules.quality_rules(docs, labels)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(common.read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(common.read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(common.read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    with common.Scratch(spark) as scratch:
        found = scratch.last(secrets.candidates(docs), "candidates")  # texts are cut up once
    model = secrets.fit(found.withColumn("label", secrets.weak_labels(found)), secrets.dictionary(docs))
    return secrets.judge(found, model)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    mixed = mixing.mix(docs)
    keys = [F.coalesce(k, F.lit("")).alias(k) for k in ("source", "lang")]
    return mixed.select("doc_id", *keys, F.col("_topic").alias("topic"), F.col("_probability").alias("probability"), F.col("_selected").alias("selected"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES = {f.__name__: f for f in (op1_quality, op2_ann, op3_pii, op4_toxicity, op5_quality_rules, op6_bpe, op7_ngram_jaccard, op8_token_counts, op9_secrets, op10_mixing)}
SQL: dict[str, str] = {"op10_mixing": mixing.oracle_sql()}
