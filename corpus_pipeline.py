"""A corpus from raw documents to token ids, in five stages that each call one operator.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame;
run() writes each as Parquet into the folder of spark.checkpoint.dir and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomcorpus.llm import stages

STAGES = [
    ("toxicity", stages.toxicity),
    ("near_duplicates", stages.near_duplicates),
    ("pii", stages.pii),
    ("mixture", stages.mixture),
    ("bpe", stages.bpe),
]

#: SQL can't express a string-kernel machine or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table `documents`. What a stage has written is deleted when the next has been; the last one's
    stays for the caller. Null, empty and long texts, repeated rows, an empty table and other columns are as each stage says."""
    folder = stages.shared_folder(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        at = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            stages.discard(spark, before)
        before = at
    return docs
