"""Writing: shards, rows, metrics, results and stores. Spark's committer publishes a folder whole, with _SUCCESS last."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def shards(docs: DataFrame, path: str, row_group_bytes: int = 1 << 20) -> None:
    """A file a shard (new_shard, then any columns), zstd, in the order of place within it."""
    ready = docs.repartition("new_shard").sortWithinPartitions("new_shard", "place")
    ready.write.option("compression", "zstd").option("parquet.block.size", row_group_bytes).partitionBy("new_shard").parquet(path)


def named_files(rows: DataFrame, path: str, name: str, order: str) -> None:
    """A folder of one file for each value of `name`, its rows in an order."""
    rows.repartition(name).sortWithinPartitions(name, order).write.partitionBy(name).parquet(path)


def metrics(old: DataFrame, new: DataFrame, step: int, path: str) -> None:
    """Records of a resumed run: the old ones before `step` (or without a step), then the new. `old` may have been read from `path`: what is
    written stands beside it first, and takes its place when it is whole."""
    spark, beside = old.sparkSession, f"{path}-{uuid.uuid4().hex}"
    old.where(F.coalesce("step", F.lit(-1)) < step).unionByName(new, allowMissingColumns=True).write.json(beside)
    files, at = _files(spark, path)
    if files.exists(at):
        files.delete(at, True)
    files.rename(_files(spark, beside)[1], at)
    spark.catalog.refreshByPath(path)


def results(rows: DataFrame, path: str, key: list[str]) -> None:
    """Appends the rows whose key the CSV files at `path`, if there are any, don't have yet."""
    if exists(rows.sparkSession, path):
        have = rows.sparkSession.read.option("header", True).csv(path)
        rows = rows.join(have.select(*(F.col(k).cast(rows.schema[k].dataType).alias(k) for k in key)), key, "left_anti")
    rows.write.mode("append").option("header", True).csv(path)


def fixed_width(rows: DataFrame) -> DataFrame:
    """`rows` with value: lines of task, accuracy, centred in columns of one width."""
    return rows.withColumn("value", F.format_string("%-35s, %-10.6f, %-10.6f", "task", "accuracy", "centred"))


def store(spark: SparkSession, path: str, config: dict, **parts: DataFrame) -> None:
    """Tables in folders of their own and, last, a row with the configuration: a store without it isn't whole."""
    for name, rows in parts.items():
        rows.write.parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "config string").coalesce(1).write.json(f"{path}/config")


def open_store(spark: SparkSession, path: str) -> tuple[dict, Callable[[str], DataFrame]]:
    """(configuration, a function from a part's name to its table); an error for a store that isn't whole."""
    if not exists(spark, f"{path}/config/_SUCCESS"):
        raise ValueError(f"no whole store at {path}")
    return json.loads(spark.read.json(f"{path}/config").first()["config"]), lambda name: spark.read.parquet(f"{path}/{name}")
