"""Scans: the driver's tables, and the order that a corpus is read in."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Documents of a row group, row groups of a shard, where a table has no files of its own to tell.
GROUP, GROUPS = 64, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered(docs: DataFrame, group: int = GROUP, groups: int = GROUPS) -> DataFrame:
    """`docs` with its place in the corpus: shard, rg (row group of the shard) and pos (row of the group)."""
    whole = F.floor(F.col("doc_id") / group).cast("long")
    return docs.select("*", F.floor(whole / groups).cast("long").alias("shard"), (whole % groups).alias("rg"), (F.col("doc_id") % group).alias("pos"))


def files_in_order(spark: SparkSession, folder: str, legacy: str | None = None) -> DataFrame:
    """All rows of the folder's Parquet files with shard, the rank of their file's name among all. Where the folder isn't there, those
    of the `legacy` one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if legacy and not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        folder = legacy
    rows = spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(folder).withColumn("file", F.col("_metadata.file_path"))
    names = rows.select("file").distinct()
    # As many rows as there are files.
    rank = names.withColumn("shard", (F.row_number().over(Window.orderBy("file")) - 1).cast("long"))
    return rows.join(rank, "file")


def manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of Parquet files with shard, their place in the manifest; columns by name, missing ones null."""
    rows = None
    for i, p in enumerate(paths):
        one = spark.read.parquet(p).withColumn("shard", F.lit(i))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    return rows


def row_count(spark: SparkSession, path: str) -> DataFrame:
    """rows: how many a Parquet table has, from its footers: no column is read."""
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, below spark.checkpoint.dir; on one machine without that, below the temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(folder or tempfile.gettempdir()).rstrip('/')}/files-{uuid.uuid4().hex}"


def _scalar(text: str):
    text = text.strip()
    if text[:1] in ("'", '"'):
        end = text.index(text[0], 1) if text[0] == "'" else re.match(r'"(?:[^"\\]|\\.)*"', text).end() - 1
        return text[1:end] if text[0] == "'" else json.loads(text[: end + 1])
    text = text.split(" #")[0].strip()
    if text.startswith("["):
        return [_scalar(x) for x in text.strip("[]").split(",") if x.strip()]
    return int(text) if re.fullmatch(r"-?\d+", text) else text


def parse_list(text: str) -> list[dict]:
    """The list of flat mappings under the one key of a YAML text, of the plain kind that lists of tasks are written in: `- key: value`,
    lists in brackets or as items of their own, quoted strings, comments."""
    out, key = [], None
    for line in text.splitlines()[1:]:
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        if bare.startswith("-") and key is not None and out and out[-1][key] is None:
            out[-1][key] = [_scalar(bare[1:])]
            continue
        if bare.startswith("-"):
            out.append({})
            bare, key = bare[1:].strip(), None
            if not bare:
                continue
        key, _, value = bare.partition(":")
        out[-1][key] = _scalar(value) if value.strip() else None
    return out


def task_list(spark: SparkSession, text: str) -> DataFrame:
    """label, kind, uri, shots, delimiter (a blank by default) of the tasks that a YAML text lists."""
    rows = [(t["label"], t["icl_task_type"], t["dataset_uri"], int(t["num_fewshot"][0]), t.get("continuation_delimiter", " ")) for t in parse_list(text)]
    return spark.createDataFrame(rows, "label string, kind string, uri string, shots long, delimiter string")


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with a header."""
    return spark.read.option("header", True).schema(schema).csv(path)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON with their schema; a line that doesn't parse becomes nulls."""
    return spark.read.schema(schema).json(path)


def baselines(spark: SparkSession, path: str) -> DataFrame:
    """task, baseline (percent) of a CSV with the header `Eval Task, Random baseline`."""
    rows = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)
    names = {c.strip().lower(): c for c in rows.columns}
    return rows.select(F.trim(names["eval task"]).alias("task"), F.col(names["random baseline"]).try_cast("double").alias("baseline"))


def scores_csv(lines: DataFrame) -> DataFrame:
    """task, accuracy, centred of lines (value, line) of a fixed-width CSV: cells are trimmed, the header goes, what is
    no number becomes null."""
    cell = lambda i: F.trim(F.try_element_at(F.split("value", ","), F.lit(i)))
    rows = lines.where((F.col("line") > 0) & (F.trim("value") != ""))
    return rows.select(cell(1).alias("task"), cell(2).try_cast("double").alias("accuracy"), cell(3).try_cast("double").alias("centred"))


def log_metric(lines: DataFrame, pattern: str, last: bool = True) -> DataFrame:
    """run, value of the last (or first) line of each run that the pattern finds; thousands commas go."""
    found = lines.withColumn("hit", F.regexp_extract("value", pattern, 1)).where("hit <> ''")
    pick = F.max_by if last else F.min_by
    return found.groupBy("run").agg(pick(F.regexp_replace("hit", ",", "").cast("double"), "line").alias("value"))


def last_per_step(records: DataFrame) -> DataFrame:
    """Of records (run, line, step, metric, value) the last line for each run, step and metric."""
    return records.where("value is not null").groupBy("run", "step", "metric").agg(F.max_by("value", "line").alias("value"))


def checkpoint_tag(tag: Column) -> Column:
    """The depth in a tag that starts with d<number>, else null."""
    return F.nullif(F.regexp_extract(tag, r"^d(\d+)", 1), F.lit("")).cast("long")


def checkpoint_step(file: Column) -> Column:
    """The step in the name of a model's file, else null."""
    return F.nullif(F.regexp_extract(file, r"model_(\d+)\.pt$", 1), F.lit("")).cast("long")


def chosen_checkpoint(tags: DataFrame, by: str) -> DataFrame:
    """by, tag: of tags (tag, mtime) the one of the largest depth, or where none tells its depth the newest; ties go to the larger tag."""
    depth = checkpoint_tag(F.col("tag"))
    deepest = F.max_by("tag", F.when(depth.isNotNull(), F.struct(depth.alias("d"), F.col("tag").alias("t"))))
    return tags.groupBy(by).agg(F.coalesce(deepest, F.max_by("tag", F.struct("mtime", "tag"))).alias("tag"))
