"""Shared helpers of the training-data operators.

Every operator reads only the columns it names, so extra columns (whatever their names) pass by
untouched or are ignored. A null text is an empty text everywhere; a null doc_id is carried as is.
"""

from __future__ import annotations

import ctypes
import gc
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of an Arrow function looks at together; a longer text comes alone.
SLICE_BYTES = 2 << 20

#: Bytes of a batch that the JVM sends to a Python worker; a longer row comes alone.
BATCH_BYTES = 8 << 20

#: Bytes of text that a fit may read.
SAMPLE_BYTES = 64 << 20

#: The ASCII white space that parts words: [\x20\x09-\x0D].
SPACE = b" \t\n\r\x0b\x0c"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in no fold (-1)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(-1))


def byte_slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(ids, texts as UTF-8) in runs of about `limit` bytes, so that memory doesn't follow the batch."""
    ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
    start, held, out = 0, 0, []
    for i, text in enumerate(texts):
        out.append(text.as_py() or b"")
        held += len(out[-1])
        if held >= limit:
            yield ids.slice(start, len(out)), out
            start, held, out = i + 1, 0, []
    if out:
        yield ids.slice(start, len(out)), out


def give_back() -> None:
    """Returns the worker's freed memory to the system: a reused worker else keeps the most that any task took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def resting(run: Callable[[Iterator], Iterator], *empty: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """`run` over a task's batches; when the task ends, or is killed, `empty` are called and memory is given back."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            for f in empty:
                f()
            give_back()

    return whole


def hold_batches(spark: SparkSession) -> None:
    """Bounds the batches that tasks send to Python by BATCH_BYTES; a bound that the session has of its own, a smaller one, stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
    if have and int(have[1]) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, *empty: Callable[[], None]) -> DataFrame:
    """mapInArrow over batches bounded by bytes, in workers that give their memory back."""
    hold_batches(rows.sparkSession)
    return rows.mapInArrow(resting(run, *empty), schema)


def scan(docs: DataFrame, step: Callable[[list[bytes]], dict], schema: str, *empty: Callable[[], None]) -> DataFrame:
    """Maps `step` over the texts of (doc_id, text). It returns a list or array per column of `schema`
    after doc_id. One pass, no shuffle; a lost task is run again from its input split."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for batch in batches:
            for ids, texts in byte_slices(batch):
                got = step(texts)
                types = types or {n: _arrow(t) for n, t in (x.strip().split(None, 1) for x in schema.split(","))}
                yield pa.record_batch([ids.cast(pa.int64()), *(pa.array(got[n], types[n]) for n in names)], ["doc_id", *names])

    return arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, f"doc_id long, {schema}", *empty)


def over_texts(spark: SparkSession, text: Column, step: Callable[[list[str]], list], kind: str) -> Column:
    """A column of what `step` makes of the texts (null: empty), a run of about SLICE_BYTES characters at a time."""
    hold_batches(spark)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out, part, held = [], [], 0
            for t in texts:
                part.append(t)
                held += len(t)
                if held >= SLICE_BYTES:
                    out += list(step(part))
                    part, held = [], 0
            yield pd.Series(out + list(step(part)) if part else out, dtype=object if kind == "string" else None)

    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from resting(run)(batches)

    return F.pandas_udf(whole, kind)(F.coalesce(text, F.lit("")))


def _arrow(kind: str) -> pa.DataType:
    kind = kind.strip()
    if kind.startswith("array<"):
        return pa.list_(_arrow(kind[6:-1]))
    return {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[kind]


def free(rows: DataFrame, name: str) -> str:
    """`name`, with as many underscores as it takes not to be a column of `rows`."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(columns: list[str]) -> list[Column]:
    """The columns of these names, whatever characters they hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, where: Column | None = None, of_0: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) of at most `per_class` labelled rows of either class (or `of_0` of label 0), and (doc_id, y).

    The rows are those with the smallest hash of their id, so the sample is the same on every run.
    Only their ids, bounded by the parameter, are broadcast. A doc_id with several labels counts with
    the largest one; null labels are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    if where is not None:
        known = known.where(where)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    part = lambda y, n: known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = keep(part(0, of_0 or per_class).unionAll(part(1, per_class)), "sample")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked.select("doc_id")), "doc_id"), picked


def trained(docs: DataFrame, labels: DataFrame, label: str, per_class: int, learn: Callable[[list[str], np.ndarray], object], where: Column | None = None, of_0: int | None = None, most_bytes: int = SAMPLE_BYTES):
    """What `learn` makes of a labelled sample (see labelled_sample), in one task, whose input `per_class` and `most_bytes` bound: a text
    with which the sample would be longer is passed over. None without rows. The driver gets the model alone."""
    rows, known = labelled_sample(docs, labels, label, per_class, where, of_0)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for batch in batches:
            for _, text, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held + len(text) <= most_bytes:
                    held += len(text)
                    got.append((text, y))
        if got:
            yield pa.record_batch([pa.array([pickle.dumps(learn([t for t, _ in got], np.array([y for _, y in got], np.int64)))], pa.binary())], ["model"])

    some = rows.join(F.broadcast(known), "doc_id").select(F.xxhash64("doc_id").alias("h"), F.coalesce("text", F.lit("")).alias("text"), "y")
    got = arrow(some.repartition(1).sortWithinPartitions("h", "text"), train, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else None


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir. Where that isn't set, a session
    on one machine, as in tests, has its temporary folder; any other is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(folder or f'{tempfile.gettempdir()}/loomcorpus').rstrip('/')}/{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that shared_folder() gave, wherever it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables kept for a while: put() writes `rows` as Parquet to the shared folder and reads them from there, so they are computed
    once, have no lineage and are read by columns. When the block ends, all but those of last() are deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.of_result = spark, shared_folder(spark), shared_folder(spark)
        self.count = 0

    def put(self, rows: DataFrame, name: str, folder: str | None = None) -> DataFrame:
        self.count += 1
        path = f"{folder or self.folder}/{name}-{self.count}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def last(self, rows: DataFrame, name: str = "result") -> DataFrame:
        """Keeps what the caller gets to read."""
        return self.put(rows, name, self.of_result)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        discard(self.spark, self.folder)


def join_split(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner", counted: DataFrame | None = None, share: int = 2000, least: int = 300) -> DataFrame:
    """left.join(right, key, how), by a shuffle in which no key lands in one task with many more rows of `left` than others.

    Of the `share` keys with the most rows (a bounded list, all that reaches the driver) those with over `least`, and over 1 / share of all
    the listed ones' rows, are split: their rows are dealt out by the hash of the column `spread`, and right's rows of that key go to each
    part. A key that isn't listed has fewer rows than any that is, so under 1 / share of `left`. `counted`: rows with the keys of `left`, where they
    are cheaper to read."""
    counts = (left if counted is None else counted).groupBy(key).agg(F.count("*").alias("_n"))
    most = counts.where(F.col("_n") > least).orderBy(F.desc("_n")).limit(share)
    top = most.toArrow()
    n = top["_n"].to_numpy()
    limit = max(least, int(n.sum()) // share)
    hot = n > limit
    if not hot.any():
        return left.join(right, key, how)
    # From Arrow, not from rows: rows would start Python workers of another kind, which stay beside those of the Arrow functions.
    hot_ = pa.table({key: top[key].filter(pa.array(hot)), "_salts": pa.array(-(-n[hot] // limit), pa.int32())})
    listed, salts = F.broadcast(left.sparkSession.createDataFrame(hot_)), F.coalesce("_salts", F.lit(1))
    dealt = left.join(listed, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("_salts")
    sent = right.join(listed, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(sent, [key, "_salt"], how).drop("_salt")


def keep(df: DataFrame, name: str) -> DataFrame:
    """`df`, written as Parquet to the shared folder and read from there: computed once, with no lineage,
    and read by columns."""
    folder = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
