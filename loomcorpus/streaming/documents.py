"""The corpus as a stream: a file is a shard, and a checkpoint tells which were read."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream(spark: SparkSession, folder: str, schema, per_trigger: int = 1) -> DataFrame:
    """New Parquet files of the folder, so many a trigger; each is read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def appended(records: DataFrame, path: str, checkpoint: str):
    """Starts a stream that appends records to JSON files, each batch once: one that is written again after a stop takes the place of
    what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(docs: DataFrame, by: str) -> DataFrame:
    """Running counts and characters by a column, for the update and complete modes."""
    return docs.groupBy(by).agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


def cut_rows(docs: DataFrame, room: int) -> DataFrame:
    """Per stream (stream, doc_id, n): full rows (stream, row, first_doc, last_doc) of `room` tokens, documents laid end to end. What
    is left over waits in the state for the next trigger, so triggers don't change the rows."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row, have, first = state.get if state.exists else (0, 0, -1)
        out = []
        for doc, n in sorted((d, n) for p in parts for d, n in zip(p["doc_id"], p["n"], strict=True)):
            first = doc if first < 0 else first
            have += n
            while have >= room:
                out.append((key[0], row, first, doc))
                row, have = row + 1, have - room
                first = doc if have else -1
        state.update((row, int(have), int(first)))
        yield pd.DataFrame(out, columns=["stream", "row", "first_doc", "last_doc"]).astype("int64")

    return docs.groupBy("stream").applyInPandasWithState(step, "stream long, row long, first_doc long, last_doc long", "row long, have long, first long", "append", GroupStateTimeout.NoTimeout)
