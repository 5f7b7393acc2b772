"""Rows of tokens to batches: inputs and targets, masks, a reader's own rows, exact resumption, plain ways to pack."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


IGNORED = -1


def shifted(row: Column) -> tuple[Column, Column]:
    """(inputs, targets): all of the row but the last token, and all but the first."""
    n = F.greatest(F.size(row) - 1, F.lit(0))
    return F.slice(row, F.lit(1), n), F.slice(row, F.lit(2), n)


def masked_targets(targets: Column, mask: Column, content: Column) -> Column:
    """The targets, IGNORED where the row's mask (of one element more) is 0, and from the place on at which what is
    predicted is padding: the row has `content` tokens of its own."""
    full = F.size(targets) + 1
    return F.transform(targets, lambda t, i: F.when((F.get(mask, i + 1) == 0) | ((content < full) & (i >= content - 1)), F.lit(IGNORED).cast("int")).otherwise(t))


def own_rows(rows: DataFrame, rank: int, world: int) -> DataFrame:
    """The rows (row_id) of one reader of `world`, with pos, their place in its stream. Every stream is as long as the shortest."""
    last = rows.agg(F.expr(f"count(*) div {world}").alias("_n"))
    mine = rows.where(F.col("row_id") % world == rank).withColumn("pos", F.expr(f"row_id div {world}"))
    return mine.join(F.broadcast(last)).where("pos < _n").drop("_n")


def loader(rows: DataFrame, size: int, epochs: int, pos: int = 0, epoch: int = 1) -> DataFrame:
    """epoch, batch_pos, slot, and the columns of a stream's rows (pos): batches of `size` from the state (pos, epoch) on,
    through `epochs`. The state of a batch is its (batch_pos, epoch): a reader that starts there gives the same batches from it on. A stream's
    last partial batch is dropped each epoch, also where it starts at another place than a batch's."""
    many = F.broadcast(rows.agg(F.count("*").alias("_n")))
    each = rows.join(many).withColumn("epoch", F.explode(F.sequence(F.lit(epoch), F.lit(epochs))))
    start = F.when(F.col("epoch") == epoch, F.lit(pos)).otherwise(0)
    ahead = each.withColumn("_k", F.col("pos") - start).where((F.col("_k") >= 0) & (F.col("_k") < F.expr("_n") - F.pmod(F.expr("_n") - start, F.lit(size)) - start))
    return ahead.select("epoch", (F.col("pos") - F.col("_k") % size).alias("batch_pos"), (F.col("_k") % size).alias("slot"), *[c for c in rows.columns])


def batches_of(rows: DataFrame, size: int) -> DataFrame:
    """batch, inputs, targets: arrays of `size` arrays, of rows (pos, tokens) in order; a last partial batch is dropped."""
    x, y = shifted(F.col("tokens"))
    grouped = rows.select(F.expr(f"pos div {size}").alias("batch"), F.struct("pos", x.alias("x"), y.alias("y")).alias("r")).groupBy("batch").agg(F.array_sort(F.collect_list("r")).alias("a"))
    return grouped.where(F.size("a") == size).select("batch", F.transform("a", lambda r: r["x"]).alias("inputs"), F.transform("a", lambda r: r["y"]).alias("targets"))


def one_a_row(tokens: Column, mask: Column, room: int, pad: int) -> tuple[Column, Column, Column]:
    """(tokens, mask, content) of a row that holds one conversation: cropped to `room`, padded with `pad` under a mask of 0."""
    cut, kept = F.slice(tokens, 1, room), F.slice(mask, 1, room)
    rest = F.lit(room) - F.size(cut)
    return F.concat(cut, F.array_repeat(F.lit(pad).cast("int"), rest)), F.concat(kept, F.array_repeat(F.lit(0), rest)), F.size(cut)


def crop_packed(docs: DataFrame, room: int) -> DataFrame:
    """stream, row, used, of documents (stream, place, n) that are put into rows one after the other, each cut where its row is full
    and the rest of it thrown away; so a document starts a row, or the row's last one ends it."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        out, row, used = [], 0, 0
        for n in rows.sort_values("place")["n"]:
            used += min(n, room - used)
            if used == room:
                out.append((row, used))
                row, used = row + 1, 0
        got = pd.DataFrame(out + ([(row, used)] if used else []), columns=["row", "used"]).astype("int64")
        got.insert(0, "stream", rows["stream"].iloc[0])
        return got

    return docs.select("stream", "place", "n").groupBy("stream").applyInPandas(walk, "stream long, row long, used long")


def pad_packed(docs: DataFrame, room: int) -> DataFrame:
    """stream, row, used, of documents (stream, place, n) that are put into rows one after the other: one that doesn't fit begins the next
    row, and a longer one is cut to a row."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for n in rows.sort_values("place")["n"].clip(upper=room):
            if not out or out[-1] + n > room:
                out.append(0)
            out[-1] += n
        return pd.DataFrame({"stream": rows["stream"].iloc[0], "row": range(len(out)), "used": out}).astype("int64")

    return docs.select("stream", "place", "n").groupBy("stream").applyInPandas(walk, "stream long, row long, used long")


def progress(docs: DataFrame, step: int) -> DataFrame:
    """stream, step, taken, done, is_last: after each `step` documents of a stream (stream, place) how many were taken, their share, and
    whether that is all."""
    own = Window.partitionBy("stream")
    many = docs.select("stream", F.row_number().over(own.orderBy("place")).alias("_i"), F.count("*").over(own).alias("_n"))
    ends = many.where((F.col("_i") % step == 0) | (F.col("_i") == F.col("_n")))
    return ends.select("stream", F.ceil(F.col("_i") / step).cast("long").alias("step"), F.col("_i").cast("long").alias("taken"), (F.col("_i") / F.col("_n")).alias("done"), (F.col("_i") == F.col("_n")).alias("is_last"))
