"""Packing token lists into rows of one length. Streams are independent: each is a task of its own, and what is
packed is lengths; the tokens are joined to their places afterwards."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLACED = "stream long, row long, slot long, doc_id long, start long, n long"


class _Buffer:
    """Documents by (length, arrival): the longest that fits and the shortest, the earliest of equals."""

    def __init__(self):
        self.held: list[tuple[int, int, int]] = []

    def add(self, length: int, arrival: int, doc: int) -> None:
        insort(self.held, (length, arrival, doc))

    def largest(self, room: int):
        at = bisect_left(self.held, (room + 1, -1, -1)) - 1
        if at < 0:
            return None
        return self.held.pop(bisect_left(self.held, (self.held[at][0], -1, -1)))

    def shortest(self):
        return self.held.pop(0)


def _pack(docs, room: int, least: int, batch: int, crop: bool):
    """(row, slot, doc, n) of documents (doc, length) in order. Before each placement the buffer is filled to `least`, a
    batch of documents at a time. If none fits, the shortest is cropped to the rest of the row, or the row is left
    with a gap. With crop, the row at which the documents run out is dropped with what is held; without, all are placed."""
    feed, buffer, arrival, out, row = iter(docs), _Buffer(), 0, [], 0
    ended = False

    def fill() -> None:
        nonlocal arrival, ended
        while len(buffer.held) < least and not ended:
            for _ in range(batch):
                got = next(feed, None)
                if got is None:
                    ended = True
                    return
                buffer.add(got[1], arrival, got[0])
                arrival += 1

    while True:
        rest, placed = room, []
        while rest:
            fill()
            if ended and (crop or not buffer.held):
                break
            got = buffer.largest(rest)
            if got is None and not crop:
                break
            n = min(rest, got[0]) if got else rest
            doc = (got or buffer.shortest())[2]
            placed.append((row, len(placed), doc, n))
            rest -= n
        if ended and crop or not placed:
            return out
        out += placed
        row += 1


def pack(docs: DataFrame, room: int, least: int, batch: int, crop: bool = True) -> DataFrame:
    """Places (stream, row, slot, doc_id, start in the row, n) of `docs` (stream, place, doc_id, n): best fit, see _pack.
    With crop every row is full; without, a row ends in padding, and documents are at most `room` long."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        n = rows["n"] if crop else rows["n"].clip(upper=room)
        got = pd.DataFrame(_pack(zip(rows["doc_id"], n, strict=True), room, least, batch, crop), columns=["row", "slot", "doc_id", "n"]).astype("int64")
        got["stream"] = rows["stream"].iloc[0]
        got["start"] = got.groupby("row")["n"].cumsum() - got["n"]
        return got[["stream", "row", "slot", "doc_id", "start", "n"]]

    return docs.where("n > 0").select("stream", "place", "doc_id", "n").groupBy("stream").applyInPandas(run, PLACED)


def interleave(placed: DataFrame) -> DataFrame:
    """`placed` with row_id: row i of stream r is i * streams + r; streams are cut to the shortest's rows."""
    per = placed.groupBy("stream").agg((F.max("row") + 1).alias("rows"))
    least = per.agg(F.min("rows").alias("_least"), F.count("*").alias("_w"))
    return placed.join(F.broadcast(least)).where("row < _least").withColumn("row_id", F.col("row") * F.col("_w") + F.col("stream")).drop("_least", "_w")


def audit(docs: DataFrame, placed: DataFrame, room: int) -> DataFrame:
    """n_rows, used (share of the rows that tokens fill), cropped (share of the placed documents' tokens that were cut)."""
    rows = placed.groupBy("stream", "row").agg(F.sum("n").alias("u")).agg(F.count("*").alias("n_rows"), F.sum("u").alias("tokens"))
    had = placed.select("doc_id").join(docs.select("doc_id", F.col("n").alias("m")), "doc_id").agg(F.sum("m").alias("had"))
    return rows.join(F.broadcast(had)).select("n_rows", (F.col("tokens") / (F.col("n_rows") * room)).alias("used"), (1 - F.col("tokens") / F.col("had")).alias("cropped"))


def rows_of(tokens: DataFrame, placed: DataFrame, pad: int | None = None, room: int | None = None) -> DataFrame:
    """stream, row, tokens: the token arrays (doc_id, tokens) put together as placed, padded to `room` if pad is given."""
    met = placed.join(tokens, "doc_id").select("stream", "row", F.struct("slot", F.slice("tokens", F.lit(1), F.col("n").cast("int")).alias("t")).alias("x"))
    joined = met.groupBy("stream", "row").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"])).alias("tokens"))
    if pad is None:
        return joined
    return joined.withColumn("tokens", F.concat("tokens", F.array_repeat(F.lit(pad), F.lit(room) - F.size("tokens"))))


def batches(rows: DataFrame, size: int, epochs: int) -> DataFrame:
    """stream, epoch, batch, slot, row: rows in batches of `size`, an epoch after the other; a last partial batch is dropped."""
    many = rows.groupBy("stream").agg(F.count("*").alias("_n"))
    whole = rows.join(many, "stream").where(F.col("row") < F.expr(f"_n div {size}") * size)
    return whole.select("stream", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"), F.expr(f"row div {size}").alias("batch"), (F.col("row") % size).alias("slot"), "row")


def consumed(docs: DataFrame) -> DataFrame:
    """`docs` (stream, place, n) with done, the share of its stream's documents that were taken up to it."""
    own = Window.partitionBy("stream")
    return docs.withColumn("done", F.row_number().over(own.orderBy("place")) / F.count("*").over(own))
