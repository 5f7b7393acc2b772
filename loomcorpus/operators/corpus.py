"""Corpus order: split, stride, resumption, budgets, shard totals, cutting into shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def split_last(docs: DataFrame) -> DataFrame:
    """`docs` with split: "val" in the last shard, else "train". The last shard is one aggregated row."""
    last = docs.agg(F.max("shard").alias("_last"))
    return docs.join(F.broadcast(last)).withColumn("split", F.when(F.col("shard") == F.col("_last"), "val").otherwise("train")).drop("_last")


def stride(docs: DataFrame, world: int) -> DataFrame:
    """`docs` with rank: the reader that row group rg of each shard belongs to."""
    return docs.withColumn("rank", F.col("rg") % world)


def resume(docs: DataFrame, shard: int, rg: int, rank: int, world: int, epochs: int) -> DataFrame:
    """What the reader `rank` of `world` still gives, with epoch, after it has stopped in row group rg of the shard: the
    next round of row groups there, later shards, and all its row groups in each further epoch."""
    mine = docs.where(F.col("rg") % world == rank)
    start = (rg // world + 1) * world + rank
    ahead = (F.col("shard") > shard) | ((F.col("shard") == shard) & (F.col("rg") >= start))
    every = mine.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    return every.where((F.col("epoch") > 1) | ahead)


def batched(docs: DataFrame, size: int) -> DataFrame:
    """`docs` with batch, the run of `size` documents of its row group that each is in: batches never cross a row group."""
    return docs.withColumn("batch", F.expr(f"pos div {size}"))


def running_sum(rows: DataFrame, value: str, out: str, part: str = "shard", order: tuple[str, ...] = ("rg", "pos")) -> DataFrame:
    """`rows` with the sum of `value` up to and with each row, in the order of part, then order.

    Only the parts' totals, one row each, are summed in one place; the rows are summed within their part."""
    totals = rows.groupBy(part).agg(F.sum(value).alias("_t"))
    before = totals.select(part, F.coalesce(F.sum("_t").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum(value).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(before, part).withColumn(out, F.col("_before") + own).drop("_before")


def cap_and_budget(docs: DataFrame, cap: int, budget: int) -> DataFrame:
    """doc_id, n_capped, total of the documents in order, each cut to `cap` code points, until their total is over the
    budget; the document that crosses it is in."""
    cut = docs.select("doc_id", "shard", "rg", "pos", F.length(F.substring("text", 1, cap)).cast("long").alias("n_capped"))
    return running_sum(cut, "n_capped", "total").where(F.col("total") - F.col("n_capped") <= budget).select("doc_id", "n_capped", "total")


def shard_totals(docs: DataFrame) -> DataFrame:
    """shard, docs, chars, chars_so_far."""
    per = docs.groupBy("shard").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))
    return per.withColumn("chars_so_far", F.sum("chars").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)))


def cut_shards(docs: DataFrame, chars: int, block: int, keep_tail: bool = False) -> DataFrame:
    """block_id, new_shard, of blocks of `block` documents in order: a shard ends with the block at which it has
    `chars` characters. The unfinished last shard is left out unless keep_tail.

    The cut depends on where the last one was, so the blocks' sums, two numbers a block, are walked in order in one task, a
    batch at a time: it holds one batch and goes from cut to cut by bisection of running sums. The documents aren't walked."""
    sums = docs.groupBy(F.floor(F.col("doc_id") / block).cast("long").alias("block_id")).agg(F.sum(F.length("text")).cast("long").alias("chars"), F.count("*").alias("n"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = 0, 0
        for b in batches:
            total, full = np.cumsum(b.column(1).to_numpy()), b.column(2).to_numpy() == block
            ends, gone, at = np.flatnonzero(full), 0, 0
            out = np.empty(len(b), np.int64)
            while at < len(b):
                # The first full block from here at which what is held reaches the size.
                reach = np.searchsorted(total, chars - held + gone)
                k = np.searchsorted(ends, max(reach, at))
                stop = int(ends[k]) if k < len(ends) else len(b)
                out[at : stop + 1] = shard
                if stop == len(b):
                    held += int(total[-1]) - gone
                    break
                shard, held, gone, at = shard + 1, 0, int(total[stop]), stop + 1
            yield pa.record_batch([b.column(0), pa.array(out)], ["block_id", "new_shard"])

    walked = sums.repartition(1).sortWithinPartitions("block_id").mapInArrow(walk, "block_id long, new_shard long")
    if keep_tail:
        return walked
    # The last shard is whole only if its last block ends it, so its size tells.
    sizes = walked.join(sums, "block_id").groupBy("new_shard").agg(F.sum("chars").alias("c"), F.max_by("n", "block_id").alias("n"))
    return walked.join(sizes.where((F.col("c") >= chars) & (F.col("n") == block)), "new_shard").select("block_id", "new_shard")


def first_in_order(docs: DataFrame, n: int, part: str = "shard", order: tuple[str, ...] = ("rg", "pos")) -> DataFrame:
    """The first n documents in order, across files."""
    return running_sum(docs.withColumn("_one", F.lit(1)), "_one", "_nth", part, order).where(F.col("_nth") <= n).drop("_one", "_nth")


def content_ids(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, content_id: the smallest key of the rows of equal text. Texts meet by their SHA-256; a much repeated
    one is aggregated before it is shuffled, and joined back by a join that can be split."""
    hashed = rows.select(key, F.sha2(text, 256).alias("_h"))
    return hashed.join(hashed.groupBy("_h").agg(F.min(key).alias("content_id")), "_h").select(key, "content_id")


def strip_sections(text):
    """The text before the first line that is a closing section's header; a header needs a line break on both sides."""
    return F.split(text, "\n(References|External links|See also|Further reading|Notes)\n", 2)[0]


def chunk_starts(n, size: int, overlap: int):
    """Starts of chunks of `size` tokens that lap over by about `overlap` and end with the last token: none for fewer
    tokens than a chunk. The number of chunks is rounded half to even."""
    k = F.bround((n - size) / F.lit(size - overlap).cast("double"), 0).cast("long") + 1
    spread = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda i: F.floor(i * (n - size) / F.greatest(k - 1, F.lit(1))).cast("long"))
    return F.when(n < size, F.array().cast("array<long>")).when(k <= 1, F.array(F.lit(0).cast("long"))).otherwise(spread)


def word_chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, chunk_idx, start, chunk (words joined by blanks)."""
    words = docs.select("doc_id", F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"))
    starts = words.select("doc_id", "words", F.posexplode(chunk_starts(F.size("words").cast("long"), size, overlap)).alias("chunk_idx", "start"))
    return starts.select("doc_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "start", F.array_join(F.slice("words", (F.col("start") + 1).cast("int"), size), " ").alias("chunk"))
