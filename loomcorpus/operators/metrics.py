"""Evaluation: bits per byte, centred accuracy, pass at k, span scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bits_per_byte(tokens: DataFrame, *by: str) -> DataFrame:
    """Sum of nats over ln 2 times the bytes, of tokens (nats, n_bytes, target): those without bytes and those with a
    target below 0 don't count. Infinity where nothing counts."""
    counts = (F.col("n_bytes") > 0) & (F.col("target") >= 0)
    sums = tokens.groupBy(*by).agg(F.coalesce(F.sum(F.when(counts, F.col("nats"))), F.lit(0.0)).alias("nats"), F.coalesce(F.sum(F.when(counts, F.col("n_bytes"))), F.lit(0)).alias("n_bytes"))
    return sums.withColumn("bpb", F.when(F.col("n_bytes") > 0, F.col("nats") / (F.log(F.lit(2.0)) * F.col("n_bytes"))).otherwise(float("inf")))


def accuracy(scored: DataFrame, *by: str) -> DataFrame:
    """Mean of correct (0 or 1); no row for what has none."""
    return scored.groupBy(*by).agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count("*").alias("n"))


def with_baseline(rows: DataFrame, baselines: DataFrame, missing: float | None = None) -> DataFrame:
    """`rows` (task) with baseline. A task that has none gets `missing`, or is an error when it is read."""
    none = F.raise_error(F.concat(F.lit("no baseline: "), "task")).cast("double") if missing is None else F.lit(missing)
    return rows.join(baselines.select("task", "baseline"), "task", "left").withColumn("baseline", F.coalesce("baseline", none))


def centred(rows: DataFrame, percent: bool) -> DataFrame:
    """`rows` (accuracy, baseline) with centred: 0 at the baseline, 1 at all right. The baseline is in percent or a share."""
    b = F.col("baseline") * (0.01 if percent else 1.0)
    return rows.withColumn("centred", (F.col("accuracy") - b) / F.nullif(1 - b, F.lit(0.0)))


def composite(rows: DataFrame, tasks: list[str]) -> DataFrame:
    """Mean of centred over the tasks; no row unless all are there."""
    of = rows.where(F.col("task").isin(tasks))  # all tasks, or the categorical ones alone
    return of.agg(F.avg("centred").alias("composite"), F.countDistinct("task").alias("n_tasks")).where(F.col("n_tasks") == len(tasks))


def pass_at_k(samples: DataFrame, k: int) -> DataFrame:
    """k, passed: the share of problems of which one of the first 1, 2, ... k samples (problem, sample, correct) is right."""
    first = samples.where("correct").groupBy("problem").agg(F.min("sample").alias("first"))
    problems = samples.select("problem").distinct().join(first, "problem", "left")
    each = problems.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return each.groupBy(F.col("k").cast("long").alias("k")).agg(F.avg(F.coalesce((F.col("first") < F.col("k")).cast("double"), F.lit(0.0))).alias("passed"))


def advantage(samples: DataFrame) -> DataFrame:
    """`samples` with advantage: reward less the mean of its problem's. The means are aggregated first, and joined."""
    mean = samples.groupBy("problem").agg(F.avg("reward").alias("_m"))
    return samples.join(mean, "problem").withColumn("advantage", F.col("reward") - F.col("_m")).drop("_m")


def span_mean(losses, start, end):
    """Mean of losses[start - 1 : end - 1]: those of the tokens start to end - 1, predicted one place before."""
    part = F.slice(losses, F.greatest(start, F.lit(1)).cast("int"), (end - start).cast("int"))
    return F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part)


def best_option(options: DataFrame, value: str, least: bool = True) -> DataFrame:
    """item, option of the least (or largest) value; the first of several."""
    order = F.col(value).asc() if least else F.col(value).desc()
    return options.withColumn("_n", F.row_number().over(Window.partitionBy("item").orderBy(order, "option"))).where("_n = 1").drop("_n")


def common_prefix(*arrays):
    """How many elements all arrays start with alike; each array is gone through once."""
    if len(arrays) == 1:
        return F.size(arrays[0]).cast("long")
    least = F.least(*map(F.size, arrays))
    first, *rest = (F.slice(a, F.lit(1), least) for a in arrays)
    same = None
    for other in rest:
        one = F.zip_with(first, other, lambda x, y: x.eqNullSafe(y))
        same = one if same is None else F.zip_with(same, one, lambda x, y: x & y)
    stop = F.array_position(same, False)
    return F.when(stop > 0, stop - 1).otherwise(least).cast("long")


def common_suffix(*arrays):
    return common_prefix(*map(F.reverse, arrays))


def left_crop(tokens, most: int):
    """The last `most` elements."""
    return F.slice(tokens, F.greatest(F.size(tokens) - most, F.lit(0)) + 1, most)


def right_pad(tokens, size, pad):
    return F.concat(tokens, F.array_repeat(pad, F.greatest(size - F.size(tokens), F.lit(0))))


def cropped_span(tokens, start, end, most: int):
    """(tokens, start, end): the last `most` tokens, and the span's places in them; what is cut off on the left goes from either place. A
    span that would begin before the first token begins with it."""
    off = F.greatest(F.size(tokens) - most, F.lit(0))
    return left_crop(tokens, most), F.greatest(start - off, F.lit(0)), F.greatest(end - off, F.lit(0))
