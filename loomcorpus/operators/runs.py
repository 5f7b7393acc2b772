"""Training runs: logs, comparison, scaling fits, schedules, cost."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interpolated(points: DataFrame, grid: DataFrame, beyond: float = 1.02) -> DataFrame:
    """run, x, y of every run's (run, x, y) at the grid's x, by straight lines between its points. Only from the
    run's first x to `beyond` times its last, past which the last y holds. Runs have a point an x.

    Points and grid are put in one order for each run, and each place of the grid looks back and ahead for its neighbours, so no side
    is searched for each row of the other."""
    none = F.lit(None).cast("double")
    asked = points.select("run").distinct().join(grid.select(F.col("x").cast("double").alias("x")).distinct()).select("run", "x", none.alias("px"), none.alias("py"))
    known = points.select("run", F.col("x").cast("double").alias("x"), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    own, turned = Window.partitionBy("run").orderBy("x"), Window.partitionBy("run").orderBy(F.desc("x"))
    point = F.when(F.col("px").isNotNull(), F.struct("px", "py"))
    back = F.last(point, True).over(own.rangeBetween(Window.unboundedPreceding, 0))
    # The same as the first of all rows ahead, but a frame that grows: one that shrinks is read anew for each row.
    ahead = F.last(point, True).over(turned.rangeBetween(Window.unboundedPreceding, 0))
    met = known.unionAll(asked).select("run", "x", "px", back.alias("a"), ahead.alias("b")).where("px IS NULL AND a IS NOT NULL")
    y = F.when(F.col("b").isNull() | (F.col("a.px") == F.col("b.px")), F.col("a.py")).otherwise(F.col("a.py") + (F.col("b.py") - F.col("a.py")) * (F.col("x") - F.col("a.px")) / (F.col("b.px") - F.col("a.px")))
    return met.where(F.col("b").isNotNull() | (F.col("x") <= F.col("a.px") * beyond)).select("run", "x", y.alias("y"))


def summary(points: DataFrame) -> DataFrame:
    """run, least, final, most of y."""
    return points.groupBy("run").agg(F.min("y").alias("least"), F.max_by("y", "x").alias("final"), F.max("y").alias("most"))


def quadratic(points: DataFrame, by: str) -> DataFrame:
    """by, n, best_x, best_y: the vertex of the parabola through (x, y) by least squares if it opens upwards and there are 3
    points of different x, else the least point. Sums of powers of the centred x give it, so groups are aggregated once."""
    mean = points.groupBy(by).agg(F.avg("x").alias("_c"))
    z = points.join(mean, by).withColumn("z", F.col("x") - F.col("_c"))
    s = lambda e: F.sum(F.expr(e))
    t = z.groupBy(by).agg(F.first("_c").alias("c"), F.count("*").alias("n"), F.countDistinct("x").alias("d"), s("z*z").alias("s2"), s("z*z*z").alias("s3"), s("z*z*z*z").alias("s4"), s("y").alias("t0"), s("z*y").alias("t1"), s("z*z*y").alias("t2"), F.min_by("x", F.struct("y", "x")).alias("rx"), F.min("y").alias("ry"))
    det = F.expr("n * (s2 * s4 - s3 * s3) - s2 * s2 * s2")
    a = F.expr("n * (s2 * t2 - s3 * t1) - s2 * s2 * t0") / F.nullif(det, F.lit(0.0))
    b = (F.col("t1") - a * F.col("s3")) / F.nullif("s2", F.lit(0.0))
    c0 = (F.col("t0") - a * F.col("s2")) / F.col("n")
    ok = (F.col("d") >= 3) & (a > 0)
    return t.select(by, "n", F.when(ok, F.col("c") - b / (2 * a)).otherwise(F.col("rx")).alias("best_x"), F.when(ok, c0 - b * b / (4 * a)).otherwise(F.col("ry")).alias("best_y"))


def power_law(points: DataFrame) -> DataFrame:
    """exponent, factor, r2 of y = factor * x ** exponent, a straight line through the logarithms."""
    z = points.where("x > 0 AND y > 0").select(F.log10("x").alias("x"), F.log10("y").alias("y"))
    return z.agg(F.regr_slope("y", "x").alias("exponent"), F.pow(F.lit(10.0), F.regr_intercept("y", "x")).alias("factor"), F.regr_r2("y", "x").alias("r2"))


def ols(points: DataFrame, *by: str) -> DataFrame:
    """slope, intercept, r2 of y on x."""
    return points.groupBy(*by).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))


def ridge(rows: DataFrame, features: list[str], target: str, alpha: float) -> np.ndarray:
    """Weights and, last, the intercept, which isn't penalised, of least squares plus alpha times the squared weights. One
    aggregation gives the sums of products; the driver solves as many equations as there are features."""
    names = [*features, "1", target]
    value = lambda n: F.lit(1.0) if n == "1" else F.col(n).cast("double")
    got = rows.agg(*(F.sum(value(a) * value(b)).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j)).first()
    full = np.array([[got[f"s{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))], float)
    n = len(names) - 1
    return np.linalg.solve(full[:n, :n] + alpha * np.diag([1.0] * (n - 1) + [0.0]), full[:n, n])


def debiased_ema(points: DataFrame, beta: float) -> DataFrame:
    """run, step, ema: the moving average with weight beta on what was, over 1 - beta ** (steps so far).

    A run is cut into blocks so long that powers of beta stay in range. Within a block the average is a running sum of weighted values;
    what the blocks before it leave is the sum of their last averages, as many of them as still count in double precision."""
    decay = -math.log(beta)
    size = max(1, min(4096, int(230 / decay)))
    depth = max(1, math.ceil(41 / (size * decay)))
    n = F.row_number().over(Window.partitionBy("run").orderBy("step"))
    rows = points.select("run", "step", "value", n.alias("n")).withColumn("block", F.expr(f"(n - 1) div {size}")).withColumn("i", (F.col("n") - 1) % size)
    power = lambda e: F.pow(F.lit(beta), e)
    inner = F.sum(F.col("value") * (1 - beta) * power(-F.col("i"))).over(Window.partitionBy("run", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("own", inner * power(F.col("i")))
    ends = rows.where(F.col("i") == size - 1).select("run", "block", "own")
    order = Window.partitionBy("run").orderBy("block")
    left = ends.select("run", (F.col("block") + 1).alias("block"), sum((F.coalesce(F.lag("own", k).over(order), F.lit(0.0)) * (beta ** (size * k)) for k in range(1, depth)), F.col("own")).alias("before"))
    met = rows.join(left, ["run", "block"], "left")
    whole = F.col("own") + F.coalesce("before", F.lit(0.0)) * power(F.col("i") + 1)
    return met.select("run", F.col("step").cast("long").alias("step"), (whole / (1 - power(F.col("n")))).alias("ema"))


def learning_rate(step: Column, steps: int, warm: float, down: float, final: float) -> Column:
    """1 after a straight warm-up over the first share, then straight down to `final` over the last share."""
    up, start = round(warm * steps), steps - round(down * steps)
    return F.when(step < up, (step + 1) / float(max(1, up))).when(step <= start, 1.0).otherwise((steps - step) / float(max(1, steps - start)) * (1 - final) + final)


def crossings(steps: DataFrame, every: float) -> DataFrame:
    """run, step at which flops passes a multiple of `every`, the first step too."""
    before = F.coalesce(F.lag("flops").over(Window.partitionBy("run").orderBy("step")), F.lit(-1.0))
    return steps.withColumn("_b", before).where(F.floor(F.col("flops") / every) > F.floor(F.col("_b") / every)).drop("_b")


def device_peak(names: DataFrame, peaks: DataFrame) -> DataFrame:
    """name, peak of the first of `peaks` (priority, patterns, peak) all of whose patterns the name holds; infinity for none.
    `peaks` is a short table of devices."""
    holds = F.forall("patterns", lambda p: F.contains(F.lower("name"), p))
    met = names.join(F.broadcast(peaks), holds, "left")
    return met.groupBy("name").agg(F.coalesce(F.min_by("peak", "priority"), F.lit(float("inf"))).alias("peak"))


def model_shape(depth: Column, aspect: int = 64, head: int = 128) -> dict[str, Column]:
    """dim: depth times aspect, up to a multiple of a head; heads."""
    dim = (F.ceil(depth * aspect / head) * head).cast("long")
    return {"dim": dim, "heads": (dim / head).cast("long")}


def windows(depth: Column, pattern: str, length: int) -> Column:
    """The attention window of each layer: L the whole length, S a quarter of it up to a multiple of 128; the pattern
    repeats, and the last layer is long."""
    short = -(-length // 4 // 128) * 128
    return F.transform(F.sequence(F.lit(0), depth.cast("int") - 1), lambda i: F.when((F.substring(F.lit(pattern), i % len(pattern) + 1, F.lit(1)) == "S") & (i < depth - 1), short).otherwise(length))


def valid(rows: DataFrame, loss: str = "val_bpb") -> DataFrame:
    """Runs that ended: their loss is there and above 0."""
    return rows.where(F.col(loss).isNotNull() & ~F.isnan(F.col(loss).cast("double")) & (F.col(loss) > 0))


def effective(rows: DataFrame) -> DataFrame:
    """`rows` (transformer, lm_head, tokens) with params, those that multiply tokens, and ratio, tokens a parameter."""
    params = F.col("transformer") + F.col("lm_head")
    return rows.withColumn("params", params).withColumn("ratio", F.col("tokens") / F.nullif(params, F.lit(0)))


def first_by(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Of each group, each column's first value that isn't null, in an order: one row a group."""
    rest = [c for c in rows.columns if c != by]
    least = [F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v")))) for c in rest]
    return rows.groupBy(by).agg(*(m["v"].alias(c) for m, c in zip(least, rest, strict=True)))


def least_row(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The row of each group with the least value, the first in an order of several; nulls and NaN don't count."""
    own = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    rest = [c for c in rows.columns if c != by]
    return own.groupBy(by).agg(F.min_by(F.struct(*rest), F.struct(value, order)).alias("_r")).select(by, "_r.*")


def spread(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """mean and deviation (of a sample: null for one row) of a column."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"), F.count(value).alias("n"))


def mean_of_means(rows: DataFrame, value: str, group: str, *by: str) -> DataFrame:
    """mean over groups of the groups' own means, each group the same weight."""
    own = rows.groupBy(*by, group).agg(F.avg(value).alias("_m"))
    return own.groupBy(*by).agg(F.avg("_m").alias("mean"), F.count("*").alias("groups"))


def totals_by(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, total of each group, and a row `total` of all."""
    return rows.rollup(by).agg(F.sum(value).alias("total"), F.grouping(by).alias("_g")).select(F.when(F.col("_g") == 1, "total").otherwise(F.col(by)).alias(by), "total")


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, median: the element n div 2, from 0, of the values in order: of an even number the upper of the two in the middle."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(value)) - 1
    many = F.count("*").over(Window.partitionBy(by))
    at = rows.withColumn("_i", place).withColumn("n", many).where(F.col("_i") == F.expr("n div 2"))
    return at.select(by, "n", F.col(value).alias("median"))


def utilisation(step: Column, rows: Column, weights: Column, kv_read: Column, flops: Column, peak_bytes: Column, peak_flops: Column) -> tuple[Column, Column]:
    """Percent of the peak memory rate and of the peak rate of operations that a decoding step of that many seconds uses."""
    return 100 * (weights + rows * kv_read) / step / peak_bytes, 100 * (rows * flops) / step / peak_flops


def ceilings(memory: Column, weights: Column, kv_token: Column, length: Column, kv_read: Column, peak_bytes: Column) -> tuple[Column, Column]:
    """Tokens a second that one row can reach if all weights and its cache are read a step; rows whose caches fit beside the weights."""
    return peak_bytes / (weights + kv_read), F.floor((memory - weights) / (kv_token * length)).cast("long")


def ridge_grid(rows: DataFrame, features: list[str], target: str, alphas: list[float]) -> DataFrame:
    """alpha, r2 and the weights (intercept last) of ridge regressions over a grid. Sums of products, aggregated once, give all of them."""
    names = [*features, "1", target]
    value = lambda n: F.lit(1.0) if n == "1" else F.col(n).cast("double")
    got = rows.agg(*(F.sum(value(a) * value(b)).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j)).first()
    full = np.array([[got[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(names))] for i in range(len(names))], float)
    n = len(names) - 1
    gram, cross, square = full[:n, :n], full[:n, n], full[n, n]
    out = []
    for alpha in alphas:
        w = np.linalg.lstsq(gram + alpha * np.diag([1.0] * (n - 1) + [0.0]), cross, rcond=None)[0]
        rest = square - 2 * w @ cross + w @ gram @ w
        around = square - full[n - 1, n] ** 2 / max(1.0, full[n - 1, n - 1])
        out.append((float(alpha), float(1 - rest / around) if around > 0 else None, w.tolist()))
    return rows.sparkSession.createDataFrame(out, "alpha double, r2 double, weights array<double>")
