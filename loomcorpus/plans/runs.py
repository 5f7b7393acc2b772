"""Queries over runs; users of `events` stand for runs, their events for steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from ..sources.tables import last_per_step, table
from .registry import query


@query("""WITH r AS (SELECT user_id % 20 AS run, event_id AS line, event_id % 40 AS step, event_type AS metric, value FROM events WHERE value IS NOT NULL)
SELECT run, step, metric, round(max_by(value, line), 6) AS value FROM r GROUP BY ALL""")
def metrics_last_per_step(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("run"), F.col("event_id").alias("line"), (F.col("event_id") % 40).alias("step"), F.col("event_type").alias("metric"), "value")
    return last_per_step(rows).withColumn("value", F.round("value", 6))


def _points(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 12).alias("run"), F.col("l_partkey").alias("k")).agg(F.avg("l_quantity").alias("y")).select("run", (F.col("k") * (F.col("run") + 10) / 10.0).alias("x"), "y")


_POINTS = "p AS (SELECT l_suppkey % 12 AS run, l_partkey * (l_suppkey % 12 + 10) / 10.0 AS x, avg(l_quantity) AS y FROM lineitem GROUP BY l_suppkey % 12, l_partkey)"


@query(f"""WITH {_POINTS}, g AS (SELECT x AS gx FROM p WHERE run = 1), l AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY run ORDER BY x))
SELECT run, round(gx, 6) AS x, round(CASE WHEN x1 IS NULL THEN y ELSE y + (y1 - y) * (gx - x) / (x1 - x) END, 6) AS y FROM l JOIN g ON gx >= x AND (gx < x1 OR x1 IS NULL AND gx <= x * 1.02)""")
def interp_compare(spark, sf_dir):
    points = _points(spark, sf_dir)
    return R.interpolated(points, points.where("run = 1")).select("run", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"WITH {_POINTS} SELECT run, round(min(y), 6) AS least, round(max_by(y, x), 6) AS final, round(max(y), 6) AS most FROM p GROUP BY run")
def run_summary(spark, sf_dir):
    return R.summary(_points(spark, sf_dir)).select("run", *(F.round(c, 6).alias(c) for c in ("least", "final", "most")))


_SWEEP = "s AS (SELECT p_size AS budget, log10(1000.0 + p_partkey % 37 * 250) AS x, power(log10(1000.0 + p_partkey % 37 * 250) - 3.4 - p_size * 0.002, 2) + (p_partkey % 7) * 0.01 AS y FROM part)"


def _sweep(spark, sf_dir):
    k = F.col("p_partkey")
    x = F.log10(1000.0 + k % 37 * 250)
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("budget"), x.alias("x"), (F.pow(x - 3.4 - F.col("p_size") * 0.002, F.lit(2)) + (k % 7) * 0.01).alias("y"))


@query(f"""WITH {_SWEEP}, c AS (SELECT budget, avg(x) AS c FROM s GROUP BY 1), z AS (SELECT s.*, c, x - c AS z FROM s JOIN c USING (budget)),
t AS (SELECT budget, any_value(c) AS c, count(*) AS n, count(DISTINCT x) AS d, min_by(x, {{'y': y, 'x': x}}) AS rx, min(y) AS ry, sum(z*z) AS s2, sum(z*z*z) AS s3, sum(z*z*z*z) AS s4, sum(y) AS t0, sum(z*y) AS t1, sum(z*z*y) AS t2 FROM z GROUP BY budget),
a AS (SELECT *, (n*(s2*t2-s3*t1)-s2*s2*t0)/(n*(s2*s4-s3*s3)-s2*s2*s2) AS a FROM t), b AS (SELECT *, (t1-a*s3)/s2 AS b, (t0-a*s2)/n AS c0 FROM a)
SELECT budget, n, round(CASE WHEN d >= 3 AND a > 0 THEN c - b/(2*a) ELSE rx END, 5) AS best_x, round(CASE WHEN d >= 3 AND a > 0 THEN c0 - b*b/(4*a) ELSE ry END, 5) AS best_y FROM b""")
def isoflop_quadratic(spark, sf_dir):
    return R.quadratic(_sweep(spark, sf_dir), "budget").select("budget", "n", F.round("best_x", 5).alias("best_x"), F.round("best_y", 5).alias("best_y"))


@query("WITH z AS (SELECT log10(o_custkey) AS x, log10(s) AS y FROM (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) WHERE o_custkey > 0 AND s > 0) SELECT round(regr_slope(y, x), 6) AS exponent, round(power(10, regr_intercept(y, x)), 2) AS factor, round(regr_r2(y, x), 6) AS r2 FROM z")
def power_law_fit(spark, sf_dir):
    points = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("y")).select(F.col("o_custkey").alias("x"), "y")
    got = R.power_law(points)
    return got.select(F.round("exponent", 6).alias("exponent"), F.round("factor", 2).alias("factor"), F.round("r2", 6).alias("r2"))


@query("SELECT l_returnflag AS flag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def fit_ols_r2(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return R.ols(points, "flag").select("flag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("""WITH v AS (SELECT user_id % 9 AS run, event_id AS step, value, row_number() OVER (PARTITION BY user_id % 9 ORDER BY event_id) AS n FROM events WHERE value IS NOT NULL)
SELECT a.run, a.step, round(sum(b.value * 0.1 * power(0.9, a.n - b.n)) / (1 - power(0.9, a.n)), 6) AS ema FROM v a JOIN v b ON a.run = b.run AND b.n <= a.n GROUP BY a.run, a.step, a.n""")
def ema_debiased(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL").select((F.col("user_id") % 9).alias("run"), F.col("event_id").alias("step"), "value")
    return R.debiased_ema(rows, 0.9).withColumn("ema", F.round("ema", 6))


@query("SELECT i AS step, round(CASE WHEN i < 50 THEN (i + 1) / 50.0 WHEN i <= 600 THEN 1.0 ELSE (1000 - i) / 400.0 * 0.9 + 0.1 END, 6)::DOUBLE AS rate FROM range(0, 1001) r(i)")
def lr_schedule(spark, sf_dir):
    return spark.range(1001).select(F.col("id").alias("step"), F.round(R.learning_rate(F.col("id"), 1000, 0.05, 0.4, 0.1), 6).alias("rate"))


@query("""SELECT run, step FROM (SELECT user_id % 5 AS run, event_id AS step, event_id * 3.7 AS flops, coalesce(lag(event_id * 3.7) OVER (PARTITION BY user_id % 5 ORDER BY event_id), -1.0) AS b FROM events) WHERE floor(flops / 500.0) > floor(b / 500.0)""")
def flops_crossings(spark, sf_dir):
    steps = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("run"), F.col("event_id").alias("step"), (F.col("event_id") * F.lit(3.7)).alias("flops"))
    return R.crossings(steps, 500.0).select("run", "step")


@query("""WITH k(priority, patterns, peak) AS (VALUES (1, ['brass', 'small'], 10.0), (2, ['brass'], 20.0), (3, ['tin', 'large'], 30.0)), n AS (SELECT DISTINCT lower(p_type) AS name FROM part)
SELECT name, coalesce(min_by(peak, priority), 'inf'::DOUBLE)::DOUBLE AS peak FROM n LEFT JOIN k ON len(list_filter(patterns, lambda p : contains(name, p))) = len(patterns) GROUP BY name""")
def device_peak_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.lower("p_type").alias("name")).distinct()
    peaks = spark.createDataFrame([(1, ["brass", "small"], 10.0), (2, ["brass"], 20.0), (3, ["tin", "large"], 30.0)], "priority int, patterns array<string>, peak double")
    return R.device_peak(names, peaks)


@query("""WITH d AS (SELECT i AS depth, (ceil(i * 64 / 128.0) * 128)::BIGINT AS dim FROM range(1, 33) r(i))
SELECT depth, dim, dim // 128 AS heads, (SELECT sum(CASE WHEN ('SSSL')[l % 4 + 1] = 'S' AND l < depth - 1 THEN 512 ELSE 2048 END) FROM range(0, 32) w(l) WHERE l < depth)::BIGINT AS window_sum FROM d""")
def flops_model(spark, sf_dir):
    depth = F.col("depth")
    rows = spark.range(1, 33).select(F.col("id").alias("depth"))
    total = F.aggregate(R.windows(depth, "SSSL", 2048), F.lit(0), lambda a, x: a + x).cast("long")
    return rows.select("depth", *(c.alias(n) for n, c in R.model_shape(depth).items()), total.alias("window_sum"))
