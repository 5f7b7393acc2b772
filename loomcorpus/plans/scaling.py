"""Queries of scaling analysis and of inference cost; parts, lines and events stand for runs, parameters and steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cost
from ..operators import runs as R
from ..operators.runs import windows as layer_windows
from ..sources.tables import table
from .registry import query

_RUNS = "SELECT p_partkey AS run, p_size AS budget, p_partkey % 50 * 1000 + 100 AS transformer, p_partkey % 7 * 10 AS lm_head, p_partkey * 20 AS tokens, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN -1.0 ELSE 0.5 + (p_partkey * 37 % 1000) / 1000.0 END AS val_bpb FROM part"


def _runs(spark, sf_dir):
    k = F.col("p_partkey")
    loss = F.when(k % 11 == 0, None).when(k % 13 == 0, -1.0).otherwise((k * 37 % 1000) / 1000 + 0.5)
    return table(spark, sf_dir, "part").select(k.alias("run"), F.col("p_size").alias("budget"), (k % 50 * 1000 + 100).alias("transformer"), (k % 7 * 10).alias("lm_head"), (k * 20).alias("tokens"), loss.alias("val_bpb"))


@query(f"SELECT run, transformer + lm_head AS params, round(tokens / (transformer + lm_head), 6) AS ratio FROM ({_RUNS}) WHERE val_bpb > 0")
def effective_params(spark, sf_dir):
    return R.effective(R.valid(_runs(spark, sf_dir))).select("run", "params", F.round("ratio", 6).alias("ratio"))


@query(f"SELECT budget, arg_min(run, run) AS run, arg_min(val_bpb, run) FILTER (WHERE val_bpb IS NOT NULL)::DOUBLE AS val_bpb, arg_min(odd, run) FILTER (WHERE odd IS NOT NULL) AS odd FROM (SELECT *, CASE WHEN run % 2 = 1 THEN run * 3 END AS odd FROM ({_RUNS})) GROUP BY budget")
def first_rows(spark, sf_dir):
    rows = _runs(spark, sf_dir).select("budget", "run", "val_bpb", F.when(F.col("run") % 2 == 1, F.col("run") * 3).alias("odd"))
    return R.first_by(rows, "budget", "run")


@query(f"SELECT DISTINCT budget FROM ({_RUNS}) WHERE val_bpb > 0 ORDER BY budget")
def distinct_budgets(spark, sf_dir):
    return R.valid(_runs(spark, sf_dir)).select("budget").distinct().orderBy("budget")


@query(f"SELECT budget, run, val_bpb::DOUBLE AS val_bpb FROM ({_RUNS}) WHERE val_bpb > 0 QUALIFY row_number() OVER (PARTITION BY budget ORDER BY val_bpb, run) = 1")
def least_rows(spark, sf_dir):
    return R.least_row(R.valid(_runs(spark, sf_dir)).select("budget", "run", "val_bpb"), "budget", "val_bpb", "run")


@query(f"SELECT budget, round(avg(tokens / (transformer + lm_head)), 6) AS mean, round(stddev_samp(tokens / (transformer + lm_head)), 5) AS deviation, count(*) AS n FROM ({_RUNS}) WHERE val_bpb > 0 GROUP BY budget")
def ratio_spread(spark, sf_dir):
    got = R.spread(R.effective(R.valid(_runs(spark, sf_dir))), "ratio", "budget")
    return got.select("budget", F.round("mean", 6).alias("mean"), F.round("deviation", 5).alias("deviation"), "n")


@query("SELECT lang, round(avg(m), 6) AS mean, count(*) AS groups FROM (SELECT lang, source, avg(n_chars) AS m FROM documents GROUP BY ALL) GROUP BY lang")
def mean_of_means(spark, sf_dir):
    return R.mean_of_means(table(spark, sf_dir, "documents"), "n_chars", "source", "lang").withColumn("mean", F.round("mean", 6))


@query("SELECT coalesce(p_brand, 'total') AS p_brand, sum(p_size)::BIGINT AS total FROM part GROUP BY ROLLUP (p_brand)")
def parameter_groups(spark, sf_dir):
    return R.totals_by(table(spark, sf_dir, "part"), "p_brand", "p_size")


@query("SELECT p_type AS dtype, sum(p_size)::BIGINT AS numbers, sum(p_size * CASE WHEN p_type LIKE '%SMALL%' THEN 2 ELSE 4 END)::BIGINT AS bytes FROM part GROUP BY 1")
def dtype_histogram(spark, sf_dir):
    size = F.when(F.col("p_type").contains("SMALL"), 2).otherwise(4)
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("dtype")).agg(F.sum("p_size").alias("numbers"), F.sum(F.col("p_size") * size).alias("bytes"))


_STEPS = "SELECT user_id % 7 AS batch, (event_id * 7919 % 1009 + 1) / 1000.0 AS step FROM events"


@query(f"""WITH m AS (SELECT batch, count(*) OVER (PARTITION BY batch) AS n, step AS median, row_number() OVER (PARTITION BY batch ORDER BY step) - 1 AS i FROM ({_STEPS}))
SELECT batch, n, median::DOUBLE AS median, round(100 * (1e6 + batch * 5e4) / median / 1e9, 8) AS mbu, round(100 * (batch * 2e6) / median / 1e10, 8) AS mfu FROM m WHERE i = n // 2""")
def step_times(spark, sf_dir):
    steps = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("batch"), ((F.col("event_id") * 7919 % 1009 + 1) / 1000).alias("step"))
    got = R.upper_median(steps, "batch", "step")
    mbu, mfu = R.utilisation(F.col("median"), F.col("batch"), F.lit(1e6), F.lit(5e4), F.lit(2e6), F.lit(1e9), F.lit(1e10))
    return got.select("batch", "n", "median", F.round(mbu, 8).alias("mbu"), F.round(mfu, 8).alias("mfu"))


@query("SELECT i AS depth, round(3e9 / (i * 1e6 + i * 2e3), 6) AS ceiling, floor((8e9 - i * 1e6) / (i * 512 * 2048))::BIGINT AS most_rows FROM range(1, 40) r(i)")
def roofline(spark, sf_dir):
    d = F.col("id")
    rate, most = R.ceilings(F.lit(8e9), d * 1e6, d * 512, F.lit(2048), d * 2e3, F.lit(3e9))
    return spark.range(1, 40).select(d.alias("depth"), F.round(rate, 6).alias("ceiling"), most.alias("most_rows"))


_WINDOW = "CASE WHEN ('SSSL')[l % 4 + 1] = 'S' AND l < depth - 1 THEN 512 ELSE 2048 END"


@query(f"""WITH c AS (SELECT i AS depth, t AS tokens, i * 64 AS width FROM range(4, 13) r(i), (VALUES (100), (900), (3000)) x(t)),
s AS (SELECT depth, tokens, width, (SELECT sum(least({_WINDOW}, tokens) * (least({_WINDOW}, tokens) + 1) / 2 + (tokens - least({_WINDOW}, tokens)) * least({_WINDOW}, tokens)) FROM range(0, 16) w(l) WHERE l < depth) AS seen,
(SELECT sum(least({_WINDOW}, tokens)) FROM range(0, 16) w(l) WHERE l < depth) AS back FROM c)
SELECT depth, tokens, round(2 * (depth * 1000000 - 30000) * tokens + 2 * 30000 * 1024 + 4.0 * width * seen + 4.0 * width * 1024 * (3 * tokens + 128 * 2), 1)::DOUBLE AS prefill, (depth * 2 * 256 * 2)::BIGINT AS kv_bytes, (back * 2 * 256 * 2)::BIGINT AS kv_read FROM s""")
def prefill_and_cache(spark, sf_dir):
    depth = F.col("depth")
    rows = spark.range(4, 13).select(F.col("id").alias("depth")).withColumn("tokens", F.explode(F.array(F.lit(100), F.lit(900), F.lit(3000))))
    fixed = {"ref": 30_000, "refs": 1024, "ref_len": 128, "cross": 3, "enc_layers": 2}
    rows = rows.select("*", (depth * 1_000_000).alias("matmul"), (depth * 64).alias("width"), layer_windows(depth, "SSSL", 2048).alias("windows"), *(F.lit(v).alias(k) for k, v in fixed.items()))
    return rows.select("depth", "tokens", F.round(cost.prefill_flops(F.col("tokens")), 1).alias("prefill"), cost.kv_bytes(depth, F.lit(256)).cast("long").alias("kv_bytes"), cost.kv_read(F.col("tokens"), F.lit(256)).cast("long").alias("kv_read"))


@query("""WITH s AS (SELECT l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem), t AS (SELECT sum(x * x) AS xx, sum(x) AS sx, count(*)::DOUBLE AS n, sum(x * y) AS xy, sum(y) AS sy FROM s),
w AS (SELECT a, (xy - sx * sy / n) / (xx + a - sx * sx / n) AS slope, sx, sy, n FROM t, (VALUES (0.0::DOUBLE), (0.01::DOUBLE), (1000.0::DOUBLE)) g(a))
SELECT a AS alpha, round(slope, 4) AS slope, round((sy - slope * sx) / n, 2) AS intercept FROM w""")
def ridge_grid(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    got = R.ridge_grid(rows, ["x"], "y", [0.0, 0.01, 1000.0])
    return got.select("alpha", F.round(F.col("weights")[0], 4).alias("slope"), F.round(F.col("weights")[1], 2).alias("intercept"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS place FROM part")
def sorted_params(spark, sf_dir):
    """A full order, its places by parts of one size each, which are counted first."""
    from ..operators.corpus import running_sum

    rows = table(spark, sf_dir, "part").select("p_partkey", (-F.col("p_size")).alias("_part")).withColumn("_one", F.lit(1))
    return running_sum(rows, "_one", "place", "_part", ("p_partkey",)).select("p_partkey", "place").orderBy("place")


@query(r"""WITH t AS (SELECT lang, sum(octet_length(encode(text)))::BIGINT AS n_bytes, sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))::BIGINT AS words FROM documents GROUP BY lang)
SELECT lang, n_bytes, n_bytes AS base_tokens, words AS own_tokens, round(n_bytes / words, 6) AS own_ratio, round((n_bytes - words) / n_bytes * 100, 6) AS less_percent, CASE WHEN words < n_bytes THEN 'own' WHEN words > n_bytes THEN 'base' ELSE 'tie' END AS better FROM t""")
def compression_compare(spark, sf_dir):
    """Two tokenizers' counts of the same texts: bytes as tokens against words as tokens."""
    from ..functions.bpe import compared

    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select("lang", F.octet_length(text).alias("n_bytes"), F.octet_length(text).alias("base"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("own"))
    return compared(rows, "lang")
