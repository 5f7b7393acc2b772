"""Operators that SQL can't express, against plain Python."""

import functools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcorpus import plans
from loomcorpus.functions import bpe, sandbox
from loomcorpus.operators import corpus, metrics, packing, retrieval, runs
from loomcorpus.streaming import documents


def _pack_plain(docs, room, least, batch):
    """Best fit by scanning a list."""
    feed, held, out, row, ended = iter(docs), [], [], 0, False
    while True:
        rest, placed = room, []
        while rest:
            while len(held) < least and not ended:
                for _ in range(batch):
                    got = next(feed, None)
                    if got is None:
                        ended = True
                        break
                    held.append(got)
            if ended:
                return out
            fits = [i for i, (_, n) in enumerate(held) if n <= rest]
            if fits:
                at = max(fits, key=lambda i: (held[i][1], -i))
                doc, n = held.pop(at)
            else:
                at = min(range(len(held)), key=lambda i: (held[i][1], i))
                doc, n = held.pop(at)[0], rest
            placed.append((row, len(placed), doc, n))
            rest -= n
        out += placed
        row += 1


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_equals_scan(seed):
    r = random.Random(seed)
    docs = [(i, r.randint(1, 60)) for i in range(300)]
    assert packing._pack(docs, 40, 12, 5, True) == _pack_plain(docs, 40, 12, 5)


def test_rows_are_full(spark):
    docs = spark.createDataFrame([(i % 2, i, i, 1 + i * 7 % 50) for i in range(200)], "stream long, place long, doc_id long, n long")
    placed = packing.pack(docs, 40, 8, 4)
    assert {r["u"] for r in placed.groupBy("stream", "row").agg(F.sum("n").alias("u")).collect()} == {40}
    tokens = docs.select("doc_id", F.array_repeat(F.col("doc_id").cast("int"), F.col("n").cast("int")).alias("tokens"))
    assert {len(r["tokens"]) for r in packing.rows_of(tokens, placed).collect()} == {40}
    ids = [r["row_id"] for r in packing.interleave(placed).select("row_id").distinct().collect()]
    assert sorted(ids) == list(range(len(ids)))
    padded = packing.pack(docs, 40, 8, 4, crop=False)
    assert padded.agg(F.sum("n")).first()[0] == docs.agg(F.sum(F.least("n", F.lit(40)))).first()[0]
    assert {len(r["tokens"]) for r in packing.rows_of(tokens, padded, -1, 40).collect()} == {40}


def test_assignment(spark):
    r = random.Random(1)
    rows, want = [], {}
    for row in range(40):
        lists = {}
        for w in range(6):
            cand = r.sample(range(8), 4)
            scores = sorted((r.randint(1, 5) / 10 for _ in cand), reverse=True)
            lists[w] = list(zip(cand, scores, strict=True))
            rows += [(row, w, i + 1, 100 * w + c, c, s) for i, (c, s) in enumerate(lists[w])]
        at = dict.fromkeys(lists, 0)
        while True:  # the lower score of any conflict moves on
            now = {w: lists[w][at[w]] for w in lists if at[w] < len(lists[w])}
            clash = next(((a, b) for a in now for b in now if a < b and now[a][0] == now[b][0]), None)
            if clash is None:
                break
            a, b = clash
            at[b if now[a][1] >= now[b][1] else a] += 1
        want |= {(row, w): 100 * w + c for w, (c, _) in now.items()}
    got = retrieval.assign(spark.createDataFrame(rows, "row_id long, win long, rank int, vec_id long, content_id long, score double"))
    assert {(x["row_id"], x["win"]): x["vec_id"] for x in got.collect()} == want


def test_shard_search_equals_its_sql_where_the_best_hits_repeat_a_text(spark, tmp_path):
    # Texts of three vectors each, near each other: the four best hits of a query hold the same text more than once.
    r = np.random.default_rng(5)
    of_text = np.repeat(r.normal(size=(70, 8)), 3, 0)
    x = (of_text + 0.05 * r.normal(size=of_text.shape)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = plans.QUERIES["shard_search_merge"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({plans.SQL['shard_search_merge']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and 11 <= len(want) < 44


def test_shard_search_keeps_the_hits_of_a_query_whose_id_is_repeated(spark, tmp_path):
    # The query 20 stands four times: sixteen rows of its shard are its own, and its best hit is in that shard too.
    x = np.random.default_rng(5).normal(size=(210, 8))
    x[24] = x[20] + 0.01 * x[24]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in [*range(210), 20, 20, 20]]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = plans.QUERIES["shard_search_merge"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({plans.SQL['shard_search_merge']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert [tuple(r) for r in got.where("query_id = 20").select("rank", "vec_id").collect()] == [(1, 24)]


def test_own_rows_take_no_place_among_a_blocks_best(spark):
    rows = spark.createDataFrame([(7, 0, [9.0])] * 30 + [(i, 0, [float(i)]) for i in range(7)], "vec_id long, shard long, embedding array<double>")
    query = spark.createDataFrame([(7, [1.0])], "query_id long, embedding array<double>")
    assert sorted(r["vec_id"] for r in retrieval.shard_hits(query, rows, 3, but_own=True).collect()) == [4, 5, 6]
    assert [r["vec_id"] for r in retrieval.shard_hits(query, rows, 3).collect()] == [7, 7, 7]
    assert not retrieval.shard_hits(query, rows.where("vec_id = 7"), 3, but_own=True).collect()


def test_equal_vectors_tie_and_scores_add_up_in_order(spark):
    r = np.random.default_rng(3)
    x = np.repeat(r.normal(size=(40, 67)), 9, 0).astype(np.float32)[r.permutation(360)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    queries = rows.where("vec_id < 7").withColumnRenamed("vec_id", "query_id")
    got = sorted(map(tuple, retrieval.top_k(queries, rows, 13).collect()))
    want = []
    for q in range(7):
        score = [functools.reduce(lambda s, ab: s + ab[0] * ab[1], zip(x[q].astype(float).tolist(), v.astype(float).tolist(), strict=True), 0.0) for v in x]
        want += [(q, n + 1, i, score[i]) for n, i in enumerate(sorted(range(360), key=lambda i: (-score[i], i))[:13])]
    assert got == want


def test_interpolation_reads_no_window_anew_for_each_row(spark):
    r = np.random.default_rng(8)
    at = {run: np.sort(r.choice(500, 40 + run, replace=False)).astype(float) for run in range(3)}
    y = {run: r.normal(size=len(x)) for run, x in at.items()}
    points = spark.createDataFrame([(run, float(a), float(b)) for run in at for a, b in zip(at[run], y[run], strict=True)], "run int, x double, y double")
    got = runs.interpolated(points, points.where("run = 1"))
    want = {(run, x): float(np.interp(x, at[run], y[run])) for run in at for x in at[1].tolist() if at[run][0] <= x <= at[run][-1] * 1.02}
    assert {(g["run"], g["x"]): g["y"] for g in got.collect()} == pytest.approx(want)
    # A frame that ends with the partition takes a pass over the rest of it for each row.
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_top_k_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, r.integers(-2, 3, 4).astype(float).tolist()) for i in range(80)], "vec_id long, embedding array<double>")
    queries = rows.where("vec_id < 9").withColumnRenamed("vec_id", "query_id")
    key = lambda df: sorted(map(tuple, df.collect()))
    whole = key(retrieval.top_k(queries, rows, 5))
    monkeypatch.setattr(retrieval, "QUERIES", 2)
    monkeypatch.setattr(retrieval, "VECTORS", 11)
    assert whole == key(retrieval.top_k(queries, rows, 5))
    x = np.array([r["embedding"] for r in rows.orderBy("vec_id").collect()])
    for q in range(9):
        score = x @ x[q]
        order = np.lexsort((np.arange(80), -score))
        assert [v for i, _, v, _ in whole if i == q] == order[:5].tolist()
        assert [t["vec_id"] for t in retrieval.top_k(queries, rows, 4, but_own=True).where(F.col("query_id") == q).orderBy("rank").collect()] == [i for i in order.tolist() if i != q][:4]


def test_bpe_round_trip(spark):
    texts = ["abab abab 12345 don't", "", "Größe 漢字 🙂", None, "<|bos|> x", "\n\n  y"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    merges = bpe.train(docs, 280)
    assert len(bpe.vocabulary(merges)) <= 280
    got = docs.select("text", bpe.decode(bpe.encode(F.col("text"), merges), merges).alias("back")).collect()
    assert all(r["text"] == r["back"] for r in got)


def test_render(spark):
    turns = spark.createDataFrame([(1, 0, "user", "ab"), (1, 1, "assistant", "c")], "conv_id long, turn long, role string, text string")
    row = bpe.render(turns, []).first()
    assert row["ids"] == [256, 257, 97, 98, 258, 259, 99, 260]
    assert row["mask"] == [0, 0, 0, 0, 0, 0, 1, 1]
    assert bpe.for_completion(turns, []).first()["ids"] == [256, 257, 97, 98, 258, 259]


def test_chunk_starts(spark):
    def plain(n, c, o):
        if n < c:
            return []
        k = round((n - c) / (c - o)) + 1
        return [0] if k == 1 else [i * (n - c) // (k - 1) for i in range(k)]

    rows = spark.range(500).select("id", corpus.chunk_starts(F.col("id"), 100, 20).alias("s")).collect()
    assert all(r["s"] == plain(r["id"], 100, 20) for r in rows)


def test_ridge_and_shapes(spark):
    x = np.random.default_rng(3).normal(size=(50, 2))
    y = x @ [1.0, -2.0] + 3
    rows = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, y double")
    assert np.allclose(runs.ridge(rows, ["a", "b"], "y", 0.0), [1, -2, 3])
    assert abs(runs.ridge(rows, ["a", "b"], "y", 1e6)[:2]).max() < 1e-3


def test_nothing_scored_is_infinite(spark):
    rows = spark.createDataFrame([(1.0, 0, 1), (2.0, 3, -1)], "nats double, n_bytes int, target int")
    assert metrics.bits_per_byte(rows).first()["bpb"] == float("inf")


def test_sandbox():
    assert sandbox.calculate("1,000*(2+3)") == "5000"
    assert sandbox.calculate("'abab'.count('ab')") == "2"
    assert sandbox.calculate("2**9") is None and sandbox.calculate("__import__('os')") is None and sandbox.calculate(None) is None
    assert sandbox.execute("print(1)")["stdout"] == "1\n"
    assert sandbox.execute("while True: pass", seconds=1)["timeout"]
    assert sandbox.execute("x = 'a' * (1 << 31)")["memory_exceeded"]
    assert sandbox.execute("1/0")["error"].startswith("ZeroDivisionError")
    assert sandbox.calculate("7//2") == "3" and sandbox.calculate("'a,b'.count('ab')") == "1"
    assert all(sandbox.calculate(x) is None for x in ("7%2", "0x10", "1e5", "'a'.count('a', 1)", "'a'.upper()", "[].count(1)", "9" * 10**6 + "*" + "9" * 10**6))
    assert sandbox.execute("import os, shutil, subprocess\nassert not any((os.kill, os.remove, shutil.rmtree, subprocess.Popen))")["success"]
    assert sandbox.execute("import psutil")["error"].startswith("ModuleNotFoundError") and sandbox.execute("exit(0)")["error"].startswith("TypeError")
    assert sandbox.execute("raise SystemExit(3)")["error"] == "Execution failed" and sandbox.execute("x = [0] * (200 << 20)")["memory_exceeded"]


def test_stream_of_rows(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(0, 10 * k + i, 3 + i) for i in range(5)], "stream long, doc_id long, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = documents.stream(spark, str(tmp_path / "in"), "stream long, doc_id long, n long")
    q = documents.cut_rows(rows, 10).writeStream.format("memory").queryName("cut").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("cut").count() == 75 // 10


def test_sinks_and_stores(spark, tmp_path):
    from loomcorpus import sinks

    rows = spark.range(5).select(F.col("id").alias("run"), (F.col("id") * 2).alias("x"))
    for _ in range(2):
        sinks.results(rows, f"{tmp_path}/results", ["run"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/results").count() == 5
    sinks.store(spark, f"{tmp_path}/store", {"k": 1}, part=rows)
    config, part = sinks.open_store(spark, f"{tmp_path}/store")
    assert config == {"k": 1} and part("part").count() == 5
    rows.write.parquet(f"{tmp_path}/half/part")
    with pytest.raises(ValueError):
        sinks.open_store(spark, f"{tmp_path}/half")


def test_legacy_folder_and_baselines(spark, tmp_path):
    from loomcorpus.operators import evals
    from loomcorpus.sources import tables

    spark.range(6).repartition(3).write.parquet(f"{tmp_path}/old")
    got = tables.files_in_order(spark, f"{tmp_path}/new", legacy=f"{tmp_path}/old")
    assert got.count() == 6 and {r["shard"] for r in got.select("shard").collect()} == {0, 1, 2}
    scored = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "task string, accuracy double")
    known = spark.createDataFrame([("a", 25.0)], "task string, baseline double")
    with pytest.raises(Exception, match="no baseline: b"):
        metrics.with_baseline(scored, known).collect()
    assert {r["task"]: r["baseline"] for r in metrics.with_baseline(scored, known, 0.0).collect()} == {"a": 25.0, "b": 0.0}
    refs = spark.createDataFrame([(0, [4], [0.5])], "physical long, ids array<long>, scores array<double>")
    assert [r["ids"] for r in evals.attach_refs(spark.range(2).withColumnRenamed("id", "physical"), refs).orderBy("physical").collect()] == [[4], None]


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    def shard(k):
        spark.range(10 * k, 10 * k + 10).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}.parquet")

    schema = "doc_id long, text string"
    where = {"checkpointLocation": f"{tmp_path}/check"}

    def go():
        rows = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        rows.writeStream.options(**where).format("parquet").option("path", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()

    shard(0)
    shard(1)
    go()
    shard(2)
    go()
    assert sorted(r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(30))
    # Running totals don't depend on where the stream was cut.
    whole = documents.totals(spark.read.parquet(f"{tmp_path}/out").withColumn("k", F.col("doc_id") % 2), "k").collect()
    assert {(r["k"], r["docs"], r["chars"]) for r in whole} == {(0, 15, 30), (1, 15, 30)}


def test_metrics_are_appended(spark, tmp_path):
    for k in range(2):
        spark.range(3 * k, 3 * k + 3).select(F.col("id").alias("step"), (F.col("id") / 2).alias("value")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}.parquet")
        rows = spark.readStream.schema("step long, value double").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        documents.appended(rows, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted(r["step"] for r in spark.read.json(f"{tmp_path}/out").collect()) == list(range(6))
