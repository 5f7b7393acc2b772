"""Queries that SQL can't say, over all rows of the smallest tables, against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcorpus import plans
from loomcorpus.functions import bpe
from loomcorpus.operators import evals, loading, runs, tasks
from loomcorpus.operators.articles import HashingEmbedder
from loomcorpus.sources import tables as T

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(spark, name, *columns):
    return [tuple(r) for r in T.table(spark, DATA, name).select(*columns).collect()]


def run(spark, name):
    return plans.QUERIES[name](spark, DATA).collect()


def _best_fit(docs, room, least, batch, crop):
    """Rows of (doc, n): scans of a plain list, the first of the longest that fits, the first of the shortest."""
    feed, held, rows, ended = iter(docs), [], [], False
    while True:
        row, rest = [], room
        while rest:
            while len(held) < least and not ended:
                for _ in range(batch):
                    got = next(feed, None)
                    if got is None:
                        ended = True
                        break
                    held.append(got)
            if ended and (crop or not held):
                break
            fits = [d for d in held if d[1] <= rest]
            if fits:
                best = max(fits, key=lambda d: d[1])
            elif crop:
                best = min(held, key=lambda d: d[1])
            else:
                break
            held.remove(best)
            row.append((best[0], min(rest, best[1])))
            rest -= row[-1][1]
        if (ended and crop) or not row:
            return rows
        rows.append(row)


def _lengths(spark):
    streams = {0: [], 1: []}
    for i, t in sorted(rows_of(spark, "documents", "doc_id", "text")):
        if n := len(WORD.findall(t)):
            streams[(i // 64) % 4 % 2].append((i, n))
    return streams


def test_best_fit_packing(spark):
    packed = {s: _best_fit(d, 512, 32, 16, True) for s, d in _lengths(spark).items()}
    least = min(map(len, packed.values()))
    want = {(row * 2 + s, k, doc, n) for s, p in packed.items() for row, r in enumerate(p[:least]) for k, (doc, n) in enumerate(r)}
    got = run(spark, "bestfit_pack")
    assert {(r["row_id"], r["slot"], r["doc_id"], r["n"]) for r in got} == want and len(got) == len(want)
    length = {i: n for d in _lengths(spark).values() for i, n in d}
    placed = [x for p in packed.values() for r in p for x in r]
    audit = run(spark, "bestfit_audit")[0]
    assert audit["n_rows"] == sum(map(len, packed.values())) and audit["used"] == 1
    assert abs(audit["cropped"] - (1 - sum(n for _, n in placed) / sum(length[i] for i, _ in placed))) < 1e-12


def test_padded_packing_of_conversations(spark):
    size = {}
    for c, t in rows_of(spark, "conversations", "conv_id", "text"):
        size[c] = size.get(c, 0) + len(WORD.findall(t or ""))
    docs = [(c, min(n, 512)) for c, n in sorted(size.items()) if n]
    want = {(row, k, c, n) for row, r in enumerate(_best_fit(docs, 512, 20, 1, False)) for k, (c, n) in enumerate(r)}
    got = run(spark, "sft_pad_pack")
    assert {(r["row"], r["slot"], r["doc_id"], r["n"]) for r in got} == want and sum(r["n"] for r in got) == sum(n for _, n in docs)


def _candidates(spark):
    x = dict(rows_of(spark, "embeddings", "vec_id", "embedding"))
    ids = np.array(sorted(x))
    v = np.array([x[i] for i in ids], np.float64)
    out = {}
    for q in ids[ids % 20 == 0].tolist():
        score = v @ v[ids.tolist().index(q)]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:16]
        out[q // 160, q // 20 % 8] = [(int(ids[j]), int(ids[j] - ids[j] % 30), float(score[j])) for j in order]
    return out


def _stable(lists):
    """Deferred acceptance by whole rounds: every window without a text asks for its next."""
    at, holds = dict.fromkeys(lists, 0), {}
    while True:
        open_ = [w for w in lists if w not in holds.values() and at[w] < len(lists[w])]
        if not open_:
            return {w: lists[w][at[w]] for w in holds.values()}
        for w in open_:
            content, score = lists[w][at[w]][1:]
            other = holds.get(content)
            if other is None or (-score, w) < (-lists[other][at[other]][2], other):
                holds[content] = w
                if other is not None:
                    at[other] += 1
            else:
                at[w] += 1


def test_assignment_and_its_cost(spark):
    candidates = _candidates(spark)
    want, cost, missing, moved = {}, [], 0, 0
    for row in {r for r, _ in candidates}:
        got = _stable({w: c for (r, w), c in candidates.items() if r == row})
        want |= {(row, w): (v, round(s, 6)) for w, (v, _, s) in got.items()}
    for key, c in candidates.items():
        if key in want:
            cost.append(c[0][2] - want[key][1])
            moved += want[key][1] < c[0][2] - 1e-6
        else:
            missing += 1
    assert {(r["row_id"], r["win"]): (r["vec_id"], r["score"]) for r in run(spark, "distinct_assignment")} == want
    stats = run(spark, "displacement_stats")[0]
    assert stats["windows"] == len(candidates) and abs(stats["missing"] - missing / len(candidates)) < 1e-9 and abs(stats["mean_cost"] - np.mean(cost)) < 2e-6


def test_seeded_orders(spark):
    n = len(rows_of(spark, "benchmark", "item_id"))
    order = list(range(n))
    random.Random(42).shuffle(order)
    got = sorted(map(tuple, plans.QUERIES["seeded_orders"](spark, DATA).select("place", "physical", "shuffled").collect()))
    assert got == list(zip(range(n), np.random.default_rng(42).permutation(n).tolist(), order, strict=True))
    pairs = {(r["idx"], r["slot"]): r["other"] for r in run(spark, "few_shot_pairs")}
    assert pairs == {(i, s): j for i in range(n) for s, j in enumerate(random.Random(1234 + i).sample([k for k in range(n) if k != i], 3))}
    first = list(range(n))
    random.Random(1337).shuffle(first)
    assert [r["idx"] for r in sorted(run(spark, "seeded_head"), key=lambda r: r["place"])] == first[:500]


def test_mixture_is_the_seeded_shuffle(spark):
    sizes = [len(set(rows_of(spark, "conversations", "conv_id"))), *[len(rows_of(spark, "benchmark", "item_id"))] * 3, *[len(rows_of(spark, "documents", "doc_id"))] * 4]
    order = [(t, i) for t, n in enumerate(sizes) for i in range(n)]
    random.Random(42).shuffle(order)
    got = sorted((r["place"], r["task"], r["local"]) for r in run(spark, "sft_mixture"))
    assert [x[1:] for x in got] == order


def _train(texts, wanted):
    """Merges one by one, pairs counted anew each time."""
    import regex

    counts = {}
    for t in texts:
        for w in regex.findall(bpe.SPLIT.removeprefix("(?U)"), t):
            key = tuple(bytes([b]) for b in w.encode())
            counts[key] = counts.get(key, 0) + 1
    merges = []
    while len(merges) < wanted:
        pairs = {}
        for w, n in counts.items():
            for p in zip(w, w[1:], strict=False):
                pairs[p] = pairs.get(p, 0) + n
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        merges.append(best)
        after = {}
        for w, n in counts.items():
            out, k = [], 0
            while k < len(w):
                both = w[k : k + 2] == best
                out.append(w[k] + w[k + 1] if both else w[k])
                k += 1 + both
            after[tuple(out)] = after.get(tuple(out), 0) + n
        counts = after
    return merges


@pytest.mark.parametrize("listed", [512, 3])
def test_training_is_that_of_one_merge_at_a_time(spark, monkeypatch, listed):
    monkeypatch.setattr(bpe, "LISTED", listed)
    monkeypatch.setattr(bpe, "WRITTEN", 7)
    monkeypatch.setattr(bpe, "BLOCK", 20)
    texts = ["aaaa aaa abab abba baab", "the thin thing then there", "x1x22x333 don't won't", "aaaaaa", "é è ééé"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert bpe.train(docs, 256 + 9 + 25) == _train(texts, 25)


def test_vocabulary_and_round_trip(spark):
    texts = [t for (t,) in rows_of(spark, "documents", "text")]
    merges = _train(texts, 400 - 256 - 9)
    assert [r["bytes"] for r in sorted(run(spark, "bpe_vocabulary"), key=lambda r: r["token_id"])] == [x.hex().upper() for x in bpe.vocabulary(merges)]
    for r in run(spark, "bpe_encode_stats"):
        assert r["not_restored"] == 0 and r["n_tokens"] < r["n_bytes"] and abs(r["ratio"] - r["n_bytes"] / r["n_tokens"]) < 1e-6
    path = T.shared_folder(spark)
    bpe.save(spark, merges, path)
    assert bpe.load(spark, path) == merges


def test_rendering_has_marks_and_masks(spark):
    part = lambda *p: [{"type": t, "text": x} for t, x in p]
    turns = [(1, 0, "user", "hi", None), (1, 1, "assistant", None, part(("text", "a"), ("python", "1+1"), ("python_output", "2"), ("text", ""))), (2, 0, "user", "é", None)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, parts array<struct<type: string, text: string>>")
    at = {s: 256 + i for i, s in enumerate(bpe.SPECIAL)}
    got = {r["conv_id"]: (r["ids"], r["mask"]) for r in bpe.render(rows, []).collect()}
    s = lambda n: at[f"<|{n}|>"]
    ids = [s("bos"), s("user_start"), *b"hi", s("user_end"), s("assistant_start"), *b"a", s("python_start"), *b"1+1", s("python_end"), s("output_start"), *b"2", s("output_end"), s("assistant_end")]
    assert got[1] == (ids, [0] * 6 + [1] * 6 + [0] * 3 + [1]) and got[2][0] == [s("bos"), s("user_start"), 0xC3, 0xA9, s("user_end")]
    for bad in ([(1, 0, "assistant", "x", None)], [(1, 0, "user", "x", None), (1, 1, "assistant", None, part(("image", "x")))]):
        with pytest.raises(Exception, match="a turn is from|unknown part"):
            bpe.render(spark.createDataFrame(bad, rows.schema), []).collect()
    rendered = run(spark, "conversation_render")
    assert rendered and all(0 <= r["spoken"] < r["n"] <= 2048 for r in rendered)


def test_references_are_of_different_texts(spark):
    items, docs = rows_of(spark, "benchmark", "item_id", "text"), rows_of(spark, "documents", "doc_id", "text")
    first = {}
    for i, t in sorted(docs):
        first.setdefault(t, i)
    ids = np.array(sorted(first.values()))
    text = {i: t for t, i in first.items()}
    embed = lambda ts: HashingEmbedder().embed(ts).astype(np.float32).astype(np.float64)
    x, q = embed([text[i] for i in ids]), embed([t for _, t in items])
    got = {r["physical"]: (r["ids"], r["scores"]) for r in run(spark, "retrieval_refs")}
    for (item, _), v in zip(items, q, strict=True):
        score = x @ v
        assert len(set(got[item][0])) == 8 and np.allclose(got[item][1], np.sort(score)[::-1][:8], atol=1e-9) and np.allclose(got[item][1], [score[ids.tolist().index(i)] for i in got[item][0]], atol=1e-9)


def test_loader_resumes_exactly(spark):
    rows = spark.range(23).select(F.col("id").alias("pos"))
    whole = sorted(map(tuple, loading.loader(rows, 4, 3).select("epoch", "batch_pos", "slot", "pos").collect()))
    assert {e for e, *_ in whole} == {1, 2, 3} and len(whole) == 60
    for epoch, pos in {(e, b) for e, b, *_ in whole}:
        rest = sorted(map(tuple, loading.loader(rows, 4, 3, pos, epoch).select("epoch", "batch_pos", "slot", "pos").collect()))
        assert rest == [x for x in whole if (x[0], x[1]) >= (epoch, pos)]


def test_average_over_many_blocks(spark):
    r = random.Random(3)
    values = [(1, k, r.random()) for k in range(9000)] + [(2, 5, 1.0)]
    points = spark.createDataFrame(values, "run long, step long, value double")
    for beta in (0.5, 0.99, 0.9999):
        got = {(x["run"], x["step"]): x["ema"] for x in runs.debiased_ema(points, beta).collect()}
        m, n = 0.0, 0
        for _, k, v in values[:-1]:
            m, n = m * beta + v * (1 - beta), n + 1
            assert abs(got[1, k] - m / (1 - beta**n)) < 1e-9
        assert abs(got[2, 5] - 1) < 1e-12


def test_keys_letters_and_lists(spark):
    tasks.check_keys(["a"], ["a", "b"])
    for keys in (["train"], ["c"]):
        with pytest.raises(ValueError):
            tasks.check_keys(keys, ["a", "b"])
    with pytest.raises(Exception, match="more than one token"):
        tasks.letter_tokens(spark.createDataFrame([("AB",)], "letter string"), bpe.vocabulary_table(spark, [])).collect()
    with pytest.raises(ValueError):
        bpe.special_id("<|none|>", [])
    assert bpe.special_id("<|bos|>", []) == 256
    with pytest.raises(Exception, match="isn't a prefix"):
        spark.range(1).select(evals.continued_span(F.array(F.lit(1)), F.array(F.lit(2), F.lit(3)))).collect()
    assert T.parse_list("a:\n- x: 1\n  y: [2, 3]\n  z: \"q # r\"") == [{"x": 1, "y": [2, 3], "z": "q # r"}]
    assert loading.shifted and tasks.bounds
