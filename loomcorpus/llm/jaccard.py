"""N-gram Jaccard join by vertical partitioning, and the components of its links.

The global order of all shingles is cut into fragments. Every text sends each fragment its part of its
set; a fragment counts, for its shingles alone, in how many sets each stands, and the counts are summed a set:

1. A shingle that stands in one set only can't be shared. A set that shares fewer than PERCENT of its
   shingles with any others has no link at all, and drops out, by counts alone.
2. What is left is ordered by frequency. Two sets that link have a shingle in common among the rarest of
   each (the prefix filter), so sets meet by these shingles only, rare ones first: a line that all the corpus shares
   brings nobody together. What can still follow a shingle in either order bounds their overlap (the positional
   filter), and pairs that can't reach PERCENT are never made.
3. Candidate pairs are counted fragment by fragment, each partial overlap on its own, and summed per pair.

Groups of near copies are never expanded into pairs. The sets that meet at a shingle are first compared with
one of them, the one with the fewest shingles of its own, and what links falls together; this is done up to PIVOTS
times, with another one each time, while comparing all would make more pairs than there are places in the sets' prefixes. Only sets that meet at a shingle and are still apart are then compared in
full, all of them, so no link between different components is missed. Sets of equal shingles are one set from the start.

Sets and shingles go by 64-bit hashes: among 10**9 different sets, two collide with a chance of 3 %.

Null, empty and blank texts have no set: n_shingles 0, linked with nothing, alone in their component. Repeated rows
each come out. A null doc_id is carried along; a component whose ids are all null has a null id. Only doc_id
and text are read. An empty table gives no rows. A text may be as long as one row can be: what a task holds is a slice of texts
(or one text) and its share of the shingles, of which there are as many as the bytes of all texts ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph
from .words import Words, mix

WORDS, PERCENT = 5, 80
#: Rounds of comparing with one set only; fragments that a pair's overlap is counted in.
PIVOTS, PARTS = 2, 4
#: Bytes of text that are cut up together (a worker's arrays take some 20 times these); bytes of text whose shingles a fragment holds, about.
SLICE, FRAGMENT = 2 << 20, 24 << 20


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    """Numbers below n in the order of x, a range of x each."""
    return ((x >> np.uint64(33)) * np.uint64(n) >> np.uint64(31)).astype(np.int64)


def sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(size of each text's set, hash of the set or 0 for none, text of each shingle, its hash)."""
    doc, hashes = Words([t.lower() for t in texts]).shingles(words)
    sizes = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    node = np.zeros(len(texts), np.uint64)
    if len(doc):
        some = np.flatnonzero(sizes)
        first = np.cumsum(sizes) - sizes
        node[some] = np.maximum(1, mix(np.add.reduceat(mix(hashes), first[some]) + sizes[some].astype(np.uint64)))
    return sizes, node, doc, hashes


_OUT = "part int, kind int, nodes binary, sizes binary, counts binary, hashes binary, times binary, ids binary, known binary, marks binary"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_SCHEMA = pa.schema([("part", pa.int32()), ("kind", pa.int32()), *((n, pa.binary()) for n in _NAMES[2:])])


def _row(part: int, kind: int, **arrays: np.ndarray) -> dict:
    return {"part": part, "kind": kind} | {n: arrays[n].tobytes() if n in arrays else b"" for n in _NAMES[2:]}


def _split(fragments: int, words: int):
    """Texts to segments: a row for each fragment and run of texts (kind 0), and one of the texts themselves (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            at = 0
            for ids, texts in common.byte_slices(batch, SLICE):
                sizes, node, doc, hashes = sets(texts, words)
                known = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
                numbers = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                marks = batch.column(2).slice(at, len(texts)).to_numpy(zero_copy_only=False)
                turn, at = turn + 1, at + len(texts)
                rows = [_row((turn * 7919 + int(numbers[0])) % fragments, 1, nodes=node, sizes=sizes, ids=numbers, known=known, marks=marks)]
                once = np.zeros(len(node), bool)
                once[np.unique(node, return_index=True)[1]] = True
                keep = once[doc]
                doc, hashes = doc[keep], hashes[keep]
                part = _spread(hashes, fragments)
                order = np.argsort(part, kind="stable")
                doc, hashes, part = doc[order], hashes[order], part[order]
                edge = np.searchsorted(part, np.arange(fragments + 1))
                for p in np.flatnonzero(np.diff(edge)).tolist():
                    own = doc[edge[p] : edge[p + 1]]
                    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                    mine = own[first]
                    rows.append(_row(p, 0, nodes=node[mine], sizes=sizes[mine].astype(np.uint32), counts=np.diff(np.append(first, len(own))).astype(np.uint32), hashes=hashes[edge[p] : edge[p + 1]]))
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> tuple[list[dict], dict[int, list[list[bytes]]]]:
    """Rows of kind 1, and by part the columns of the others."""
    passed, by = [], {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 1:
                passed.append(row)
            else:
                by.setdefault(row["part"], [[] for _ in range(5)])
                for held, name in zip(by[row["part"]], ("nodes", "sizes", "counts", "hashes", "times"), strict=True):
                    held.append(row[name])
    return passed, by


def _count(fragments: int):
    """Of each fragment: in how many sets each shingle stands; what two or more share goes back to its sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed, by = _gather(batches)
        if passed:
            yield pa.RecordBatch.from_pylist(passed, _SCHEMA)
        for part in list(by):
            nodes, sizes, counts, hashes, _ = (np.frombuffer(b"".join(x), k) for x, k in zip(by.pop(part), ("<u8", "<u4", "<u4", "<u8", "u1"), strict=True))
            once = np.zeros(len(nodes), bool)
            once[np.unique(nodes, return_index=True)[1]] = True
            hashes = hashes[np.repeat(once, counts)]
            nodes, sizes, counts = nodes[once], sizes[once], counts[once]
            owner = np.repeat(np.arange(len(nodes)), counts)
            order = np.argsort(hashes)
            hashes, owner = hashes[order], owner[order]
            first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
            times = np.diff(np.append(first, len(hashes)))
            shared = np.repeat(times > 1, times)
            owner, hashes, times = owner[shared], hashes[shared], np.repeat(times, times)[shared].astype(np.uint32)
            # Back to the sets, by ranges of their own hashes.
            bucket = _spread(mix(nodes), fragments)
            order = np.lexsort((owner, bucket[owner]))
            owner, hashes, times = owner[order], hashes[order], times[order]
            edge = np.searchsorted(bucket[owner], np.arange(fragments + 1))
            rows = []
            for p in np.flatnonzero(np.diff(edge)).tolist():
                own = owner[edge[p] : edge[p + 1]]
                first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                mine = own[first]
                rows.append(_row(p, 0, nodes=nodes[mine], sizes=sizes[mine], counts=np.diff(np.append(first, len(own))).astype(np.uint32), hashes=hashes[edge[p] : edge[p + 1]], times=times[edge[p] : edge[p + 1]]))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return run


_KEPT = "doc_id long, mark long, node long, n long, own long, part int, tokens binary, prefix array<long>"


def _survivors(percent: int):
    """Sums the counts of each set; of those that can link, a row a part with the shared shingles, the first with
    the prefix; own: how many shingles no other set has. The texts' rows come out as (doc_id, mark, node, n), part -1."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("part", pa.int32()), ("tokens", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed, by = _gather(batches)
        for row in passed:
            node, size, ids, marks = (np.frombuffer(row[k], "<i8") for k in ("nodes", "sizes", "ids", "marks"))
            n, known = len(node), np.frombuffer(row["known"], np.uint8)
            yield pa.record_batch(
                [pa.array(ids, mask=known == 0), pa.array(marks), pa.array(node, mask=node == 0), pa.array(size), pa.nulls(n, pa.int64()), pa.array(np.full(n, -1, np.int32)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int64()))], schema=schema
            )
        for part in list(by):
            nodes, sizes, counts, hashes, times = (np.frombuffer(b"".join(x), k) for x, k in zip(by.pop(part), ("<u8", "<u4", "<u4", "<u8", "<u4"), strict=True))
            all_nodes, at = np.unique(nodes, return_inverse=True)
            shared = np.bincount(at, counts, len(all_nodes)).astype(np.int64)
            size = np.zeros(len(all_nodes), np.int64)
            size[at] = sizes
            alive = 100 * shared >= percent * size
            owner = np.repeat(at, counts)
            keep = alive[owner]
            owner, hashes, times = owner[keep], hashes[keep], times[keep]
            order = np.lexsort((hashes, times, owner))
            owner, hashes = owner[order], hashes[order]
            edge = np.searchsorted(owner, np.arange(len(all_nodes) + 1))
            rows = []
            for i in np.flatnonzero(alive).tolist():
                own, n = hashes[edge[i] : edge[i + 1]], int(size[i])
                first = n - -(-percent * n // 100) + 1 - (n - len(own))
                rank = np.sort(own)
                cut = np.searchsorted(rank, [np.uint64(k << 62) for k in range(PARTS)][1:])
                for k, piece in enumerate(np.split(rank, cut)):
                    rows.append({"doc_id": None, "mark": None, "node": int(all_nodes[i].astype(np.int64)), "n": n, "own": n - len(own), "part": k, "tokens": piece.tobytes(), "prefix": own[: max(0, first)].view(np.int64).tolist() if k == 0 else None})
                if len(rows) >= 4000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _overlap(a, b):
    import pandas as pd

    return pd.Series([len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), True)) for x, y in zip(a, b, strict=True)], dtype="int64")


def verified(pairs: DataFrame, segments: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that link: partial overlaps by fragment, summed per pair, against the sizes. A set of many pairs, as one that
    a group is compared with, is dealt over several tasks."""
    left = segments.select(F.col("node").alias("a"), F.col("n").alias("na"), "part", F.col("tokens").alias("ta"))
    right = segments.select(F.col("node").alias("b"), F.col("n").alias("nb"), "part", F.col("tokens").alias("tb"))
    parts = pairs.select("a", "b", F.explode(F.array(*map(F.lit, range(PARTS)))).alias("part")).select("a", "b", F.struct("a", "part").alias("_a"), F.struct("b", "part").alias("_b"))
    met = common.join_split(parts, left.select(F.struct("a", "part").alias("_a"), "na", "ta"), "_a", "b").drop("_a")
    met = common.join_split(met, right.select(F.struct("b", "part").alias("_b"), "nb", "tb"), "_b", "a", counted=parts)
    common.hold_batches(pairs.sparkSession)
    counted = met.select("a", "b", "na", "nb", F.pandas_udf(_overlap, "long")("ta", "tb").alias("both"))
    total = counted.groupBy("a", "b").agg(F.sum("both").alias("both"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return total.where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _reach(percent: int):
    """What stands from a shared shingle on, in the order of either set (pos of n, and at of m), is enough for them to link."""
    least = F.lit(percent) * (F.col("n") + F.col("m"))
    return (F.lit(100 + percent) * (F.col("n") - F.col("pos")) >= least) & (F.lit(100 + percent) * (F.col("m") - F.col("at")) >= least)


def _pair(x: str, y: str) -> tuple:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, label (the same for all texts of a component; null without words) and component_id
    of every row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    with common.Scratch(spark) as scratch:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
        bytes_ = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        fragments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // FRAGMENT))
        cut = common.arrow(rows, _split(fragments, words), _OUT)
        counted = common.arrow(cut.repartitionById(fragments, F.col("part")), _count(fragments), _OUT)
        kept = scratch.put(common.arrow(counted.repartitionById(fragments, F.col("part")), _survivors(percent), _KEPT), "sets")
        texts = kept.where("part = -1").select("doc_id", "mark", "n", "node")
        segments = kept.where("part >= 0").select("node", "n", "part", "tokens")
        postings = kept.where("part = 0").select("node", "n", "own", F.posexplode("prefix").alias("_i", "token")).select("node", "n", "own", "token", (F.col("own") + F.col("_i")).alias("pos"))
        postings = scratch.put(meeting(scratch.put(postings, "prefixes"), percent), "postings")
        labels = scratch.put(components(scratch, postings, segments, percent), "labels")
        # A set's rows, then a component's sets, are aggregated; what they give goes back to the rows.
        sets_ = texts.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label"))
        sets_ = scratch.put(sets_, "least")
        least = sets_.groupBy("label").agg(F.min("least").alias("component_id"))
        sets_ = scratch.put(common.join_split(sets_.select("node", "label"), least, "label", "node"), "components")
        done = common.join_split(texts.where("node is not null"), sets_, "node", "doc_id").select("doc_id", "mark", F.col("n").alias("n_shingles"), "label", "component_id")
        none = texts.where("node is null").select("doc_id", "mark", "n", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id"))
        return scratch.last(done.unionAll(none), "classes")


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs` (doc_id, text)."""
    return classes(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def meeting(postings: DataFrame, percent: int) -> DataFrame:
    """The postings from which enough is left to link with even the smallest of the sets that meet at their shingle."""
    least = postings.groupBy("token").agg(F.min("n").alias("_m"), F.count("*").alias("_c")).where("_c > 1")
    enough = F.lit(100 + percent) * (F.col("n") - F.col("pos")) >= F.lit(percent) * (F.col("n") + F.col("_m"))
    return common.join_split(postings, least, "token", "node").where(enough).drop("_m", "_c")


def components(scratch: common.Scratch, postings: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """(node, label) of every set that links with another; the label is the same for all that links reach."""
    spark = postings.sparkSession
    links = labels = tried = None
    places = postings.count()
    for turn in range(PIVOTS + 1):
        here = postings.withColumn("label", F.col("node"))
        if labels is not None:
            here = common.join_split(postings, labels, "node", "token", "left").withColumn("label", F.coalesce("label", "node"))
        here = scratch.put(here, "open")
        order = F.struct("own", F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "pos", "label") if turn % 2 == 0 else F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node"), F.col("n"), F.col("pos"), F.col("label"))
        open_ = here.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(order).alias("p")).where("low <> high")
        last = turn == PIVOTS or _pairs_left(here) <= places
        if not last:
            pivots = open_.select("token", F.col("p.node").alias("other"), F.col("p.n").alias("m"), F.col("p.pos").alias("at"), F.col("p.label").alias("other_label"))
            met = common.join_split(here, pivots, "token", "node").where(F.col("label") != F.col("other_label"))
        else:
            met = _all_apart(scratch, here, open_, percent)
        pairs = met.where(_reach(percent)).select(*_pair("node", "other")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.put(pairs, "pairs")
        tried = pairs if tried is None else tried.unionAll(pairs)
        if pairs.isEmpty():  # sets at a shingle may link though none links with its pivot
            if last:
                break
            continue
        found = scratch.put(verified(pairs, segments, percent), "links")
        links = found if links is None else links.unionAll(found)
        labels = scratch.put(graph.components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch), "labels")
        if last:
            break
    return labels if labels is not None else spark.createDataFrame([], "node long, label long")


def _pairs_left(here: DataFrame) -> int:
    """How many pairs of sets of different labels meet at a shingle, at most."""
    n = here.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    return int(n.agg(F.sum(((F.col("s") * F.col("s") - F.col("q")) / 2).cast("double")).alias("p")).first()["p"] or 0)


def _all_apart(scratch: common.Scratch, here: DataFrame, open_: DataFrame, percent: int) -> DataFrame:
    """All that is still apart at a shingle, set by set. Sets link only if the smaller has PERCENT of the larger's shingles, so they
    meet by shingle and step of size (a factor of 100 / PERCENT each: in the same step or the next); the join itself tests what
    stands from the shingle on, and gives only pairs that can still link."""
    apart = scratch.put(common.join_split(here, open_.select("token"), "token", "node"), "apart")
    step = F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int")
    left = apart.withColumn("key", F.struct("token", step.alias("step")))
    right = apart.select("token", F.col("label").alias("other_label"), F.col("node").alias("other"), F.col("n").alias("m"), F.col("pos").alias("at"), F.explode(F.array(step - 1, step, step + 1)).alias("step"))
    right = right.select(F.struct("token", "step").alias("key"), "other_label", "other", "m", "at")
    # A row per pair and direction would be made twice: the smaller label leads.
    met = common.join_split(left.select("key", "node", "n", "pos", "label"), right, "key", "node")
    return met.where(F.col("label") < F.col("other_label"))
