"""Byte-level BPE: training by merges, encoding and decoding."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder

#: How text is parted before merging (Java's syntax; (?U) lets \s be Unicode's), and special tokens.
SPLIT = r"(?U)'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"
SPECIAL = ("<|bos|>", "<|user_start|>", "<|user_end|>", "<|assistant_start|>", "<|assistant_end|>", "<|python_start|>", "<|python_end|>", "<|output_start|>", "<|output_end|>")


def pretokens(text):
    return F.regexp_extract_all(text, F.lit(SPLIT), F.lit(0))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often each pre-token stands in the texts, aggregated in each task before the shuffle."""
    return docs.select(F.explode(pretokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


#: Pairs that a round looks at; words of a block; merges after which the blocks are written anew.
LISTED, BLOCK, WRITTEN = 512, 200_000, 64


def _blocks(counts: DataFrame) -> DataFrame:
    """Rows of `parts` (the words' bytes as 32-bit numbers, -1 after each word) and `times` (a 64-bit number a word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, times = [], []

        def block() -> pa.RecordBatch:
            flat = np.concatenate([x for w in words for x in (np.frombuffer(w.encode(), np.uint8).astype(np.int32), _END)])
            return pa.record_batch([pa.array([flat.tobytes()], pa.binary()), pa.array([np.array(times, np.int64).tobytes()], pa.binary())], ["parts", "times"])

        for batch in batches:
            words += batch.column(0).to_pylist()
            times += batch.column(1).to_pylist()
            if len(words) >= BLOCK:
                yield block()
                words, times = [], []
        if words:
            yield block()

    return counts.select("word", "n").mapInArrow(run, "parts binary, times binary")


_END = np.array([-1], np.int32)


def apply_merges(flat: np.ndarray, merges: list[tuple[int, int, int]]) -> np.ndarray:
    """The parts of words after merges (left, right, new) in order, each from left to right in a word."""
    for left, right, new in merges:
        at = np.flatnonzero((flat[:-1] == left) & (flat[1:] == right))
        if left == right and len(at):  # of a run, every other one
            first = np.concatenate(([True], np.diff(at) > 1))
            run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        if len(at):
            flat = flat.copy()
            flat[at] = new
            flat = np.delete(flat, at + 1)
    return flat


def _pair_counts(blocks: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """left, right, n: how often each pair of parts stands in the words of `blocks` after the merges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                flat = apply_merges(np.frombuffer(parts, np.int32), merges)
                word = np.cumsum(flat == -1) - (flat == -1)
                inside = (flat[:-1] >= 0) & (flat[1:] >= 0)
                key, at = np.unique(flat[:-1][inside].astype(np.int64) << 32 | flat[1:][inside], return_inverse=True)
                n = np.bincount(at, np.frombuffer(times, np.int64)[word[:-1][inside]].astype(np.float64), len(key)).astype(np.int64)
                yield pa.record_batch([pa.array(key), pa.array(n)], ["pair", "n"])

    return blocks.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _written(blocks: DataFrame, merges: list[tuple[int, int, int]], folder: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([apply_merges(np.frombuffer(p, np.int32), merges).tobytes() for p in batch.column(0).to_pylist()], pa.binary()), batch.column(1)], ["parts", "times"])

    (blocks.mapInArrow(run, "parts binary, times binary") if merges else blocks).write.parquet(folder)
    return blocks.sparkSession.read.parquet(folder)


def next_merges(listed: list[tuple[tuple[int, int], int]], whole: bool, name) -> list[tuple[int, int]]:
    """The pairs that are merged next, one after the other, as far as the counts (pair, n) at hand tell: `listed` are those of the largest, in
    falling order, all there are if `whole`. name: the bytes of a token, by which equal counts are ordered.

    A merge changes the counts of pairs that end where it begins or begin where it ends, and makes none that is more frequent than one of
    these was. So as long as neither a pair of the next largest count, nor one of equal count, is of these, it is next."""
    least = 0 if whole or not listed else listed[-1][1]
    out: list[tuple[int, int]] = []
    touched = lambda p: any(p[1] == a or p[0] == b or (a == b and a in p) for a, b in out)
    for n, group in itertools.groupby(listed, key=lambda x: x[1]):
        pairs = sorted((p for p, _ in group), key=lambda p: (name(p[0]), name(p[1])))
        for i, p in enumerate(pairs):
            if n <= least or any(map(touched, pairs[i:])):
                return out
            out.append(p)
    return out


def train(docs: DataFrame, vocabulary: int) -> list[tuple[bytes, bytes]]:
    """Merges up to so many tokens (256 bytes, the merges, the special ones), each the most frequent pair of all words' parts; ties of
    counts go to the smaller pair.

    All words count, however rare, and stay on the executors, in blocks of bounded size that are written to the shared folder every now and then.
    A round aggregates the pairs' counts and lists the LISTED largest, of which as many are merged as these counts decide for sure."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    blocks = _written(_blocks(word_counts(docs)), [], f"{folder}/0")
    tokens, merges, done = [bytes([i]) for i in range(256)], [], 0
    wanted = vocabulary - 256 - len(SPECIAL)
    while len(merges) < wanted:
        got = _pair_counts(blocks, merges[done:]).orderBy(F.desc("n"), "pair").limit(LISTED + 1).collect()
        listed = [((r["pair"] >> 32, r["pair"] & 0xFFFFFFFF), r["n"]) for r in got]
        more = next_merges(listed, len(listed) <= LISTED, tokens.__getitem__)
        if not more and listed:  # more pairs than are listed are the most frequent ones
            n = listed[0][1]
            rows = _pair_counts(blocks, merges[done:]).where(F.col("n") == n).collect()
            more = [min(((r["pair"] >> 32, r["pair"] & 0xFFFFFFFF) for r in rows), key=lambda p: (tokens[p[0]], tokens[p[1]]))]
        if not more:
            break
        for a, b in more[: wanted - len(merges)]:
            merges.append((a, b, len(tokens)))
            tokens.append(tokens[a] + tokens[b])
        if len(merges) - done >= WRITTEN:
            blocks, done = _written(blocks, merges[done:], f"{folder}/{len(merges)}"), len(merges)
    return [(tokens[a], tokens[b]) for a, b, _ in merges]


def vocabulary(merges: list[tuple[bytes, bytes]]) -> list[bytes]:
    """Bytes of every token by id: bytes, merges in order, special tokens."""
    return [bytes([i]) for i in range(256)] + [a + b for a, b in merges] + [s.encode() for s in SPECIAL]


@lru_cache(maxsize=4)
def _coder(merges: tuple[tuple[bytes, bytes], ...]):
    import tiktoken

    tokens = vocabulary(list(merges))
    plain = len(tokens) - len(SPECIAL)
    return tiktoken.Encoding("own", pat_str=SPLIT.removeprefix("(?U)"), mergeable_ranks={t: i for i, t in enumerate(tokens[:plain])}, special_tokens={s: plain + i for i, s in enumerate(SPECIAL)})


def encode(text, merges: list[tuple[bytes, bytes]], prepend: int | None = None):
    """Token ids of the text; strings of special tokens inside it are ordinary text."""
    held = tuple(merges)

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        code = _coder(held)
        first = [] if prepend is None else [prepend]
        return texts.map(lambda t: None if t is None else first + code.encode_ordinary(t))

    return run(text)


def decode(ids, merges: list[tuple[bytes, bytes]]):
    """The text of token ids; bytes that are no UTF-8 are replaced."""
    tokens = vocabulary(merges)

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else b"".join(tokens[i] for i in x).decode("utf-8", "replace"))

    return run(ids)


def vocabulary_table(spark, merges: list[tuple[bytes, bytes]]) -> DataFrame:
    """token_id, bytes, is_special, n_bytes (0 for special tokens)."""
    tokens = vocabulary(merges)
    plain = len(tokens) - len(SPECIAL)
    return spark.createDataFrame([(i, bytearray(t), i >= plain, 0 if i >= plain else len(t)) for i, t in enumerate(tokens)], "token_id int, bytes binary, is_special boolean, n_bytes int")


def save(spark: SparkSession, merges: list[tuple[bytes, bytes]], path: str) -> None:
    """Writes a vocabulary as a table: token_id, bytes, is_special, n_bytes, and the two halves of a merge."""
    halves = spark.createDataFrame([(256 + i, bytearray(a), bytearray(b)) for i, (a, b) in enumerate(merges)], "token_id int, left binary, right binary")
    vocabulary_table(spark, merges).join(halves, "token_id", "left").write.parquet(path)


def load(spark: SparkSession, path: str) -> list[tuple[bytes, bytes]]:
    """The merges of a vocabulary that save() wrote: a row a token, which a vocabulary's size bounds."""
    rows = spark.read.parquet(path).where("left IS NOT NULL").select("token_id", "left", "right").collect()
    return [(bytes(r["left"]), bytes(r["right"])) for r in sorted(rows, key=lambda r: r["token_id"])]


def special_id(name: str, merges: list[tuple[bytes, bytes]]) -> int:
    """The id of a special token; an error for a name that isn't one."""
    if name not in SPECIAL:
        raise ValueError(f"not a special token: {name}")
    return 256 + len(merges) + SPECIAL.index(name)


def compared(rows: DataFrame, by: str) -> DataFrame:
    """by, n_bytes, and of two tokenizers' counts (base, own) of the same texts: the tokens, bytes an own token, how many percent less than the
    base's, and which is better."""
    sums = rows.groupBy(by).agg(*(F.sum(c).cast("long").alias(n) for c, n in (("n_bytes", "n_bytes"), ("base", "base_tokens"), ("own", "own_tokens"))))
    less = (F.col("base_tokens") - F.col("own_tokens")) / F.nullif("base_tokens", F.lit(0)) * 100
    better = F.when(F.col("own_tokens") < F.col("base_tokens"), "own").when(F.col("own_tokens") > F.col("base_tokens"), "base").otherwise("tie")
    return sums.select("*", F.round(F.col("n_bytes") / F.nullif("own_tokens", F.lit(0)), 6).alias("own_ratio"), F.round(less, 6).alias("less_percent"), better.alias("better"))


def render(turns: DataFrame, merges: list[tuple[bytes, bytes]], most: int = 2048) -> DataFrame:
    """conv_id, ids, mask of conversations (conv_id, turn, role, text; system turns merged): the first token begins the text, each turn
    stands between its marks, and mask is 1 where the assistant speaks, its end mark with it. Cut to `most`.

    An assistant's turn may have parts (array of type, text) instead of text: text; python, what a tool is asked, between its marks; and
    python_output, what it said, between its own, with mask 0. Roles take turns, the user first; other rows, and unknown parts, are errors."""
    one = lambda s: F.array(F.lit(special_id(s, merges)))
    none = F.array().cast("array<int>")
    user = F.col("role") == "user"
    plain = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    content = F.coalesce(F.when(~user, F.col("parts")), plain) if "parts" in turns.columns else plain
    expected = F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant")
    role = F.when(F.col("role") == expected, F.col("role")).otherwise(F.raise_error(F.concat(F.lit("a turn is from "), F.col("role"), F.lit(", not from "), expected)))
    piece = turns.select("conv_id", "turn", role.alias("role"), F.posexplode(content).alias("k", "part")).withColumn("_ids", encode(F.col("part.text"), merges))
    kind = F.col("part.type")
    wrong = F.raise_error(F.concat(F.lit("unknown part: "), kind)).cast("array<int>")
    marks = lambda s: F.when(kind == "text", none).when(kind == "python", one(f"<|python_{s}|>")).when(kind == "python_output", one(f"<|output_{s}|>")).otherwise(wrong)
    piece = piece.withColumn("i", F.concat(marks("start"), "_ids", marks("end")))
    spoken = F.when(user | (kind == "python_output"), 0).otherwise(1)
    piece = piece.select("conv_id", "turn", "role", F.struct("k", "i", F.transform("i", lambda _: spoken).alias("m")).alias("p"))
    turn = piece.groupBy("conv_id", "turn").agg(F.first("role").alias("role"), F.array_sort(F.collect_list("p")).alias("a"))
    flat = lambda f: F.flatten(F.transform("a", lambda x: x[f]))
    start = F.when(user, one("<|user_start|>")).otherwise(one("<|assistant_start|>"))
    end = F.when(user, one("<|user_end|>")).otherwise(one("<|assistant_end|>"))
    turn = turn.select("conv_id", F.struct("turn", F.concat(start, flat("i"), end).alias("i"), F.concat(F.array(F.lit(0)), flat("m"), F.array(F.when(user, 0).otherwise(1))).alias("m")).alias("p"))
    listed = turn.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("a"))
    return listed.select("conv_id", F.slice(F.concat(one("<|bos|>"), flat("i")), 1, most).alias("ids"), F.slice(F.concat(F.array(F.lit(0)), flat("m")), 1, most).alias("mask"))


def for_completion(turns: DataFrame, merges: list[tuple[bytes, bytes]], most: int = 2048) -> DataFrame:
    """conv_id, ids to go on from: the last assistant turn dropped, then the assistant's start mark."""
    last = turns.groupBy("conv_id").agg(F.max_by("role", "turn").alias("_r"), F.max("turn").alias("_t"))
    rest = turns.join(last, "conv_id").where(~((F.col("_r") == "assistant") & (F.col("turn") == F.col("_t")))).drop("_r", "_t")
    return render(rest, merges, most).select("conv_id", F.concat("ids", F.array(F.lit(special_id("<|assistant_start|>", merges)))).alias("ids"))
