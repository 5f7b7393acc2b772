"""Evaluation items: prompts, examples drawn for them, seeded orders, spans of answers."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import common_prefix, common_suffix


def prompts(example: Column, options: Column, delimiter: str, examples: Column | None = None) -> Column:
    """A prompt for each option: worked examples (array of text), two line breaks after each, then `example`, the delimiter, the option."""
    shots = F.lit("") if examples is None else F.coalesce(F.array_join(F.transform(examples, lambda x: F.concat(x, F.lit("\n\n"))), ""), F.lit(""))
    return F.transform(options, lambda o: F.concat(shots, example, F.lit(delimiter), o))


def schema_prompts(contexts: Column, continuation: Column, delimiter: str, examples: Column | None = None) -> Column:
    """A prompt for each context: worked examples, the context, the delimiter, the one continuation."""
    shots = F.lit("") if examples is None else F.coalesce(F.array_join(F.transform(examples, lambda x: F.concat(x, F.lit("\n\n"))), ""), F.lit(""))
    return F.transform(contexts, lambda c: F.concat(shots, c, F.lit(delimiter), continuation))


def open_prompts(context: Column, continuation: Column, delimiter: str) -> Column:
    """Two prompts: the trimmed context with the delimiter, stripped; and the same, not stripped, with the continuation."""
    start = F.concat(F.regexp_replace(context, r"^\s+|\s+$", ""), F.lit(delimiter))
    return F.array(F.regexp_replace(start, r"^\s+|\s+$", ""), F.concat(start, continuation))


def choice_span(tokens: Column, size: int) -> Column:
    """start and end of each sequence's own part, of `size` sequences that begin alike."""
    same = common_prefix(*(tokens[i] for i in range(size)))
    return F.transform(tokens, lambda t: F.struct(same.alias("start"), F.size(t).cast("long").alias("end")))


def suffix_span(tokens: Column, size: int) -> Column:
    """start and end of the part that `size` sequences end with alike."""
    same = common_suffix(*(tokens[i] for i in range(size)))
    return F.transform(tokens, lambda t: F.struct((F.size(t) - same).cast("long").alias("start"), F.size(t).cast("long").alias("end")))


def _order(spark: SparkSession, places) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame({"place": range(len(places)), "physical": places}).astype("int64"))


def permutation(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """place, physical: numpy's seeded permutation of n rows, to join a table of known length to. One generator makes it, n numbers of a
    list of items, not of a corpus."""
    return _order(spark, np.random.default_rng(seed).permutation(n))


def shuffled(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """place, physical: the order that Python's own seeded shuffle gives n rows; as above."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return _order(spark, order)


def few_shot(spark: SparkSession, n: int, shots: int, seed: int = 1234) -> DataFrame:
    """idx, slot, other: `shots` other items for each of n, as Python's generator, seeded with the seed plus the item's number, samples
    them from the list of the others. Sampling takes places, so the list needn't be made: a place from the item's own on is one further."""

    def run(batches):
        for b in batches:
            rows = [(i, s, j + (j >= i)) for i in b.column(0).to_pylist() for s, j in enumerate(random.Random(seed + i).sample(range(n - 1), min(shots, n - 1)))]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], ["idx", "slot", "other"])

    return spark.range(n).mapInArrow(run, "idx long, slot int, other long")


def attach_refs(examples: DataFrame, refs: DataFrame) -> DataFrame:
    """`examples` (physical) with their refs (physical, ids, scores)."""
    return examples.join(refs, "physical", "left")


def staleness(meta: dict, now: DataFrame) -> DataFrame:
    """field, agrees: whether what the references' record says is what one row `now` of the queries and the index at hand has."""
    pairs = F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).eqNullSafe(F.lit(v)).alias("agrees")) for k, v in meta.items()))
    return now.select(F.explode(pairs).alias("x")).select("x.field", "x.agrees")


def continued_span(without: Column, with_: Column) -> Column:
    """(start, end) of the continuation in the tokens of a prompt with it; the prompt without must be a prefix, and shorter."""
    n = F.size(without)
    ok = (n < F.size(with_)) & (F.slice(with_, F.lit(1), n) == without)
    span = F.struct(n.cast("long").alias("start"), F.size(with_).cast("long").alias("end"))
    return F.when(ok, span).otherwise(F.raise_error(F.lit("the prompt without its end isn't a prefix of the prompt")))


def all_predicted(predictions: Column, tokens: Column, start: Column, end: Column) -> Column:
    """Whether each token from start to end - 1 was predicted, at the place before it."""
    n = (end - start).cast("int")
    return F.slice(predictions, start.cast("int"), n) == F.slice(tokens, (start + 1).cast("int"), n)
