"""Mixing sources to target weights: iterative proportional fitting, in DataFrame operations only.

Documents fall into cells by source, language and topic; a cell weighs its tokens. The weights are raked:
scaled in turn so that the sources', the languages' and the topics' sums meet their targets, until all sums are within TOLERANCE of them,
or for ROUNDS turns. A cell's ratio of raked to original weight, over the largest such ratio, is the probability that each of its
documents is sampled, so the sample's expected tokens keep the raked proportions. A document is taken if a number
that its id alone decides (from its md5) is below the probability: the same on every run and machine.

Targets are a share for each value, or an exponent that tempers the shares found. Values without a target keep the share
they have. Nulls in a key are the value ''. A null or empty text has no tokens; cells without tokens keep probability 1. Texts are counted
whole. Rows with equal ids share their fate; a null id counts as ''. An empty table stays empty. Columns are added under names that the
table doesn't have yet (see `names`); its own, whatever they are called, stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Turns at most; the largest deviation from a target, as a share of it, at which raking ends.
ROUNDS, TOLERANCE = 40, 1e-10
#: Turns of few cells between two looks at the deviation.
TURNS = 4
KEYS = ("source", "lang", "topic")
#: Exponents of the tempered shares: 1 keeps them, 0 makes them equal.
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 1.0}
#: A table of more cells than this isn't raked in one task, nor broadcast, but by shuffles.
BROADCAST_CELLS = 100_000
_WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("double")


def topic(text: Column) -> Column:
    """A topic by what stands anywhere in the text: legal, table, contact or prose."""
    has = lambda s: F.coalesce(F.contains(text, F.lit(s)), F.lit(False))
    return F.when(has("icensed under") | has("ights reserved"), "legal").when(has(" | "), "table").when(has("@"), "contact").otherwise("prose")


def draw(doc_id: Column) -> Column:
    """A number of 0 to 1 from the id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(cells: DataFrame, key: str, wanted: DataFrame | float) -> DataFrame:
    """(key, goal): the sum that each value's weights are scaled to. `wanted`: an exponent, or rows (key, share)."""
    found = cells.groupBy(key).agg(F.sum("w").alias("have"))
    over = lambda rows, **sums: rows.join(F.broadcast(rows.agg(*(F.sum(c).alias(n) for n, c in sums.items()))))
    if isinstance(wanted, DataFrame):
        share = found.join(wanted.select(F.col(key), F.col("share").cast("double").alias("share")), key, "left")
        share = over(share, _all="have").withColumn("p", F.coalesce("share", F.col("have") / F.nullif("_all", F.lit(0.0)))).drop("_all")
    else:
        share = found.withColumn("p", F.pow("have", F.lit(float(wanted))))
    return over(share, _p="p", _all="have").select(key, (F.col("p") / F.nullif("_p", F.lit(0.0)) * F.col("_all")).alias("goal"))


def rake(cells: DataFrame, wanted: dict[str, DataFrame | float], scratch: common.Scratch, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """`cells` (the keys, w) with raked, the fitted weight. A step sums the cells' weights by one key: in windows, of cells that one
    task holds, or aggregated and joined back. What a step of many cells gives, or TURNS turns of few, is written, so lineage doesn't grow. The driver sees a turn's largest deviation, one number a key."""
    # Cells that one task holds easily are raked there, without shuffles.
    few = cells.count() <= BROADCAST_CELLS
    read = lambda rows: rows.coalesce(1) if few else rows
    cells = read(cells)
    now = cells.withColumn("raked", F.col("w"))
    for key, want in wanted.items():
        now = now.join(targets(cells, key, want).withColumnRenamed("goal", f"goal_{key}"), key).withColumn(f"off_{key}", F.lit(0.0))
    now = read(scratch.put(now, "raked"))
    for turn in range(rounds):
        for key in wanted:
            if few:
                with_sum = now.withColumn("_sum", F.sum("raked").over(Window.partitionBy(key)))
            else:
                with_sum = now.join(now.groupBy(key).agg(F.sum("raked").alias("_sum")), key)
            factor = F.coalesce(F.col(f"goal_{key}") / F.nullif(F.col("_sum"), F.lit(0.0)), F.lit(1.0))
            now = with_sum.withColumn(f"off_{key}", F.abs(factor - 1)).withColumn("raked", F.col("raked") * factor).select(*now.columns)
            now = now if few else scratch.put(now, "raked")
        if few and (turn + 1) % TURNS and turn + 1 < rounds:
            continue
        now = read(scratch.put(now, "raked")) if few else now
        worst = now.agg(F.max(F.greatest(*(F.col(f"off_{k}") for k in wanted), F.lit(0.0), F.lit(0.0))).alias("x")).first()["x"]
        if worst is None or worst <= tolerance:
            break
    return now.select(*cells.columns, "raked")


def probabilities(docs: DataFrame, wanted: dict[str, DataFrame | float] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, probability) of every cell of `docs` (source, lang, text)."""
    keyed = docs.select(*(F.coalesce(k, F.lit("")).alias(k) for k in KEYS[:2]), topic(F.col("text")).alias("topic"), tokens(F.col("text")).alias("n"))
    with common.Scratch(docs.sparkSession) as scratch:
        cells = scratch.put(keyed.groupBy(*KEYS).agg(F.sum("n").alias("w")), "cells")
        raked = rake(cells, TEMPER if wanted is None else wanted, scratch, rounds).withColumn("ratio", F.coalesce(F.col("raked") / F.nullif("w", F.lit(0.0)), F.lit(0.0)))
        most = raked.agg(F.max("ratio").alias("most"))
        share = F.round(F.when(F.col("w") > 0, F.col("ratio") / F.col("most")).otherwise(1.0), 7)
        return scratch.last(raked.join(F.broadcast(most)).select(*KEYS, share.alias("probability")), "probabilities")


def names(docs: DataFrame) -> tuple[str, str, str]:
    """What mix() calls the topic, the probability, and whether a row is taken."""
    return common.free(docs, "_topic"), common.free(docs, "_probability"), common.free(docs, "_selected")


def mix(docs: DataFrame, wanted: dict[str, DataFrame | float] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """All rows and columns of `docs` (doc_id, source, lang, text), and those of names()."""
    topic_, probability, taken = names(docs)
    cell, other = common.free(docs, "_cell"), common.free(docs, "_other")
    cells = probabilities(docs, wanted, rounds).select(F.struct(*KEYS).alias(cell), F.col("probability").alias(probability))
    key = F.struct(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.col(topic_).alias("topic"))
    marked = docs.withColumn(topic_, topic(F.col("text"))).withColumn(cell, key)
    if cells.count() <= BROADCAST_CELLS:
        met = marked.join(F.broadcast(cells), cell)
    else:
        met = common.join_split(marked.withColumn(other, F.xxhash64("doc_id", "text")), cells, cell, other)
    return met.withColumn(taken, draw(F.col("doc_id")) < F.col(probability)).select(*common.named([*docs.columns, topic_, probability, taken]))


def oracle_sql(rounds: int = 22) -> str:
    """The rows of query op10 in DuckDB's SQL, with so many turns, which are more than raking takes to end on these tables."""
    has = lambda s: f"contains(coalesce(text, ''), '{s}')"
    steps = [
        f"""d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  CASE WHEN {has('icensed under')} OR {has('ights reserved')} THEN 'legal' WHEN {has(' | ')} THEN 'table' WHEN {has('@')} THEN 'contact' ELSE 'prose' END AS topic,
  coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::DOUBLE AS n FROM documents)""",
        "c AS (SELECT source, lang, topic, sum(n) AS w FROM d GROUP BY ALL)",
    ]
    for key in KEYS:
        steps.append(f"g_{key} AS (SELECT {key}, pow(h, {TEMPER[key]}) / sum(pow(h, {TEMPER[key]})) OVER () * sum(h) OVER () AS goal FROM (SELECT {key}, sum(w) AS h FROM c GROUP BY {key}))")
    steps.append("r0 AS (SELECT c.*, w AS raked FROM c)")
    k = 0
    for _ in range(rounds):
        for key in KEYS:
            steps.append(f"r{k + 1} AS MATERIALIZED (SELECT r.source, r.lang, r.topic, r.w, r.raked * coalesce(g.goal / nullif(sum(r.raked) OVER (PARTITION BY r.{key}), 0), 1) AS raked FROM r{k} r JOIN g_{key} g ON g.{key} = r.{key})")
            k += 1
    steps.append(f"q AS (SELECT source, lang, topic, w, coalesce(raked / nullif(w, 0), 0) AS ratio FROM r{k})")
    steps.append("p AS (SELECT source, lang, topic, round(CASE WHEN w > 0 THEN ratio / max(ratio) OVER () ELSE 1 END, 7) AS probability FROM q)")
    return "WITH " + ",\n".join(steps) + """
SELECT d.doc_id, d.source, d.lang, d.topic, p.probability,
  ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0 < p.probability AS selected
FROM d JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic"""
