"""Conversations and task mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_system(turns: DataFrame) -> DataFrame:
    """conv_id, turn (from 0), role, text: a system turn at the start goes in front of the first user turn, two
    line breaks between. The next turn is looked up within its conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    seen = turns.select("*", F.row_number().over(order).alias("_n"), F.lag("role").over(order).alias("_role"), F.lag("text").over(order).alias("_text"))
    joined = F.when((F.col("_n") == 2) & (F.col("_role") == "system"), F.concat("_text", F.lit("\n\n"), "text")).otherwise(F.col("text"))
    rows = seen.where(~((F.col("_n") == 1) & (F.col("role") == "system"))).select("conv_id", "turn", "role", joined.alias("text"))
    return rows.withColumn("turn", (F.row_number().over(order) - 1).cast("long"))


def validate(turns: DataFrame) -> DataFrame:
    """conv_id, turns, alternates, ends_on_user of each conversation after its system turn is merged: user turns are even, assistant turns odd."""
    merged = merge_system(turns)
    right = F.col("role") == F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant")
    return merged.groupBy("conv_id").agg(F.count("*").alias("turns"), F.every(right).alias("alternates"), (F.max_by("role", "turn") == "user").alias("ends_on_user"))


def first_user(turns: DataFrame) -> DataFrame:
    """conv_id, query: the text of the first user turn."""
    return turns.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"))


def mixture(parts: list[tuple[str, DataFrame, int]], seed: int) -> DataFrame:
    """task, copy, idx, place of each task's rows (idx), repeated so many times, in one order that the seed decides."""
    rows = None
    for name, part, times in parts:
        got = part.select(F.lit(name).alias("task"), F.explode(F.sequence(F.lit(1), F.lit(times))).alias("copy"), "idx").withColumn("copy", F.col("copy").cast("long"))
        rows = got if rows is None else rows.unionAll(got)
    return rows.withColumn("place", F.md5(F.concat_ws("/", F.lit(str(seed)), "task", F.col("copy").cast("string"), F.col("idx").cast("string"))))


def sliced(rows: DataFrame, start: int, stop: int, step: int, size: int) -> DataFrame:
    """physical, idx of the rows start, start + step, ... below stop, which is held to the number of rows."""
    stop = min(stop, size)
    held = (F.col("physical") >= start) & (F.col("physical") < stop) & ((F.col("physical") - start) % step == 0)
    return rows.where(held).withColumn("idx", F.expr(f"(physical - {start}) div {step}"))


def fingerprint(queries: DataFrame, most: int = 1000) -> DataFrame:
    """sha256 over the first `most` queries (idx, query), a zero character after each."""
    first = queries.where(F.col("idx") < most)
    listed = F.array_sort(F.collect_list(F.struct("idx", "query")))
    return first.agg(F.sha2(F.array_join(F.transform(listed, lambda x: F.concat(x["query"], F.char(F.lit(0)))), ""), 256).alias("sha256"), F.count("*").alias("n"))


def render_choices(question, letters, choices):
    """The question, then a line `- choice=letter` for each choice."""
    return F.concat(question, F.lit("\n"), F.array_join(F.zip_with(choices, letters, lambda c, x: F.concat(F.lit("- "), c, F.lit("="), x)), "\n"))


def answer(text):
    """What follows #### in digits, points and commas, commas dropped; null if nothing does."""
    return F.nullif(F.replace(F.regexp_extract(text, r"#### (-?[0-9.,]+)", 1), F.lit(","), F.lit("")), F.lit(""))


def fenced_code(text):
    """The first fenced block (marked python or not), or the whole text, stripped."""
    pattern = r"(?s)```(?:python)?\s*\n(.*?)\n```"
    return F.trim(F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text))
