"""Programs and tool calls in answers, as columns: import headers, assembled programs, typed parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a tool call is written between.
CALL = "<<([^>]+)>>"


def import_header(program: Column) -> Column:
    """The import lines at a program's top, a line break between: lines are kinds (import, passed over, other), and the first
    that is other ends the header. A null program has no header."""
    lines = F.transform(F.split(program, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    is_import = lambda x: x.startswith("import ") | x.startswith("from ")
    end = F.array_position(F.transform(lines, lambda x: ~(is_import(x) | (x == "") | x.startswith("#"))), True)
    return F.array_join(F.filter(F.slice(lines, 1, F.when(end > 0, end.cast("int") - 1).otherwise(F.size(lines))), is_import), "\n")


def assembled(header: Column, code: Column, test: Column, entry: Column) -> Column:
    """A program to run: the header, the code, the test, and a call of check on the entry point."""
    return F.concat(header, F.lit("\n\n"), code, F.lit("\n\n"), test, F.lit("\ncheck("), entry, F.lit(")"))


def tool_parts(answer: Column) -> Column:
    """array of (type, text): the text around tool calls, empty ones too, and for each call what is to be evaluated (python) and, after its
    last =, what came out (python_output); without = nothing came out."""
    between, calls = F.split(answer, CALL, -1), F.regexp_extract_all(answer, F.lit(CALL), F.lit(1))
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    said = lambda c: F.substring_index(c, "=", -1)
    asked = lambda c: F.when(F.contains(c, F.lit("=")), F.left(c, F.length(c) - F.length(said(c)) - 1)).otherwise(c)
    given = lambda c: F.when(F.contains(c, F.lit("=")), said(c)).otherwise("")
    call = lambda i: F.when(i < F.size(calls), F.array(part("python", asked(F.get(calls, i))), part("python_output", given(F.get(calls, i))))).otherwise(F.array().cast("array<struct<type:string,text:string>>"))
    return F.flatten(F.transform(between, lambda t, i: F.concat(F.array(part("text", t)), call(i))))


def letter_score(said: Column, truth: Column, letters: Column) -> Column:
    """1 if the answer is the right letter, else 0; an answer that is no letter of the item is an error."""
    return F.when(F.array_contains(letters, said), (said == truth).cast("int")).otherwise(F.raise_error(F.concat(F.lit("no letter of the item: "), F.coalesce(said, F.lit("null")))))
