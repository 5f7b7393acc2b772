"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes. Texts, however long, are cut at safe boundaries, where the tokenizer always starts anew, so the
counts of the pieces add up to the count of the text; the different pieces of a batch are encoded once, many at a time.

A .json file goes through the tokenizers library. For a byte-level one a safe boundary is a single blank between two
characters that aren't white space: its pattern always parts before it. Any other is encoded text by text, in batches.
A .model file goes through sentencepiece; if no piece of its vocabulary holds a blank after something else, a safe boundary is such a
blank, too, which the next piece begins with. A special string inside a text counts as the library has it by default.

Null text: no bytes, no tokens; empty texts likewise. Repeated rows and null ids are counted each. An empty table gives no rows. Only
doc_id and text are read.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pieces that are encoded as one string.
JOINED = 64
#: A blank between two characters that aren't white space.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def counted(texts: list[str], begin: Callable[[list[str]], list[int]], inside: Callable[[list[str]], list[int]]) -> list[int]:
    """The texts' counts, from two functions that count different pieces: those that a text begins with, and those that follow a
    safe boundary's blank."""
    numbers: tuple[dict[str, int], dict[str, int]] = {}, {}
    owners: tuple[list[int], list[int]] = [], []
    places: tuple[list[int], list[int]] = [], []
    for i, text in enumerate(texts):
        if text:
            first, *rest = _SAFE.split(text)
            for number, owner, place, pieces in zip(numbers, owners, places, ([first], rest), strict=True):
                place += [number.setdefault(p, len(number)) for p in pieces]
                owner += [i] * len(pieces)
    out = np.zeros(len(texts))
    for number, owner, place, count in zip(numbers, owners, places, (begin, inside), strict=True):
        if number:
            out += np.bincount(owner, np.array(count(list(number)))[place], len(texts))
    return out.astype(np.int64).tolist()


def _after_blank(library) -> Callable[[list[str]], list[int]]:
    """Counts pieces after a blank with a byte-level library: many at a time as one string, told apart by the tokens' places."""

    def count(pieces: list[str]) -> list[int]:
        runs = [pieces[k : k + JOINED] for k in range(0, len(pieces), JOINED)]
        out: list[int] = []
        for run, code in zip(runs, library.encode_batch([" " + " ".join(r) for r in runs], add_special_tokens=False), strict=True):
            starts, place, last = [a for a, _ in code.offsets], 0, 0
            for piece in run:
                place += len(piece) + 1
                end = bisect_left(starts, place)
                out.append(end - last)
                last = end
        return out

    return count


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from a list of texts to their numbers of tokens, by the file's kind."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        whole = lambda texts: [len(x.ids) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
        parts = library.pre_tokenizer
        byte_level = library.normalizer is None and type(parts).__name__ == "ByteLevel" and not parts.add_prefix_space and parts.use_regex
        inside = _after_blank(library)
        return (lambda texts: counted(texts, whole, inside)) if byte_level else whole
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    whole = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    apart = not any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
    # A piece is encoded as a text of its own, which begins with a blank of the model's, as it does inside a text.
    return (lambda texts: counted(texts, whole, whole)) if apart and model.encode("a a", out_type=str) == ["▁a", "▁a"] else whole


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of `docs` (doc_id, text).

    `tokenizer` is the file's path on the executors.
    """

    def step(texts: list[bytes]) -> dict:
        return {"n_bytes": [len(t) for t in texts], "n_tokens": counter(tokenizer)([t.decode("utf-8", "replace") for t in texts])}

    return common.scan(docs, step, "n_bytes long, n_tokens long", counter.cache_clear).withColumn("over_limit", F.col("n_tokens") > limit)
