"""PII: base patterns, and information-theoretic sanitisation of the terms that reveal what they find.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers, by fixed patterns. Each value
found is a protected entity. A term can reveal an entity without it: over the whole corpus, the
pointwise mutual information of term and entity (how much seeing the term in a document says about the entity) is
compared with the entity's own information content (Sánchez and Batet). Where it reaches DISCLOSURE of it,
and the two stand together in documents with at least SUPPORT different contexts of the entity (the words next to it), the term
is added (kind "term") and generalised wherever it stands, in documents without the entity, too.

Counts are over different texts, so copies count once: N texts; n(t) texts that hold the term; n(e), n(e, t) those that hold the
entity, and the two together. PMI = ln(N n(e, t) / (n(e) n(t))), information content = ln(N / n(e)). Texts go by 64-bit hashes.

Null text is empty text: no spans. Equal rows get equal spans. Spans are in code points, end exclusive. A text may be as long as
memory lets one row be: time and memory follow its length and its spans. Ties can't matter (a threshold decides), an empty table
gives empty results, extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of an entity that tell its contexts apart; share of the information content; different contexts needed.
REACH, DISCLOSURE, SUPPORT = 6, 0.9, 3
#: So many terms at most are sent to the tasks; more are joined.
TERMS = 50_000
#: What redaction puts in place of a span.
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DROPPED = re.compile("[^0-9a-z@._%+-]")
_EDGE = ".,;:!?\"'()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address has one @ (none stands in the part before it), so each @ is looked at in turn; the part before
    starts where its characters do, but not before the end of the last address."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and (m := _LOCAL.search(text, max(last, start - 64), start)) and m.start() < start:
            start = m.start()
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x) < 4 and int(x or "0") <= 255 for x in (part.lstrip("0") for part in m.group().split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group()) if m.end() - m.start() >= 13 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def contexts(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int]]:
    """(entity, hash of the words around it) of every span: the REACH words before the word it starts in, and those after the word it
    ends in. Words are looked up by bisection and hashed once, so time follows the text and the spans, not their product."""
    words = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in words]
    known: dict[int, bytes] = {}

    def seen(i: int) -> bytes:
        if i not in known:
            known[i] = hashlib.blake2b(text[slice(*words[i])].lower().encode(), digest_size=8).digest()
        return known[i]

    out = []
    for kind, start, end in spans:
        first, last = bisect_right(starts, start) - 1, bisect_right(starts, end - 1) - 1
        around = [*range(max(0, first - REACH), first), *range(last + 1, min(len(words), last + 1 + REACH))]
        context = int.from_bytes(hashlib.blake2b(b"".join(map(seen, around)), digest_size=8).digest(), "big", signed=True)
        out.append((f"{kind}:{_DROPPED.sub('', text[start:end].lower())}", context))
    return out


def terms_of(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of every term. A term is a word in lower case without punctuation at its edges, of two
    characters or more, that is in no span."""
    taken, k, past = sorted((x, y) for _, x, y in spans), 0, 0
    for m in _WORD.finditer(text):
        word = m.group()
        a = m.start() + len(word) - len(word.lstrip(_EDGE))
        word = word.strip(_EDGE)
        b = a + len(word)
        while k < len(taken) and taken[k][0] < b:
            past, k = max(past, taken[k][1]), k + 1
        if b - a > 1 and past <= a:
            yield word.lower(), a, b


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), "text")


def detect(docs: DataFrame) -> DataFrame:
    """hash (of the text), near (entities and their contexts), terms (the different terms, of a text with entities) for every row of `docs`."""
    near = pa.list_(pa.struct([("entity", pa.string()), ("context", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, texts in common.byte_slices(batch):
                around, terms = [], []
                for raw in texts:
                    text = raw.decode("utf-8", "replace")
                    spans = base_spans(text)
                    around.append([{"entity": e, "context": c} for e, c in sorted(set(contexts(text, spans)))])
                    terms.append(sorted({t for t, _, _ in terms_of(text, spans)}) if spans else [])
                yield pa.record_batch([hashes, pa.array(around, near), pa.array(terms, pa.list_(pa.string()))], ["hash", "near", "terms"])

    return common.arrow(_hashed(docs), run, "hash long, near array<struct<entity: string, context: long>>, terms array<string>")


def _few(terms: DataFrame) -> list[str] | None:
    """The terms, if the tasks can be sent them."""
    got = [r["term"] for r in terms.limit(TERMS + 1).collect()]
    return sorted(got) if len(got) <= TERMS else None


def _words(text: str) -> set[str]:
    return {w.strip(_EDGE) for w in set(_WORD.findall(text.lower()))}


def _holding(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """hash, term: which of `terms` stand in a text, by a join with all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, texts in common.byte_slices(batch):
                yield pa.record_batch([hashes, pa.array([sorted(_words(t.decode("utf-8", "replace"))) for t in texts], pa.list_(pa.string()))], ["hash", "words"])

    words = common.arrow(_hashed(docs), run, "hash long, words array<string>").select("hash", F.explode("words").alias("term"))
    return words.join(terms, "term", "left_semi").select("hash", "term").distinct()


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, held: in how many different texts each of `terms` stands, over all of `docs`.

    Up to TERMS terms are sent to the tasks, and a text is shuffled as the numbers of those it holds. More meet all words by a join.
    """
    wanted = _few(terms)
    if wanted is None:
        return _holding(docs, terms).groupBy("term").agg(F.count("*").alias("held"))
    number = {t: i for i, t in enumerate(wanted)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, texts in common.byte_slices(batch):
                got = [sorted(number[w] for w in _words(t.decode("utf-8", "replace")) if w in number) for t in texts]
                yield pa.record_batch([hashes, pa.array(got, pa.list_(pa.int32()))], ["hash", "numbers"])

    once = common.arrow(_hashed(docs), run, "hash long, numbers array<int>").where(F.size("numbers") > 0).groupBy("hash").agg(F.first("numbers").alias("numbers"))
    counted = once.select(F.explode("numbers").alias("number")).groupBy("number").agg(F.count("*").alias("held"))
    names = docs.sparkSession.createDataFrame(pa.table({"term": pa.array(wanted, pa.string()), "number": pa.array(range(len(wanted)), pa.int32())}))
    return counted.join(names, "number").select("term", "held")


def disclosing(docs: DataFrame, found: DataFrame, scratch: common.Scratch, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(entity, term) pairs whose mutual information discloses the entity, from counts over all of `docs`.

    A pair has no more contexts than its entity, so terms are paired with entities of enough contexts only."""
    texts = found.where(F.size("near") > 0).groupBy("hash").agg(F.first("near").alias("near"), F.first("terms").alias("terms"))
    near = texts.select("hash", "terms", F.explode("near").alias("x")).select("hash", "terms", "x.entity", "x.context")
    entities = near.groupBy("entity").agg(F.count_distinct("hash").alias("seen"), F.count_distinct("context").alias("contexts"))
    entities = scratch.put(entities.where(F.col("contexts") >= support).drop("contexts"), "entities")
    met = near.join(entities.select("entity"), "entity", "left_semi").select("entity", "hash", "context", F.explode("terms").alias("term"))
    pairs = met.groupBy("entity", "term").agg(F.count_distinct("hash").alias("both"), F.count_distinct("context").alias("contexts"))
    pairs = scratch.put(pairs.where(F.col("contexts") >= support).drop("contexts"), "pairs")
    held = term_counts(docs, pairs.select("term").distinct())
    total = F.lit(float(max(1, found.select("hash").distinct().count())))
    joined = pairs.join(entities, "entity").join(held, "term")
    pmi = F.log(total * F.col("both") / (F.col("seen") * F.greatest("held", "both")))
    content = F.log(total / F.col("seen"))
    return joined.where((content > 0) & (pmi >= disclosure * content)).select("entity", "term")


def _marking(docs: DataFrame, name: str) -> tuple[DataFrame, frozenset[str]]:
    """`docs` with a column `name`, and terms: those of either that stand in a text are to go. Up to TERMS terms are
    sent to the tasks; more are joined to the texts that hold them."""
    none = F.array().cast("array<string>")
    with common.Scratch(docs.sparkSession) as scratch:
        terms = scratch.put(disclosing(docs, scratch.put(detect(docs), "found"), scratch).select("term").distinct(), "terms")
        wanted = _few(terms)
        if wanted is not None:
            return docs.withColumn(name, none), frozenset(wanted)
        terms = scratch.last(terms, "terms")
    key = common.free(docs, "_hash")
    held = _holding(docs, terms).groupBy(F.col("hash").alias(key)).agg(F.collect_set("term").alias(name))
    marked = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit("")))).join(held, key, "left").drop(key)
    return marked.withColumn(name, F.coalesce(name, none)), frozenset()


def _added(text: str, own: list[tuple[str, int, int]], risky: frozenset[str] | set[str]) -> list[tuple[str, int, int]]:
    """The spans of the terms of `text` that are in `risky`."""
    if not risky or risky.isdisjoint(_words(text)):
        return []
    return [("term", a, b) for t, a, b in terms_of(text, own) if t in risky]


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, found (base), added (term spans), one row for every row of `docs` (doc_id, text)."""
    marked, wanted = _marking(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "_terms")
    many = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for ids, texts in common.byte_slices(batch):
                found, added = [], []
                for raw, more in zip(texts, batch.column(2).slice(at, len(texts)).to_pylist(), strict=True):
                    text = raw.decode("utf-8", "replace")
                    own = base_spans(text)
                    found.append([f"{k}:{a}:{b}" for k, a, b in own])
                    added.append([f"{k}:{a}:{b}" for k, a, b in _added(text, own, wanted or set(more))])
                at += len(texts)
                yield pa.record_batch([ids, pa.array(found, many), pa.array(added, many)], ["doc_id", "found", "added"])

    return common.arrow(marked.select("doc_id", "text", "_terms"), run, "doc_id long, found array<string>, added array<string>")


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span of the text replaced by its mask. A text without spans stays as it is, a null one null. Rows are mapped
    each on its own (a row id isn't needed), so repeated rows and null ids stay as they are; other columns, whatever
    their names, pass by untouched; an empty table stays empty."""
    name = common.free(docs, "_terms")
    marked, wanted = _marking(docs, name)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, terms in batches:
            yield pd.Series([None if t is None else masked(t, wanted or set(x)) for t, x in zip(texts, terms, strict=True)], dtype=object)

    def whole(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from common.resting(run)(batches)

    common.hold_batches(docs.sparkSession)
    return marked.withColumn("text", F.pandas_udf(whole, "string")("text", name)).select(*common.named(docs.columns))


def masked(text: str, risky: frozenset[str] | set[str]) -> str:
    """The text with its base spans, and the terms in `risky`, masked."""
    own = base_spans(text)
    own = own + _added(text, own, risky)
    out, at = [], 0
    for kind, a, b in sorted(set(own), key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], MASKS[kind]]
            at = b
        elif b > at:  # a span that laps over another's end: what is left of it goes, too
            at = b
    return "".join([*out, text[at:]])


def digest(docs: DataFrame) -> DataFrame:
    """The span columns of `spans` as counts, a hash of the base spans, and all spans in one string."""
    got = spans(docs)
    kind = lambda k: F.size(F.filter("found", lambda x: x.startswith(f"{k}:"))).cast("long").alias(f"n_{k}")
    return got.select("doc_id", *map(kind, KINDS), F.sha2(F.array_join("found", ","), 256).alias("base_sha256"), F.array_join(F.concat("found", "added"), ",").alias("spans"))
