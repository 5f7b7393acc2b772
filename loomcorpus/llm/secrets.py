"""Secret scans: candidates by pattern, and a random forest that removes what is no secret.

All of it is DataFrame operations and Spark's own machine learning; nothing leaves the JVM. A candidate is a
run of MIN_LENGTH characters or more within a word, at least one of them a digit; a word may hold several. The forest sees its
length, its characters' classes and the transitions between them, how many different characters it has,
how much of it words cover that are frequent in the corpus, whether it looks like a path, and the words next to it.

It is trained on labelled findings (see `fit`). Where no labels are at hand, `weak_labels` makes some from the
characters of the candidate alone, formats that only keys or only numbers have; what stands next to it, by which the forest then
tells others of their kind, is no part of them.

Null and empty texts have no candidates; long ones are cut into words as a whole. Repeated rows and ids, and null ids, each give their
findings; an empty table gives none; only doc_id and text are read. Without findings of both kinds the scan
keeps every candidate, with score 1 (or the one label there is). Ties of the sample's order are broken by all that is used of a finding.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 8
#: Findings that the forest may be trained on, of either label; trees; depth.
SAMPLE, TREES, DEPTH = 4000, 30, 7
#: Words of the dictionary: the most frequent of the corpus, of three letters to twelve.
WORDS = 400
_SPACE = r"[\x20\x09-\x0D]+"
_CORE = rf"([A-Za-z0-9+/_\-]{{{MIN_LENGTH},}}={{0,2}})"
_LIKELY = rf"[A-Za-z0-9+/_\-]{{{MIN_LENGTH}}}"
#: Words that stand by secrets.
NEAR = r"(?i)(password|passwd|pwd|token|secret|credential|auth|api_?key|access_?key|bearer)"
_ASSIGNED = r"(?i)(password|passwd|pwd|token|secret|api_?key|access_?key)['\"]?\s*[=:]"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, word_no, run_no, word, core, before, after of every candidate: each run of a word that is long enough and holds a
    digit. Only texts that hold a run long enough are cut into words.

    The first run of a word has the two words before as its neighbour; a later one has what stands before it in its own word,
    back to the gap before the last run. `word` is all of the word if it has one run; else what belongs to this run alone, so a
    long word isn't repeated for each of its runs.
    """
    likely = docs.where(F.col("text").rlike(_LIKELY)).select(F.col("doc_id").cast("long").alias("doc_id"), F.split("text", _SPACE).alias("words"))
    at = lambda i: F.coalesce(F.try_element_at("words", i), F.lit(""))
    before = lambda i: F.when(i > 1, F.concat(at(i - 1), F.lit(" "), at(i))).when(i == 1, at(F.lit(1))).otherwise("")
    found = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("word_no"), w.alias("word"))), lambda x: (F.length(x["word"]) >= MIN_LENGTH) & x["word"].rlike(_LIKELY))
    found = F.transform(found, lambda x: F.struct(x["word_no"].alias("word_no"), x["word"].alias("whole"), before(x["word_no"]).alias("words_before"), at(x["word_no"] + 2).alias("after")))
    rows = likely.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.*")
    rows = rows.select("doc_id", "word_no", "words_before", "after", F.regexp_extract_all("whole", F.lit(_CORE), F.lit(1)).alias("cores"), F.split("whole", _CORE, -1).alias("gaps"))
    # gaps[i] stands before cores[i], the last after all. Marks at its end but for = and : open the next run, as the quote in ":"AKIA...
    gap, run = (lambda i: F.get("gaps", i)), (lambda i: F.get("cores", i))
    opens = lambda i: F.regexp_extract(F.right(gap(i), F.lit(8)), "[^A-Za-z0-9=:]*$", 0)
    closes = lambda i: F.when(i + 1 == F.size("cores"), gap(i + 1)).otherwise(F.regexp_extract(gap(i + 1), "^[^A-Za-z0-9]*", 0))
    first = lambda i: F.struct(i.alias("run_no"), run(i).alias("core"), F.concat(gap(i), run(i), closes(i)).alias("word"), F.col("words_before").alias("before"))
    later = lambda i: F.struct(
        i.alias("run_no"), run(i).alias("core"), F.concat(opens(i), run(i), closes(i)).alias("word"), F.concat(gap(i - 1), run(i - 1), _without(gap(i), opens(i))).alias("before")
    )
    runs = F.transform("cores", lambda _, i: F.when(i == 0, first(i)).otherwise(later(i)))
    rows = rows.select("doc_id", "word_no", F.explode(F.filter(runs, lambda x: x["core"].rlike("[0-9]"))).alias("x"), "after")
    return rows.select("doc_id", "word_no", "x.run_no", "x.word", "x.core", "x.before", "after")


def _without(text: Column, end: Column) -> Column:
    """`text` without `end`, which it ends with."""
    return F.left(text, F.length(text) - F.length(end))


def dictionary(docs: DataFrame, size: int = WORDS) -> list[str]:
    """The `size` words that stand most often in all of the texts (a bounded list); ties go to the smaller word."""
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where(F.length("word").between(3, 12))
    return [r["word"] for r in words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(size).collect()]


def features(found: DataFrame, words: list[str]) -> DataFrame:
    """`found` with a column f_... for each feature, all doubles. words: the dictionary."""
    core = F.col("core")
    size = F.length(core).cast("double")
    share = lambda pattern: (F.length(F.regexp_replace(core, pattern, "")).cast("double") * -1 + size) / size
    steps = lambda a, b: F.regexp_count(core, F.lit(f"(?<={a})(?={b})")).cast("double") / size
    known = "|".join(sorted(words, key=lambda w: (-len(w), w))) or "(?!)"
    covered = size - F.length(F.regexp_replace(F.lower(core), known, ""))
    columns = {
        "length": size,
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "small": share("[a-z]"),
        "hex": share("[0-9a-f]"),
        "marks": share("[A-Za-z0-9]"),
        "different": F.size(F.array_distinct(F.split(core, ""))).cast("double") / size,
        "letter_digit": steps("[A-Za-z]", "[0-9]"),
        "digit_letter": steps("[0-9]", "[A-Za-z]"),
        "case": steps("[a-z]", "[A-Z]") + steps("[A-Z]", "[a-z]"),
        "covered": covered.cast("double") / size,
        "path": (F.col("word").rlike(r"[/\\.][A-Za-z0-9_\-]+[/\\.@]|@") | F.col("word").startswith("/")).cast("double"),
        "named": F.concat_ws(" ", "before", F.regexp_replace("word", _CORE, "")).rlike(NEAR).cast("double"),
        "assigned": F.concat("before", F.lit(" "), "word").rlike(_ASSIGNED).cast("double"),
        "quoted": F.col("word").rlike("^['\"]").cast("double"),
        "after_mark": F.col("before").rlike("[=:]$").cast("double"),
        "rest": (F.length("word") - F.length(core)).cast("double"),
        "next": F.length("after").cast("double"),
    }
    return found.select("*", *(c.alias(f"f_{k}") for k, c in columns.items()))


def weak_labels(found: DataFrame) -> Column:
    """1 for formats that only keys have (as well-known ones begin, or hexadecimal digits, as many as keys and digests have), 0 for those
    that only other things have (numbers, words with a number behind), else null. Only the candidate's own characters tell."""
    core = F.col("core")
    yes = core.rlike("^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36}|^sk-[A-Za-z0-9]{20,}|^xox[abpr]-") | (core.rlike("^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$") & core.rlike("[A-Fa-f]"))
    no = core.rlike("^[0-9_/+-]+$") | core.rlike("^[A-Z]?[a-z]+[0-9]{0,4}$")
    return F.when(yes, 1).when(no, 0)


class SecretForest:
    """Scores candidates with a forest of Spark's own."""

    def __init__(self, model, columns: list[str], share: float, words: list[str]):
        self.model, self.columns, self.share, self.words = model, columns, share, words

    def score(self, found: DataFrame) -> DataFrame:
        """`found` with score (the trees' share for "secret")."""
        if self.model is None:
            return found.withColumn("score", F.lit(self.share))
        ready = VectorAssembler(inputCols=self.columns, outputCol="_features").transform(features(found, self.words))
        return self.model.transform(ready).withColumn("score", vector_to_array("probability")[1]).select(*found.columns, "score")


def fit(findings: DataFrame, words: list[str], sample: int = SAMPLE, seed: int = 17) -> SecretForest:
    """`findings`: candidates with label 1 (secret) or 0; words: the dictionary. At most `sample` of either label, those with the
    smallest hash, train the forest; they are put in order first, so it is the same on every run."""
    known = findings.where(F.col("label").isin(0, 1))
    part = lambda y: known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id", "word_no", "word"), "doc_id", "word_no", "word", "core", "before").limit(sample)
    ready = features(part(0).unionAll(part(1)), words)
    columns = [c for c in ready.columns if c.startswith("f_")]
    rows = VectorAssembler(inputCols=columns, outputCol="_features").transform(ready).select("_features", F.col("label").cast("double").alias("label")).coalesce(1).cache()
    counts = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        rows.unpersist()
        return SecretForest(None, columns, float(next(iter(counts), 1)), words)
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed)
    model = forest.fit(rows)
    rows.unpersist()
    return SecretForest(model, columns, 1.0, words)


def judge(found: DataFrame, model: SecretForest, least: float = 0.5) -> DataFrame:
    """doc_id, word_no, run_no, finding, score, is_secret of every candidate."""
    return model.score(found).select("doc_id", "word_no", "run_no", F.col("core").alias("finding"), F.round("score", 6).alias("score"), (F.col("score") >= least).alias("is_secret"))


def scan(docs: DataFrame, model: SecretForest, least: float = 0.5) -> DataFrame:
    """What judge() says of every candidate of `docs` (doc_id, text)."""
    return judge(candidates(docs), model, least)
