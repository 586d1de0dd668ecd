"""Secret scan: a random forest that tells findings from false positives, with DataFrame functions only.

Candidates are, in the words of the whole text, runs of 16 or more letters, digits and ``_+/=-`` with a digit;
whatever stands between quotes; and, of any length and characters, the value assigned to a keyword. The forest
sees a candidate's length, its transitions (between letters and digits, between small and capital letters, and
how likely its pairs of letters follow each other in the corpus's words), its shares of digits, capitals,
hexadecimal and distinct characters, the share of it that is dictionary words, the path (source) and the
neighbouring words. It is trained on labelled findings, LABELLED at most.

The dictionary is the corpus's own: words of four or more letters that stand in DICTIONARY_DOCS documents or more.

Without labelled findings, those of ``rule_labels`` in half of the documents (by a hash of their ids) serve as such.
Candidates of the other half, and those whose form tells nothing, are judged unseen.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep

CANDIDATE = "(?<![A-Za-z0-9_+/=\\-])(?=[A-Za-z_+/=\\-]*[0-9])[A-Za-z0-9_+/=\\-]{16,}"
KEYWORD = "(?i)^[\"'`({\\[]*[a-z0-9_.-]*(token|secret|passw|pwd|api_?key|credential|auth|private)[a-z0-9_.-]*[\"'`]*[=:]*$"
_NAMED = "(?:token|secret|passw|pwd|api_?key|credential|auth|private)[a-z0-9_.-]*[\"'`]*"
_KEY = "[a-z0-9_.-]*" + _NAMED
#: A keyword and what is assigned to it in one word; a word that only assigns; quoted parts of a word (the second group).
INLINE = f"(?i)(?:^|[^a-z0-9_.-]){_KEY}(?:=>|:=|[=:]+)(.+)$"
KEY_ENDS = f"(?i)(?:^|[^a-z0-9_.-]){_KEY}(?:=>|:=|[=:]+)$"
ASSIGNS = "^(?:=>|:=|[=:]+)$"
STARTS = "^(?:=>|:=|[=:]+)(.+)$"
QUOTED = r"""(?<![\p{L}\p{N}])(["'`])((?:(?!\1).)+)\1(?![\p{L}\p{N}])"""
#: Texts that may hold candidates of the latter kinds.
MAYBE = f"(?i){_NAMED}[\\x20\\x09-\\x0D]*[=:]|[\"'`]\\S+[\"'`]"
LABELLED = 20_000
DICTIONARY_DOCS = 3
#: Forms that issuers give their keys.
KNOWN = "^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{8,}\\.eyJ.*)$"
FEATURES = ["length", "transitions", "switches", "letter_digit", "digit_letter", "case", "pairs", "digits", "capitals", "hexadecimal", "distinct", "dictionary", "path", "before", "before2", "after", "keyword", "assigned", "quoted"]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, path, place, candidate, word, before2, before, after): every candidate with its neighbours; ``place`` counts words from 0."""
    some = docs.where(F.col("text").rlike(CANDIDATE) | F.col("text").rlike(MAYBE)).select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path"), F.split(F.col("text"), "[\\x20\\x09-\\x0D]+").alias("w"))
    of = lambda i: F.coalesce(F.get(F.col("w"), i), F.lit(""))
    after_key = lambda i: of(i - 1).rlike(KEY_ENDS) | (of(i - 2).rlike(KEYWORD) & of(i - 1).rlike(ASSIGNS)) | (of(i - 1).rlike(KEYWORD) & of(i).rlike(STARTS))
    # Most words show at a glance that they are none.
    glance = lambda i: of(i).rlike("[0-9=:\"'`]") | of(i - 1).rlike("[=:>]$")
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: glance(i) & (of(i).rlike(CANDIDATE) | of(i).rlike(QUOTED) | of(i).rlike(INLINE) | (after_key(i) & ~of(i).rlike(ASSIGNS))))
    found = some.select("doc_id", "path", "w", F.explode(at).alias("place"))
    near = lambda k: F.coalesce(F.get(F.col("w"), F.col("place") + k), F.lit(""))
    found = found.select("doc_id", "path", F.col("place").cast("long").alias("place"), near(0).alias("word"), near(-2).alias("before2"), near(-1).alias("before"), near(1).alias("after"), after_key(F.col("place")).alias("follows"))
    inline = F.regexp_extract("word", INLINE, 1)
    value = F.when(F.length(inline) > 0, inline).when(F.col("follows"), F.regexp_replace("word", "^(?:=>|:=|[=:]+)", "")).otherwise("")
    closed = F.regexp_extract(value, "^([\"'`])(.+)\\1", 2)
    value = F.when(F.length(closed) > 0, closed).otherwise(F.regexp_replace(value, "^[\"'`]+|[\"'`]*[,;]*$", ""))
    all_of = F.array_distinct(F.concat(F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0)), F.regexp_extract_all("word", F.lit(QUOTED), F.lit(2)), F.array(value)))
    return found.withColumn("candidate", F.explode(F.filter(all_of, lambda x: F.length(x) > 0))).drop("follows")


def _share(of: str) -> Column:
    return F.regexp_count("candidate", F.lit(of)) / F.length("candidate")


def dictionary(docs: DataFrame) -> DataFrame:
    """(known, n): the corpus's words and in how many documents they stand."""
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("(?<![a-z0-9])[a-z]{4,}(?![a-z0-9])"), F.lit(0)))).alias("known"))
    return words.groupBy("known").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= DICTIONARY_DOCS)


def _coverage(found: DataFrame, known: DataFrame) -> DataFrame:
    """(candidate, covered): the letters of each distinct candidate that are in dictionary words."""
    runs = found.select("candidate").distinct().select("candidate", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{4,}"), F.lit(0))).alias("run"))
    return runs.join(known, F.col("run") == F.col("known")).groupBy(F.col("candidate").alias("c")).agg(F.sum(F.length("run")).alias("covered"))


def _pair(text: Column) -> Column:
    return (F.ascii(F.substring(text, 1, 1)) - 97) * 26 + F.ascii(F.substring(text, 2, 1)) - 97


def pair_logs(known: DataFrame) -> list[float]:
    """Logs of the shares of each letter after each letter in the dictionary's words, with one added to each count; 676 numbers."""
    places = F.sequence(F.lit(1), F.length("known") - 1)
    rows = known.select("n", F.explode(F.transform(places, lambda i: _pair(F.substring("known", i, F.lit(2))))).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
    counts = dict.fromkeys(range(676), 1) | {r["pair"]: r["n"] + 1 for r in rows.collect()}
    return [math.log(counts[k] / sum(counts[k // 26 * 26 + b] for b in range(26))) for k in range(676)]


def described(docs: DataFrame) -> DataFrame:
    """Candidates with their features."""
    found = keep(candidates(docs), "candidates")
    known = keep(dictionary(docs), "dictionary")
    covered, logs = _coverage(found, known), F.array(*map(F.lit, pair_logs(known)))
    pairs = F.regexp_extract_all(F.lower("candidate"), F.lit("(?=([a-z]{2}))"), F.lit(1))
    likely = F.aggregate(pairs, F.lit(0.0), lambda total, x: total + F.get(logs, _pair(x))) / F.greatest(F.size(pairs), F.lit(1))
    bucket = lambda c: (F.crc32(F.regexp_replace(F.lower(c), "[^a-z]+", "").cast("binary")) % 64).cast("double")
    joined = found.join(covered, F.col("candidate") == F.col("c"), "left").drop("c")
    return joined.select(
        "doc_id", "place", "candidate",
        F.length("candidate").cast("double").alias("length"),
        (F.regexp_count("candidate", F.lit("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")) / F.length("candidate")).alias("transitions"),
        (F.regexp_count("candidate", F.lit("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[0-9a-z])|(?<=[a-z])(?=[0-9A-Z])")) / F.length("candidate")).alias("switches"),
        _share("(?<=[A-Za-z])[0-9]").alias("letter_digit"), _share("(?<=[0-9])[A-Za-z]").alias("digit_letter"), _share("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]").alias("case"),
        likely.alias("pairs"),
        _share("[0-9]").alias("digits"), _share("[A-Z]").alias("capitals"), _share("[0-9a-fA-F]").alias("hexadecimal"),
        (F.size(F.array_distinct(F.split("candidate", ""))) / F.length("candidate")).alias("distinct"),
        (F.coalesce("covered", F.lit(0)) / F.length("candidate")).alias("dictionary"),
        (F.crc32(F.col("path").cast("binary")) % 64).cast("double").alias("path"),
        bucket(F.col("before")).alias("before"), bucket(F.col("before2")).alias("before2"), bucket(F.col("after")).alias("after"),
        (F.col("before").rlike(KEYWORD) | F.col("before2").rlike(KEYWORD) | F.col("before").rlike(KEY_ENDS) | F.regexp_extract("word", "^(.*?[=:])", 1).rlike(KEYWORD) | F.col("word").rlike(INLINE)).cast("double").alias("keyword"),
        (F.col("before").rlike("[=:]$|=>$") | F.col("word").rlike(STARTS) | F.col("word").rlike(INLINE) | F.regexp_extract("word", "^([^=:]*[=:])", 1).rlike("^[A-Za-z_.\"'-]+[=:]$")).cast("double").alias("assigned"),
        F.col("word").rlike("[\"'`]").cast("double").alias("quoted"),
    )


def rule_labels(found: DataFrame) -> DataFrame:
    """Labels of findings whose form leaves no doubt.

    1 for a quoted value of mixed letters and digits after a keyword, a known form of key, and a bare value that
    switches between small and capital letters and digits as random ones do; 0 for numbers and for candidates
    mostly of dictionary words.
    """
    plain = (F.col("digits") == 1) | (F.col("dictionary") > 0.5)
    mixed = (F.col("digits") > 0) & (F.col("digits") < 1) & ~plain
    valued = (F.col("keyword") == 1) & (F.col("quoted") == 1) & ((F.col("length") >= 20) | (F.col("assigned") == 1) & (F.col("length") >= 8))
    random = (F.col("length") >= 20) & (F.col("switches") >= 0.4) & (F.col("capitals") >= 0.15) & (F.col("capitals") + F.col("digits") <= 0.85) & (F.col("distinct") >= 0.4) & F.col("candidate").rlike("^[A-Za-z0-9]+$")
    sure = F.col("candidate").rlike(KNOWN) | (mixed & (valued | random))
    return found.where(sure | plain).withColumn("label", sure.cast("double"))


def unseen(doc_id: Column) -> Column:
    """Documents whose findings are not used as labels: half of them, and those without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 1, F.lit(True))


def scan(docs: DataFrame, labelled: DataFrame | None = None, labels: int = LABELLED, trees: int = 20, threshold: float = 0.5) -> DataFrame:
    """(doc_id, place, candidate, probability, kept) of every candidate of ``docs(doc_id, text, source)``.

    ``labelled(doc_id, place, candidate, label)`` are findings known to be secrets (1) or not (0); without
    them, those of ``rule_labels`` in half of the documents, half of them of each kind at most. Of more than
    ``labels`` those of the least hashes are used; equal hashes are of equal findings. Without findings of both
    kinds nothing is removed: each is kept with probability 1. Null texts hold none. Repeated rows give
    repeated results; other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("source"))
    found = keep(described(docs), "described")
    if labelled is None:
        known = rule_labels(found).where(~unseen(F.col("doc_id")))
    else:
        given = labelled.select(F.col("doc_id").alias("d"), F.col("place").alias("p"), F.col("candidate").alias("c"), F.col("label").cast("double").alias("label")).distinct()
        known = found.join(given, (F.col("doc_id") == F.col("d")) & (F.col("place") == F.col("p")) & (F.col("candidate") == F.col("c")))
    known = known.select(*FEATURES, "label", F.xxhash64("candidate", "doc_id", "place").alias("h"))
    least = lambda some, n: some.orderBy("h").limit(n).drop("h")
    # By kind, as plain quoted words would leave no room for the few secrets.
    known = keep(least(known.where("label = 1"), labels // 2).union(least(known.where("label = 0"), labels // 2)) if labelled is None else least(known, labels), "labelled")
    kinds = known.groupBy("label").count().count()
    if kinds < 2:
        return found.select("doc_id", "place", "candidate", F.lit(1.0).alias("probability"), F.lit(True).alias("kept"))
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=8, seed=17).fit(assemble.transform(known))
    judged = forest.transform(assemble.transform(found)).withColumn("p", vector_to_array("probability")[1])
    return judged.select("doc_id", "place", "candidate", F.col("p").alias("probability"), (F.col("p") >= threshold).alias("kept"))
