"""Quality classifier: rules from tree paths over text statistics, weighted by a lasso, compiled to columns."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import without_ids
from .common import bucket_of, read, stash, text_or_empty

MAX_TRAIN_ROWS = 40_000  # bound of the labelled sample that a model is fitted on


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a whole text as double columns; all are 0 for an empty text."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    n_chars, n_words, n_lines = F.length(text), F.size(words), F.size(lines)

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    return {
        "log_words": F.log1p(n_words.cast("double")),
        "chars_per_word": share(n_chars.cast("double"), n_words),
        "words_per_line": share(n_words.cast("double"), n_lines),
        "upper": share(count(r"\p{Lu}"), n_chars),
        "symbols": share(count(r"[^\p{L}\p{N}\s.,]"), n_chars),
        "digits": share(count(r"\p{N}"), n_chars),
        "stops": share(count(r"[.,]"), n_words),
        "distinct_words": share(F.size(F.array_distinct(words)).cast("double"), n_words),
        "distinct_lines": share(F.size(F.array_distinct(lines)).cast("double"), n_lines),
        "repeats": share(count(r"(?<!\S)(\S+)\s\1(?!\S)"), n_words),
        "longest_word": F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)).cast("double"),
    }


#: Names of the statistics, in the order of the trees' features.
FEATURES = ["log_words", "chars_per_word", "words_per_line", "upper", "symbols", "digits", "stops", "distinct_words", "distinct_lines", "repeats", "longest_word"]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold


@dataclass
class RuleModel:
    rules: list[tuple[tuple[Condition, ...], float]]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1 as a column over the statistics."""
        logit = reduce(lambda a, b: a + b, (F.when(holds(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules), F.lit(self.intercept))
        return 1 / (1 + F.exp(-logit))


def holds(rule: tuple[Condition, ...]) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule))


def tree_rules(debug_string: str, features: list[str]) -> list[tuple[Condition, ...]]:
    """Every path from a root to a node of the trees that MLlib prints, as a conjunction; repeats once."""
    rules, path = {}, []
    for line in debug_string.splitlines():
        if m := re.match(r"\s*(If|Else) \(feature (\d+) (<=|>) ([-\d.E]+)\)", line):
            if m[1] == "Else":
                while path and (path[-1].feature, path[-1].threshold, path[-1].above) != (features[int(m[2])], float(m[4]), False):
                    path.pop()
                path.pop()
            path.append(Condition(features[int(m[2])], m[3] == ">", float(m[4])))
            rules[tuple(sorted(set(path), key=lambda c: (c.feature, c.above, c.threshold)))] = True
        elif "Tree " in line:
            path = []
    return list(rules)


def fit(labelled: DataFrame, label_col: str, max_rows: int = MAX_TRAIN_ROWS, trees: int = 16, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleModel:
    """Fits a rule ensemble to rows with the FEATURES and a 0/1 label.

    Over max_rows rows a sample by hash of all columns of labelled is taken,
    so that the cost of fitting has a bound; an id among them thins out copies
    evenly, and no column but FEATURES is learned from. Nothing else here
    depends on the number of rows. Without both labels, or where no tree
    splits, the model is a constant: the smoothed share of label 1, 0.5 if
    there are no rows.
    """
    rows = labelled.select(*FEATURES, F.col(label_col).cast("double").alias("label"), F.xxhash64(*labelled.columns).alias("h")).where("label in (0, 1)")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    constant = RuleModel([], math.log((ones + 1) / (n - ones + 1)))
    if not 0 < ones < n:
        return constant
    if n > max_rows:
        rows = rows.where(F.pmod("h", F.lit(1 << 60)) < (max_rows << 60) // n)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).cache()
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", maxMemoryInMB=64).fit(rows)
    rules = tree_rules(forest.toDebugString, FEATURES)
    if not rules:  # no statistic tells the labels apart
        rows.unpersist()
        return constant
    hits = rows.select("label", *[holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    hits = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="hits").transform(hits).select("label", "hits").cache()
    lasso = LogisticRegression(featuresCol="hits", elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60).fit(hits)
    rows.unpersist()
    hits.unpersist()
    return RuleModel([(r, float(w)) for r, w in zip(rules, lasso.coefficients) if w], float(lasso.intercept))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumns(statistics(text_or_empty(text_col)))


def label_per_id(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(doc_id, label): several labels of one id count as their rounded mean; null labels don't count."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
    return known.agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))


def score_documents(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= 0.5).

    The statistics of each whole text are computed once and kept, without the
    text; labels join on them, and labels without a document don't count. A
    null text is empty, and an empty text has a score like any other. A null
    id has no label and is not held out. Other columns of docs are not read.
    """
    stats = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text"))
    stats = stash(with_statistics(stats).drop("text"), "statistics")
    model = fit(stats.where(~F.col("held_out")).join(label_per_id(labels, id_col, label_col), "doc_id"), "label")
    return stats.select("doc_id", "held_out", model.score().alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_accepted(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """The rows of docs that the model scores at 0.5 or more, unchanged; it learns from those that aren't held out.

    Rows that share an id go if the model rejects one of them; a row without
    an id stays.
    """
    scored = score_documents(docs, labels, held_out, id_col, label_col)
    rejected = scored.where("predicted = 0").select(F.col("doc_id").alias(id_col))
    return without_ids(docs, rejected, id_col)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_documents over documents and labels.quality."""
    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), bucket_of("doc_id", 3) == 1)
