"""Ordinal quality model: cumulative links over hashed text.

P(grade <= k) = sigmoid(threshold_k - s), where s is one weighted sum of hashed text features shared by all grades
and the thresholds are ordered (each is the one before plus a positive step).  The fit
gives for every text its expected grade and the probability of reaching a grade.

The model is fitted on a bounded sample of graded rows (``SAMPLE``); every whole text is scored.

Defined results: null text is empty and scores by the thresholds alone; labels with a null part or id are not learned;
several labels of a document are joined to the lowest; with no graded rows, or one grade only, every text has
the expected grade that the rows have (the highest when there are none); repeated rows score alike; an empty
table gives an empty result.  Texts of any length are scored whole, as one value of a batch.  Equally strong features are taken in the
order of their buckets, and a probability equal to the threshold is enough.  Further columns of any name and type stay as they are
and never leave the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefield.llm.common import held_out, private, table
from lodefield.llm.text_features import Selected, bounded_sample, descend, gather, linear_scores, sigmoid

#: Most labelled rows that a fit looks at.
SAMPLE = 8_000
GRADES = 3


@dataclass(frozen=True)
class OrdinalModel:
    buckets: np.ndarray
    weights: np.ndarray
    thresholds: tuple[float, ...]

    def reach(self, score: Column, grade: int) -> Column:
        """P(grade of the text >= ``grade``)."""
        if grade <= 0:
            return F.lit(1.0)
        return 1.0 / (1.0 + F.exp(F.lit(float(self.thresholds[grade - 1])) - score))

    def expected(self, score: Column) -> Column:
        return sum((self.reach(score, k) for k in range(1, len(self.thresholds) + 1)), F.lit(0.0))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, penalty: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by maximum likelihood with an L2 penalty on the weights."""
    n, p = x.shape
    x = x.astype(np.float32)
    share = np.array([(grade < k).mean() for k in range(1, grades)]).clip(1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    steps = np.log(np.maximum(np.diff(first), 0.05))

    def unpack(v):
        t = np.cumsum(np.concatenate(([v[p]], np.exp(v[p + 1 :]))))
        return v[:p], t

    def slope(v):
        w, t = unpack(v)
        s = x @ w.astype(np.float32)
        edges = np.concatenate(([-np.inf], t, [np.inf]))
        hi, lo = sigmoid(edges[grade + 1] - s), sigmoid(edges[grade] - s)
        prob = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / prob, lo * (1 - lo) / prob
        g_t = np.array([-(d_hi * (grade == k)).sum() + (d_lo * (grade == k + 1)).sum() for k in range(grades - 1)])
        later = np.cumsum(g_t[::-1])[::-1]
        g_w = (d_hi - d_lo).astype(np.float32) @ x + penalty * w
        g = np.concatenate((g_w, [later[0]], later[1:] * np.exp(v[p + 1 :])))
        return g / n

    return unpack(descend(slope, np.concatenate((np.zeros(p), [first[0]], steps))))


def train(docs: DataFrame, graded: DataFrame, grades: int = GRADES, sample: int = SAMPLE) -> OrdinalModel:
    """Fit on the texts of ``graded`` (``doc_id``, ``grade`` from 0 to ``grades - 1``), at most about ``sample`` rows."""
    rows = gather(bounded_sample(graded.select("doc_id", "grade"), docs, sample), "grade")
    grade = np.array([r.label for r in rows], int)
    if len(set(grade.tolist())) < 2:
        only = int(grade[0]) if len(grade) else grades - 1
        flat = tuple(-50.0 if k <= only else 50.0 for k in range(1, grades))
        return OrdinalModel(np.empty(0, np.int64), np.empty(0), flat)
    chosen = Selected(rows, grade.astype(float))
    weights, thresholds = fit_ordinal(chosen.dense(rows), grade, grades)
    return OrdinalModel(chosen.buckets, weights * chosen.scale, tuple(float(t) for t in thresholds))


def grades_of(labels: DataFrame) -> DataFrame:
    """Grades from the labels that may be learned: 0 poor, 1 good but toxic, 2 good; ``doc_id, grade``."""
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min(grade).alias("grade"))


def grade(docs: DataFrame, labels: DataFrame, least: int = 1, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, expected_grade, reaches``, the last being P(grade >= ``least``)."""
    model = train(docs, grades_of(labels), sample=sample)
    scored = linear_scores(docs.select("doc_id", "text"), model.buckets, model.weights)
    return scored.select("doc_id", model.expected(F.col("score")).alias("expected_grade"), model.reach(F.col("score"), least).alias("reaches"))


def keep_good(docs: DataFrame, labels: DataFrame, least: int = 1, probability: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, with its columns, whose text reaches grade ``least`` with at least ``probability``."""
    model = train(docs, grades_of(labels), sample=sample)
    name = private(docs, "_quality")
    scored = linear_scores(docs, model.buckets, model.weights, name)
    return scored.filter(model.reach(F.col(name), least) >= probability).drop(name)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: ``doc_id, held_out, expected_grade, p_good, selected`` (P(grade >= 1) is at least 1/2)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = grade(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", F.col("reaches").alias("p_good"),
        (F.col("reaches") >= 0.5).alias("selected"))
