"""Language identification by hierarchical discrimination.

The family of a text's language is predicted first, by one multinomial logistic model over all families; the languages of
that family are then told apart by one-versus-one linear support vector machines.  Families come from a table of languages
(``FAMILIES``, an argument); a language that it lacks is a family of its own.  Models are fitted by MLlib on the texts of a
sample of at most about ``SAMPLE`` rows, the same number for every language, chosen by the hash of their identifiers; every whole text
is scored.

Features are rates of hashed letter sequences: a word is a run of letters, lower-cased, with an edge before and after it; its sequences of
one to four letters or edges are counted, an array at a time.

The score is the family's probability times the mean over the family's machines of the winner of their logistic function of the margin (1 for
a family of one language).

Defined results: null texts and texts without a letter are ``und`` with score 0, as are all texts if nothing can be learned; with
one family only, its probability is 1; equal votes go to the larger sum of margins, then to the first name; equal texts get equal
predictions; a very long text is read whole, ``PIECE`` letters at a time; rows with a null or
repeated identifier are predicted, the former never learned; an empty table gives an empty result; further columns are ignored and may have any names.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefield.llm.common import new_folder, table

#: Most labelled rows that the models look at.
SAMPLE = 8_000
BITS = 14
#: Letters of a sequence at most, and letters that are hashed at once.
LETTERS = 4
PIECE = 1 << 18
UNKNOWN = "und"
_EDGE = 32
#: So few tasks add up a fit's gradients without a shuffle; the sample is bounded.
_FIT_TASKS = 4
#: Rates are multiplied by this, so that common letters have values of about one.
_UNIT = 32.0

# Families of languages by ISO 639 code.
FAMILIES = {
    "germanic": "da de en fy is nl no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "malayic": "id ms",
}


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents whose language is never learned; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def family_of(lang: str, families: dict[str, str] = FAMILIES) -> str:
    """The family's name; a language that no family lists is one of its own."""
    return next((name for name, members in families.items() if lang in members.split()), f"only:{lang}")


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def counts_of(text: str) -> np.ndarray:
    """How often each bucket's letter sequences are in the text; all zero without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    # Between words one edge is left, and one stands before the first and after the last.
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    words = np.where(letter, codes, np.uint32(_EDGE))[kept]
    words = np.concatenate(([_EDGE], words, [_EDGE] if len(words) and words[-1] != _EDGE else [])).astype(np.uint32)
    total = np.zeros(1 << BITS, np.int64)
    for lo in range(0, len(words), PIECE):
        piece = words[lo : lo + PIECE + LETTERS - 1]
        starts = min(PIECE, len(words) - lo)
        mixed = np.zeros(len(piece), np.uint32)
        inside = np.ones(len(piece), bool)
        edge = piece == _EDGE
        for n in range(1, LETTERS + 1):
            ends = len(piece) - n + 1
            if ends <= 0:
                break
            # A sequence may begin and end with an edge, but has none within.
            mixed = (mixed[:ends] ^ piece[n - 1 :]) * np.uint32(16777619)
            if n > 2:
                inside = inside[:ends] & ~edge[n - 2 : n - 2 + ends]
            good = inside[:ends] if n > 1 else ~edge
            spread = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
            total += np.bincount(spread[:starts][good[:starts]], minlength=1 << BITS)
    return total


@dataclass(frozen=True)
class LanguageModel:
    """Linear models as columns of ``weights``: first a column per family, then one per pair of languages of a family."""

    families: tuple[str, ...]
    languages: tuple[tuple[str, ...], ...]
    pairs: tuple[tuple[str, str], ...]
    weights: np.ndarray
    offsets: np.ndarray

    def predict(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Languages and scores of rows of linear sums."""
        n = len(sums)
        own = sums[:, : len(self.families)]
        share = np.exp(own - own.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        family, lang, score = share.argmax(axis=1), np.empty(n, object), share.max(axis=1)
        for f, members in enumerate(self.languages):
            rows = np.flatnonzero(family == f)
            if len(members) == 1 or not len(rows):
                lang[rows] = members[0]
                continue
            votes, margins, sure = (np.zeros((len(rows), len(members))) for _ in range(3))
            for k, (a, b) in enumerate(self.pairs, len(self.families)):
                if a in members:
                    margin, i, j = sums[rows, k], members.index(a), members.index(b)
                    for at, m in ((i, margin), (j, -margin)):
                        votes[:, at] += m > 0
                        margins[:, at] += m
                        sure[:, at] += 0.5 * (1 + np.tanh(0.5 * m))
            # Most votes, then the larger sum of margins, then the first name.
            best = np.array([max(range(len(members)), key=lambda i: (v[i], m[i], -i)) for v, m in zip(votes, margins)])
            lang[rows] = np.array(members, object)[best]
            score[rows] *= sure[np.arange(len(rows)), best] / (len(members) - 1)
        return lang, score.clip(0.0, 1.0)


def sums_of(text: str, model: LanguageModel) -> np.ndarray:
    """The linear sums of a text."""
    counts = counts_of(text)
    return (counts @ model.weights) * (_UNIT / max(int(counts.sum()), 1)) + model.offsets


def _sample(docs: DataFrame, most: int) -> DataFrame:
    """Texts and languages of about ``most`` rows that may be learned from, spread evenly over the languages."""
    known = docs.filter("doc_id is not null and lang is not null and text is not null").filter(~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    # The languages of a corpus are few; at most ``most`` of them can have a row.
    counts = counts.orderBy(F.desc("rows"), "lang").limit(most)
    each = counts.agg(F.floor(F.lit(most) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("each"))
    top = 1 << 30
    bounds = counts.join(F.broadcast(each)).select(
        F.col("lang").alias("_lang"), (F.least(F.lit(1.0), F.col("each") / F.col("rows")) * top).cast("bigint").alias("_bound"))
    draw = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(top))
    return known.join(F.broadcast(bounds), F.col("lang") == F.col("_lang")).filter(draw < F.col("_bound")).select("lang", "text")


def _features(sample: DataFrame) -> DataFrame:
    """``lang, index, value`` of every text of the sample that has a letter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            index, value = [], []
            for text in batch["text"]:
                counts = counts_of(text)
                at = np.flatnonzero(counts)
                index.append(at.astype(np.int32))
                value.append(counts[at] * (_UNIT / max(int(counts.sum()), 1)))
            yield pd.DataFrame({"lang": batch["lang"], "index": index, "value": value})

    return sample.mapInPandas(run, "lang string, index array<int>, value array<double>").filter(F.size("index") > 0)


def train(docs: DataFrame, sample: int = SAMPLE, families: dict[str, str] = FAMILIES, iterations: int = 30, penalty: float = 1e-5) -> LanguageModel | None:
    """Models of the languages of ``docs`` (``doc_id, text, lang``); None if nothing can be learned."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    at = new_folder(spark, "language-features")
    _features(_sample(texts, sample)).write.parquet(at)
    rows = spark.read.parquet(at)
    seen = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not seen:
        return None
    names = sorted({family_of(lang, families) for lang in seen})
    members = tuple(tuple(lang for lang in seen if family_of(lang, families) == name) for name in names)
    vector = F.udf(lambda i, v: Vectors.sparse(1 << BITS, i, v), VectorUDT())
    places = F.create_map(*(F.lit(x) for f, group in enumerate(members) for lang in group for x in (lang, float(f))))
    rows = rows.select("lang", places[F.col("lang")].alias("family"), vector("index", "value").alias("features")).coalesce(_FIT_TASKS).persist()
    pairs = tuple(p for group in members for p in itertools.combinations(group, 2))
    weights = np.zeros((1 << BITS, len(names) + len(pairs)))
    offsets = np.zeros(len(names) + len(pairs))
    try:
        if len(names) > 1:
            fitted = LogisticRegression(
                labelCol="family", family="multinomial", regParam=penalty, standardization=False, maxIter=iterations).fit(rows)
            weights[:, : len(names)] = fitted.coefficientMatrix.toArray().T
            offsets[: len(names)] = fitted.interceptVector.toArray()
        for k, (a, b) in enumerate(pairs, len(names)):
            two = rows.filter(F.col("lang").isin(a, b)).select((F.col("lang") == a).cast("double").alias("label"), "features")
            machine = LinearSVC(regParam=penalty, standardization=False, maxIter=iterations).fit(two)
            weights[:, k], offsets[k] = machine.coefficients.toArray(), machine.intercept
    finally:
        rows.unpersist()
    return LanguageModel(tuple(names), members, pairs, weights, offsets)


def predict(text: Column, model: LanguageModel | None) -> Column:
    """A struct of ``lang`` and ``score`` for a column of texts."""

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lang, score = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            rows = [i for i, t in enumerate(batch) if model is not None and has_letter(t)]
            if rows:
                lang[rows], score[rows] = model.predict(np.stack([sums_of(batch.iloc[i], model) for i in rows]))
            yield pd.DataFrame({"lang": lang, "score": score})

    return run(text.cast("string"))


def identify(docs: DataFrame, sample: int = SAMPLE, families: dict[str, str] = FAMILIES) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs`` (``doc_id, text, lang``)."""
    model = train(docs, sample, families)
    found = docs.select("doc_id", predict(F.col("text"), model).alias("found"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: ``doc_id, held_out, lang_pred, score``."""
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
