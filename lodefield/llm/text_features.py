"""Hashed features of whole texts for linear classifiers.

Two kinds share one hashed space: the presence of words (lower-cased, without punctuation at their ends) and
of their beginnings of four to six letters, and rates of word forms: what the word ends in, how it is capitalised,
whether it is bare punctuation, whether it repeats the word before.  Rates are shares of the words of the text,
so they do not grow with its length.  Nothing but the text is looked at.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 20
_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
BEGINNINGS = (4, 5, 6)
_CACHE_ROWS = 300_000
_REPEAT = crc32(b"form:repeat") & ((1 << BITS) - 1)


def _bucket(name: str) -> int:
    return crc32(name.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def core_of(word: str) -> str:
    return word.strip(_PUNCTUATION).lower()


def _word(word: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Buckets of the word and its beginnings, and buckets of its forms."""
    core = core_of(word)
    end = word[len(word.rstrip(_PUNCTUATION)):]
    if not core:
        return (), (_bucket(f"form:bare:{word[:4]}"),)
    forms = []
    if len(end) > 1:
        forms.append(_bucket(f"form:end:{end[:4]}"))
    if len(core) > 1 and word.isupper():
        forms.append(_bucket("form:upper"))
    return (_bucket(f"word:{core}"), *(_bucket(f"begin:{core[:n]}") for n in BEGINNINGS if n < len(core))), tuple(forms)


class Features:
    """``Features()(text)`` gives sorted distinct buckets and their values; ``wanted`` leaves the others out."""

    def __init__(self, wanted: np.ndarray | None = None) -> None:
        self._wanted = None if wanted is None else frozenset(wanted.tolist())
        self._seen: dict[str, tuple[tuple[int, ...], tuple[int, ...]]] = {}

    def _look_up(self, word: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
        found = _word(word)
        if self._wanted is not None:
            found = tuple(tuple(b for b in part if b in self._wanted) for part in found)
        if len(self._seen) >= _CACHE_ROWS:
            self._seen.clear()
        self._seen[word] = found
        return found

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.float32)
        seen, present, rates = self._seen, set(), Counter()
        for word, n in Counter(words).items():
            buckets, forms = seen.get(word) or self._look_up(word)
            if buckets:
                present.update(buckets)
            for form in forms:
                rates[form] += n
        if self._wanted is None or _REPEAT in self._wanted:
            rates[_REPEAT] += sum(map(operator.eq, words, words[1:]))
        values = dict.fromkeys(present, 1.0)
        values.update((k, n / len(words)) for k, n in rates.items() if n)
        index = np.fromiter(values, np.int32, len(values))
        order = np.argsort(index)
        return index[order], np.fromiter(values.values(), np.float32, len(values))[order]


def bounded_sample(labels: DataFrame, docs: DataFrame, rows: int, seed: int = 7) -> DataFrame:
    """Texts of about ``rows`` labelled documents at most, chosen by the hash of their ids.

    ``labels`` has a row per ``doc_id``; the result has its columns and ``text``.  The ids, bounded in number, are
    joined to the documents, so that only the chosen texts move.
    """
    total = labels.count()
    top = 1 << 30
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(top))
    chosen = labels.filter(draw < int(top * min(1.0, rows / max(total, 1)))).select(
        F.col("doc_id").alias("_id"), *[c for c in labels.columns if c != "doc_id"])
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).drop("_id")


@dataclass
class Sampled:
    """A labelled text of the sample: its label, votes and features."""

    label: int
    votes: list[int]
    index: np.ndarray
    value: np.ndarray


def gather(sample: DataFrame, label: str, votes: Callable[[str | None], list[int]] | None = None) -> list[Sampled]:
    """Features of a bounded sample, in an order that does not depend on partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for batch in batches:
            rows = [(i, y, features(t), votes(t) if votes else []) for i, y, t in zip(batch["doc_id"], batch[label], batch["text"])]
            yield pd.DataFrame({
                "doc_id": [r[0] for r in rows], "label": [r[1] for r in rows], "votes": [bytes(r[3]) for r in rows],
                "index": [r[2][0].tobytes() for r in rows], "value": [r[2][1].tobytes() for r in rows]})

    rows = sample.select("doc_id", label, "text").mapInPandas(run, "doc_id bigint, label int, votes binary, index binary, value binary")
    found = sorted(rows.toLocalIterator(), key=lambda r: (r["doc_id"], r["label"], bytes(r["index"])))
    return [Sampled(r["label"], list(r["votes"]), np.frombuffer(r["index"], np.int32), np.frombuffer(r["value"], np.float32)) for r in found]


class Association:
    """How the values of every bucket go with a target over the sample."""

    def __init__(self, rows: list[Sampled], target: np.ndarray) -> None:
        n, space = max(len(rows), 1), 1 << BITS
        self.count = np.zeros(space, np.int32)
        s1, s2, st, self.hit = (np.zeros(space) for _ in range(4))
        mean = target.mean() if len(rows) else 0.0
        for row, t in zip(rows, target):
            self.count[row.index] += 1
            s1[row.index] += row.value
            s2[row.index] += row.value * row.value
            st[row.index] += row.value * (t - mean)
            self.hit[row.index] += t
        spread = np.maximum(s2 - s1 * s1 / n, 0) * float(((target - mean) ** 2).sum())
        #: Correlation in standard errors.
        self.z = np.where(spread > 1e-12, st / np.sqrt(np.maximum(spread, 1e-12)), 0) * np.sqrt(n)


class Selected:
    """The buckets that tell most about a target, and dense rows over them."""

    def __init__(self, rows: list[Sampled], target: np.ndarray, most: int = 512, least_z: float = 4.0, least_rows: int = 4) -> None:
        """Keep at most ``most`` buckets whose values correlate with ``target`` by ``least_z`` standard errors."""
        found = Association(rows, target)
        z = np.where(found.count >= least_rows, np.abs(found.z), 0)
        best = np.argsort(-z, kind="stable")[:most]
        self.buckets = np.sort(best[z[best] >= least_z])
        self.scale = np.ones(len(self.buckets))
        x = self.dense(rows)
        top = np.abs(x).max(axis=0) if len(rows) and len(self.buckets) else np.ones(len(self.buckets))
        self.scale = np.where(top > 0, 1 / np.maximum(top, 1e-9), 1.0)

    def dense(self, rows: list[Sampled]) -> np.ndarray:
        out = np.zeros((len(rows), len(self.buckets)))
        if len(self.buckets):
            for r, row in enumerate(rows):
                at = np.minimum(np.searchsorted(self.buckets, row.index), len(self.buckets) - 1)
                hit = self.buckets[at] == row.index
                out[r, at[hit]] = row.value[hit]
        return out * self.scale


def linear_scores(docs: DataFrame, buckets: np.ndarray, weights: np.ndarray, name: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with ``name``, the sum of weights times values, for every row.  Only the text goes to Python."""

    @F.pandas_udf("double")
    def scores_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features(buckets)
        for batch in batches:
            scores = np.zeros(len(batch))
            for r, text in enumerate(batch):
                index, value = features(text)
                if len(buckets) and len(index):
                    at = np.minimum(np.searchsorted(buckets, index), len(buckets) - 1)
                    hit = buckets[at] == index
                    scores[r] = float(value[hit] @ weights[at[hit]])
            yield pd.Series(scores)

    return docs.withColumn(name, scores_of(F.col(text_col).cast("string")))


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x, float)))


def descend(slope, start: np.ndarray, steps: int = 400, rate: float = 0.1) -> np.ndarray:
    """Adam on the whole sample with a falling rate; deterministic."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for k in range(1, steps + 1):
        g = slope(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (1 - k / (steps + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return x
