"""Toxicity by weak supervision.

Voters fire on a text or not: given word lists, lists of words found in the labelled sample, patterns.  The given
label is one more, noisy, voter.  A
generative model of the votes has a hidden class; every voter has rates of firing in each class, given
the vote of the one voter it depends on most (a tree of dependences by class-conditional mutual information, so
correlated voters are not counted twice).  The rates of the label have a prior of a few votes (``LABEL_WEIGHT``) that it is rarely
wrong, which says which class is which; the other votes can move them.  Expectation-maximisation, begun at the
label, fits rates, tree and class share.
A linear classifier over hashed text features is then trained on the posterior labels; it alone gives the
score, so a score depends on nothing but the text.

The label model and the classifier are fitted on a bounded sample of labelled rows (``SAMPLE``) whose labels may be learned;
every whole text is scored.

Defined results: null text is empty and scores by the intercept; labels that are null or have a null id
are not learned; several labels of a document count as toxic if one is; with no labelled rows every score is 0;
repeated rows score alike; an empty table gives an empty result.  Texts of any length are scored whole, as one value of
a batch.  Equally strong features are taken in the order of their buckets, and a score equal to the threshold counts as toxic.  Further
columns of any name and type stay as they are and never leave the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodefield.llm.common import held_out, private, table
from lodefield.llm.text_features import Association, Sampled, Selected, bounded_sample, core_of, descend, gather, linear_scores, sigmoid

#: Most labelled rows that a fit looks at.
SAMPLE = 8_000

# Word lists of the voters.
LEXICONS = {
    "stupidity": "idiot idiots idiotic moron morons stupid imbecile imbeciles dumb fool fools dimwit halfwit cretin dolt",
    "worth": "loser losers worthless pathetic useless nobody failure deadbeat lowlife",
    "disgust": "disgusting vile filthy revolting repulsive nasty gross sickening",
    "contempt": "trash scum garbage vermin filth rat rats pig pigs parasite parasites maggot",
    "mockery": "clown clowns joke buffoon jackass freak freaks weirdo creep",
    "abuse": "bastard bastards bitch asshole jerk crap damn shit fuck fucking hate",
    "german": "idioten dumm dummkopf trottel abschaum versager wertlos ekelhaft arschloch schwein",
    "french": "imbécile imbéciles crétin ordure ordures minable dégoûtant débile connard salaud",
    "spanish": "idiota idiotas imbécil imbéciles estúpido basura asqueroso inútil cabrón mierda",
}
_ALL = frozenset(" ".join(LEXICONS.values()).split())
_LISTS = {name: frozenset(words.split()) for name, words in LEXICONS.items()}
_ADDRESS = re.compile(r"\b(?:you(?:'re| are)?|your|du bist|tu es|vous êtes|eres)\s+(?:an?\s+|the\s+|such\s+)*(\w+)", re.IGNORECASE)
_DIRECT = re.compile(r"\b(\w+)[!]+", re.IGNORECASE)
#: What is held of the given label, the first voter, beforehand: its rate of firing in each class.
LABEL_RATE = (0.001, 0.98)
#: Votes in each class that this is worth, whatever the size of the sample.
LABEL_WEIGHT = 20
#: Lists into which learned words are dealt; each is a voter.
LEARNED = 6
_CLASS_STEPS = 60


def votes_of(text: str | None) -> list[int]:
    """1 for every voter that fires: the lists, then repeated hits, different hits, a hit per few words, address and shouting."""
    text = text or ""
    words = [core_of(w) for w in text.split()]
    hits = [w for w in words if w in _ALL]
    out = [int(any(w in words_of for w in hits)) for words_of in _LISTS.values()]
    out += [int(len(hits) >= 2), int(len(set(hits)) >= 2), int(len(hits) * 100 >= len(words) > 0)]
    out.append(int(any(m[1].lower() in _ALL for m in _ADDRESS.finditer(text))))
    out.append(int(any(m[1].lower() in _ALL for m in _DIRECT.finditer(text))))
    return out


def learned_votes(rows: list[Sampled], given: np.ndarray) -> np.ndarray:
    """Votes of word lists found in the sample: words and beginnings of words that toxic texts hold and others hardly do."""
    found = Association(rows, given.astype(float))
    pure = (found.count >= 4) & (found.z >= 6) & (found.hit >= 0.9 * found.count)
    out = np.zeros((len(rows), LEARNED + 1), int)
    for r, row in enumerate(rows):
        hits = row.index[pure[row.index]]
        out[r, hits % LEARNED] = 1
        out[r, LEARNED] = len(hits) >= 2
    return out


@dataclass(frozen=True)
class LabelModel:
    share: float  # of the positive class
    parent: tuple[int, ...]  # the voter that each voter depends on, or -1
    rate: np.ndarray  # [class, vote of the parent, voter]: chance to fire

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(class 1 | votes) of each row."""
        total = np.tile(np.log([1 - self.share, self.share]), (len(votes), 1))
        for j, p in enumerate(self.parent):
            given = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
            for y in (0, 1):
                r = self.rate[y][given, j]
                total[:, y] += np.where(votes[:, j] == 1, np.log(r), np.log(1 - r))
        return sigmoid(total[:, 1] - total[:, 0])

    def accuracy(self) -> np.ndarray:
        """Chance of every voter to be right, both classes weighing alike (parents not firing)."""
        return 0.5 * (self.rate[1][0] + 1 - self.rate[0][0])


def _tree(votes: np.ndarray, post: np.ndarray) -> tuple[int, ...]:
    """The spanning tree of greatest mutual information given the class; weak links are left out."""
    j = votes.shape[1]
    info = np.zeros((j, j))
    for weight in (1 - post, post):
        w = weight / max(len(post), 1)
        share = w.sum()
        if share <= 0:
            continue
        both = (votes * w[:, None]).T @ votes / share
        one = np.diag(both)
        p11, p10, p01 = both, one[:, None] - both, one[None, :] - both
        p00 = 1 - p11 - p10 - p01
        for p, a, b in ((p11, one, one), (p10, one, 1 - one), (p01, 1 - one, one), (p00, 1 - one, 1 - one)):
            base = np.outer(a, b)
            ok = (p > 1e-12) & (base > 1e-12)
            info += share * np.where(ok, p * np.log(np.where(ok, p, 1) / np.where(ok, base, 1)), 0)
    parent = [-1] * j
    inside, best = {0}, info[0].copy()
    link = np.zeros(j, int)
    while len(inside) < j:
        rest = [k for k in range(j) if k not in inside]
        k = max(rest, key=lambda r: (best[r], -r))
        parent[k] = int(link[k]) if best[k] > 1e-3 else -1
        inside.add(k)
        closer = info[k] > best
        best, link = np.where(closer, info[k], best), np.where(closer, k, link)
    return tuple(parent)


def fit_label_model(votes: np.ndarray, first: np.ndarray, steps: int = _CLASS_STEPS) -> LabelModel:
    """Expectation-maximisation from the posteriors ``first``; rates are smoothed by half a vote."""
    post = first.astype(float)
    model = None
    for step in range(steps):
        parent = _tree(votes, post) if step % 10 == 0 or model is None else model.parent
        rate = np.empty((2, 2, votes.shape[1]))
        for y, weight in enumerate((1 - post, post)):
            for j, p in enumerate(parent):
                for g in (0, 1):
                    w = weight * (votes[:, p] == g) if p >= 0 else weight
                    rate[y, g, j] = ((w * votes[:, j]).sum() + 0.5) / (w.sum() + 1.0)
            rate[y, :, 0] = (weight @ votes[:, 0] + LABEL_RATE[y] * LABEL_WEIGHT) / (weight.sum() + LABEL_WEIGHT)
        model = LabelModel(float((post.sum() + 1) / (len(post) + 2)), parent, rate)
        post = model.posterior(votes)
    return model


def fit_linear(x: np.ndarray, target: np.ndarray, penalty: float = 0.01) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, both classes weighing alike; a light L2 penalty, so that one sure word is enough."""
    some = x.any(axis=1)
    # Rows without any of the features differ in nothing, so they are one weighted row.
    n, bare = len(x), int((~some).sum())
    weight = np.ones(int(some.sum()) + (bare > 0))
    y = target[some]
    if bare:
        weight[-1], y = bare, np.append(y, target[~some].mean())
    p = x.shape[1]
    x = np.vstack([x[some], np.zeros((int(bare > 0), p))]).astype(np.float32)
    share = float(target.mean().clip(1e-4, 1 - 1e-4))
    weight *= 0.5 * (y / share + (1 - y) / (1 - share))

    def slope(v):
        miss = weight * (sigmoid(x @ v[:p].astype(np.float32) + v[p]) - y)
        return np.concatenate((miss.astype(np.float32) @ x + penalty * v[:p], [miss.sum()])) / n

    v = descend(slope, np.zeros(p + 1), steps=600, rate=0.2)
    return v[:p], float(v[p])


@dataclass(frozen=True)
class ToxicityModel:
    buckets: np.ndarray
    weights: np.ndarray
    intercept: float
    label_model: LabelModel | None


def learnable(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic`` of the labels that may be learned."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    return known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Fit on at most about ``sample`` of the documents with learnable labels (``doc_id, toxic``)."""
    rows = gather(bounded_sample(labels, docs, sample), "toxic", votes_of)
    if not rows:
        return ToxicityModel(np.empty(0, np.int64), np.empty(0), -50.0, None)
    given = np.array([r.label for r in rows], int)
    fixed, learned = np.array([r.votes for r in rows], int), learned_votes(rows, given)
    listed = fixed[:, : len(LEXICONS)].any(axis=1) | learned.any(axis=1)
    votes = np.column_stack((given, listed, fixed, learned)).astype(int)
    model = fit_label_model(votes, np.where(given == 1, 0.95, 0.02))
    post = model.posterior(votes)
    chosen = Selected(rows, post, most=512, least_z=6.0)
    weights, intercept = fit_linear(chosen.dense(rows), post)
    return ToxicityModel(chosen.buckets, weights * chosen.scale, intercept, model)


def score(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 in ``name``."""
    raw = linear_scores(docs, model.buckets, model.weights, name)
    return raw.withColumn(name, 1.0 / (1.0 + F.exp(-(F.col(name) + F.lit(float(model.intercept))))))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, with its columns, that score below ``threshold``."""
    model = train(docs, learnable(labels), sample)
    name = private(docs, "_toxicity")
    return score(docs, model, name).filter(F.col(name) < threshold).drop(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, learnable(table(spark, sf_dir, "labels")))
    scored = score(docs, model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
