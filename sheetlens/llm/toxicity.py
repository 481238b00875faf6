"""Toxicity by weak supervision.

Many voters look at a document: buckets of words and of word beginnings that stand out in
labelled toxic documents, a fixed lexicon, a few patterns, and the annotator's label. A
generative label model, a tree-augmented mixture fitted by expectation maximisation,
estimates each voter's accuracy (how often it fires on toxic and on clean documents) and the
correlations between voters (each voter but the root depends on one other, chosen by
conditional mutual information). Its posterior labels train a linear classifier, which alone
scores documents. Language, source and id are never looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import accumulate
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WORD_BYTES, in_parts, saved

# Common English insults, as a lexicon voter.
LEXICON = (
    "idiot", "moron", "loser", "stupid", "scum", "trash", "pathetic", "worthless", "disgusting", "clown",
    "dumb", "fool", "imbecile", "bastard", "jerk", "vermin", "filth", "garbage", "creep", "coward",
)
_SHOUTING = re.compile(r"\b[A-Z]{3,}\b")
_SYMBOLS = re.compile(r"[*#$%&!]{2,}")
_SECOND_PERSON = re.compile(r"\b(?:you|your|youre)\b", re.IGNORECASE)
PATTERNS = ("shouting", "symbols", "second_person", "short")
BEGINNINGS = (4, 5, 6, 7, 8)
#: Words of a window; how dense found words stand is looked at in the densest window.
WINDOW = 100


def _words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(WORD_BYTES).split()


def _features(words: set[bytes]) -> set[bytes]:
    """``=word`` for each word, and its beginnings of a few lengths in bytes."""
    out = {b"=" + w for w in words}
    for k in BEGINNINGS:
        out.update(w[:k] for w in words if len(w) > k)
    return out


def _densest(words: list[bytes], found: dict[bytes, list[bytes]]) -> int:
    """The most found words in any ``WINDOW`` words in a row."""
    if not found:
        return 0
    before = [0, *accumulate(w in found for w in words)]
    if len(words) <= WINDOW:
        return before[-1]
    return max(b - a for a, b in zip(before, before[WINDOW:]))


def _patterns(text: str, n_words: int) -> list[float]:
    n = max(1, n_words)
    return [
        float(len(_SHOUTING.findall(text)) > 0.3 * n), float(len(_SYMBOLS.findall(text)) > 0.3 * n),
        float(_SECOND_PERSON.search(text) is not None), float(n_words < 40)]


@dataclass
class LabelModel:
    """Binary voters given a binary class; each voter but the root also has a parent voter.

    ``rate[y][j][p]`` is the chance that voter j fires when the class is y and its parent's
    vote is p (for the root both are equal).
    """

    prior: float = 0.5
    parent: list[int] = field(default_factory=list)
    rate: np.ndarray = field(default_factory=lambda: np.zeros((2, 0, 2)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logit = np.full(len(votes), np.log(self.prior) - np.log1p(-self.prior))
        for j, p in enumerate(self.parent):
            given = votes[:, p].astype(int) if p >= 0 else np.zeros(len(votes), int)
            a, b = self.rate[1, j][given], self.rate[0, j][given]
            v = votes[:, j] > 0
            logit += np.where(v, np.log(a) - np.log(b), np.log1p(-a) - np.log1p(-b))
        return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))

    def accuracies(self, votes: np.ndarray, post: np.ndarray) -> np.ndarray:
        """How often each voter agrees with the class."""
        return (post[:, None] * votes + (1 - post)[:, None] * (1 - votes)).mean(0)

    @classmethod
    def fit(cls, votes: np.ndarray, start: np.ndarray, steps: int = 40, smooth: float = 0.5) -> LabelModel:
        """``votes``: rows by voters, 0 or 1; ``start``: first guess of the posterior."""
        n, m = votes.shape
        model, post = cls(0.5, [-1] * m, np.full((2, m, 2), 0.5)), start
        for step in range(steps):
            if step in (3, 10, 20):
                model.parent = _tree(votes, post)
            model.prior = float(np.clip(post.mean(), 1e-3, 1 - 1e-3))
            for y, w in enumerate((1 - post, post)):
                for j, p in enumerate(model.parent):
                    for given in (0, 1):
                        use = w * (votes[:, p] == given) if p >= 0 else w
                        base = (w @ votes[:, j] + smooth) / (w.sum() + 2 * smooth)
                        model.rate[y, j, given] = np.clip((use @ votes[:, j] + 4 * smooth * base) / (use.sum() + 4 * smooth), 1e-4, 1 - 1e-4)
            post = model.posterior(votes)
        return model


def _tree(votes: np.ndarray, post: np.ndarray) -> list[int]:
    """Maximum spanning tree over the voters by mutual information given the class."""
    n, m = votes.shape
    info = np.zeros((m, m))
    for w in (1 - post, post):
        total = max(w.sum(), 1e-9)
        one = (w @ votes) / total
        both = (votes * w[:, None]).T @ votes / total
        for a in (0, 1):
            for b in (0, 1):
                pa_, pb = one if a else 1 - one, one if b else 1 - one
                joint = both if a and b else (one[:, None] - both if a else one[None, :] - both if b else 1 - one[:, None] - one[None, :] + both)
                joint = np.clip(joint, 0, 1)
                ratio = np.where(joint > 1e-12, joint / np.maximum(np.outer(pa_, pb), 1e-12), 1.0)
                info += total / n * joint * np.log(np.maximum(ratio, 1e-12))
    parent, inside = [-1] * m, np.zeros(m, bool)
    best, via = np.full(m, -np.inf), np.full(m, -1)
    at = 0
    for _ in range(m - 1):
        inside[at] = True
        better = (info[at] > best) & ~inside
        best[better], via[better] = info[at][better], at
        at = int(np.argmax(np.where(inside, -np.inf, best)))
        parent[at] = int(via[at])
    return parent


#: Lower edges of the strata of the likelihood-ratio statistic.
STRATA = (12.0, 18.0, 30.0, 60.0)
GROUPS = 2 * len(STRATA)


def _group(feature: bytes, g: float) -> int:
    """Words and beginnings of words have strata of their own."""
    return sum(g >= e for e in STRATA) - 1 + len(STRATA) * (feature[:1] != b"=")


@dataclass
class ToxicityModel:
    """Mined features, each in a group by kind and strength, and linear weights over the groups' hits and the patterns."""

    features: dict[bytes, int]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 * GROUPS + 4 + len(PATTERNS)))
    bias: float = -35.0
    label_model: LabelModel = field(default_factory=LabelModel)
    accuracies: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trained_on: int = 0
    moved: tuple[int, int] = (0, 0)  # rows labelled toxic that the posterior calls clean, and the other way round

    def __post_init__(self):
        self.words = {f[1:] for f in self.features if f[:1] == b"="}
        self.lengths = sorted({len(f) for f in self.features if f[:1] != b"="})
        self.first = {f[: self.lengths[0]] for f in self.features if f[:1] != b"="} if self.lengths else set()

    def present(self, words: set[bytes]) -> dict[bytes, list[bytes]]:
        """The mined features of each word that has any."""
        out = {w: [b"=" + w] for w in self.words & words}
        if self.lengths:
            k = self.lengths[0]
            for w in words:
                if w[:k] in self.first:
                    if found := [w[:n] for n in self.lengths if len(w) > n and w[:n] in self.features]:
                        out.setdefault(w, []).extend(found)
        return out

    def vector(self, text: str | None) -> tuple[list[bytes], list[float]]:
        """The features present, in order; and the numbers that the linear classifier weighs.

        Per group whether a word has its strongest feature there and the log of how many do;
        how many distinct words have any; how dense they stand in the densest window, so that
        a long clean remainder takes nothing away; the patterns.
        """
        words = _words(text or "")
        found = self.present(set(words))
        n = np.zeros(GROUPS)
        for features in found.values():
            n[max((self.features[f] for f in features), key=lambda g: (g % len(STRATA), -g))] += 1
        k = len(found)
        dense = float(np.log((_densest(words, found) + 0.1) / (min(len(words), WINDOW) + 50)))
        x = [*np.log1p(n).tolist(), *(n > 0).astype(float).tolist(), float(np.log1p(k)), float(k >= 2), float(k >= 3), dense]
        return sorted({f for features in found.values() for f in features}), x + _patterns(text or "", len(words))

    def score(self, text: str | None) -> float:
        z = self.bias + float(self.weights @ self.vector(text)[1])
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def training_sample(docs: DataFrame, labels: DataFrame, usable: Column, toxic_rows: int, clean_rows: int) -> DataFrame:
    """(text, toxic, fold) of a bounded number of labelled documents, chosen by a hash of the id.

    A document labelled more than once counts as toxic if any label says so. Ids are ranked
    without their texts; the chosen ones, a bounded number, fetch texts by a broadcast join.
    Of rows that share an id the one with the smallest hash of its text is taken, so the rows
    are no more than the ids.
    """
    known = (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).filter(usable)
             .groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    order = (F.xxhash64("_id"), F.col("_id"))
    chosen = (known.filter("toxic = 1").orderBy(*order).limit(toxic_rows)
              .unionByName(known.filter("toxic = 0").orderBy(*order).limit(clean_rows)))
    text = F.col("text").cast("string")
    return (docs.select(F.col("doc_id"), F.struct(F.xxhash64(text).alias("hash"), text.alias("text")).alias("_t"))
            .join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
            .groupBy("_id", "toxic").agg(F.min("_t").alias("_t"))
            .select("_t.text", "toxic", (F.xxhash64("_id", F.lit("fold")) % 2 == 0).cast("int").alias("fold")))


def _counted(sample: DataFrame, wanted: set[bytes] | None) -> DataFrame:
    """How many toxic and clean documents hold each feature; counted in each task first."""

    def run(batches):
        seen, n = (Counter(), Counter()), [0, 0]
        for batch in in_parts(batches, 0):
            for text, toxic, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n[toxic] += 1
                f = _features(set(_words(text or "")))
                seen[toxic].update(f if wanted is None else f & wanted)
        keys = [None, *(seen[0].keys() | seen[1].keys())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), *(pa.array([n[y], *(seen[y][k] for k in keys[1:])], pa.int64()) for y in (1, 0))], names=["feature", "toxic", "clean"])

    return sample.mapInArrow(run, "feature binary, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def mine(sample: DataFrame, most: int, candidates: int = 50_000) -> dict[bytes, int]:
    """Features that stand in toxic documents far oftener than in clean ones, with their groups.

    The likelihood-ratio statistic ranks them. ``candidates`` bounds the features of toxic
    documents, most frequent first, that are counted in clean ones; ``most`` bounds the result.
    """
    # written before it is collected: the driver receives the ranked rows and no more
    first = saved(_counted(sample.filter("toxic = 1"), None).filter("toxic >= 3").orderBy(F.desc("toxic"), "feature").limit(candidates + 1)).collect()
    hot = {bytes(r.feature): r.toxic for r in first if r.feature is not None}
    n1 = next((r.toxic for r in first if r.feature is None), 0)
    if not hot:
        return {}
    second = _counted(sample.filter("toxic = 0"), set(hot)).collect()
    clean = {bytes(r.feature): r.clean for r in second if r.feature is not None}
    n0 = sum(r.clean for r in second if r.feature is None)

    def g(a: int, b: int) -> float:
        """Twice the log-likelihood ratio of the feature's 2 x 2 table; 0 if it leans to clean."""
        total, got = n1 + n0, a + b
        if a * n0 <= 4 * b * n1:
            return 0.0
        cells = ((a, got * n1), (b, got * n0), (n1 - a, (total - got) * n1), (n0 - b, (total - got) * n0))
        return 2 * sum(o * np.log(o * total / e) for o, e in cells if o > 0)

    ranked = sorted(((g(a, clean.get(f, 0)), f) for f, a in hot.items()), key=lambda x: (-x[0], x[1]))
    return {f: _group(f, s) for s, f in ranked[:most] if s >= STRATA[0]}


def fit(docs: DataFrame, labels: DataFrame, usable: Column, toxic_rows: int = 4000, clean_rows: int = 8000,
        most: int = 2000, voters: int = 3) -> ToxicityModel:
    """Fit on at most ``toxic_rows`` and ``clean_rows`` labelled rows that are usable (documented bounds).

    The sample is halved; votes and features of each half come from what was mined in the
    other, so that chance finds show their true worth. What scores documents is mined in the
    whole sample. Without labels of both kinds the model scores every text 0.
    """
    sample = training_sample(docs, labels, usable, toxic_rows, clean_rows).persist()
    lexicon = {w.encode() for w in LEXICON}
    try:
        mined = mine(sample, most)
        halves = [ToxicityModel(mine(sample.filter(F.col("fold") == 1 - k), most)) for k in (0, 1)]

        def run(batches):
            for batch in in_parts(batches, 0):
                rows = []
                for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    hits, x = halves[fold].vector(text)
                    groups = {halves[fold].features[h] * voters + zlib.crc32(h) % voters for h in hits}
                    rows.append((x, sorted(groups), int(bool(lexicon & set(_words(text or "")))), toxic))
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.list_(pa.float64()), pa.list_(pa.int32()), pa.int32(), pa.int32()), strict=True)], names=["x", "groups", "lexicon", "toxic"])

        got = sorted(map(tuple, sample.mapInArrow(run, "x array<double>, groups array<int>, lexicon int, toxic int").collect()))
    finally:
        sample.unpersist()
    y = np.array([r[3] for r in got], float)
    if not got or y.min() == y.max():
        return ToxicityModel({})
    x = np.array([r[0] for r in got])
    fired = np.zeros((len(got), GROUPS * voters))
    for i, r in enumerate(got):
        fired[i, r[1]] = 1
    votes = np.column_stack([y, [r[2] for r in got], fired[:, fired.any(0)], x[:, -len(PATTERNS) :]]).astype(float)
    label_model = LabelModel.fit(votes, 0.1 + 0.8 * y)
    post = label_model.posterior(votes)
    w, b = _logistic(x, post)
    moved = (int(((y == 1) & (post < 0.5)).sum()), int(((y == 0) & (post >= 0.5)).sum()))
    return ToxicityModel(mined, w, b, label_model, label_model.accuracies(votes, post), len(got), moved)


def _logistic(x: np.ndarray, target: np.ndarray, l2: float = 0.5, steps: int = 12) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton's method."""
    xb = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(xb.shape[1])
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(xb @ w, -35, 35)))
        grad = xb.T @ (p - target) + ridge * w
        hess = (xb * (p * (1 - p) + 1e-9)[:, None]).T @ xb + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= ``threshold``); whole texts, one pass, no shuffle.

    Null and empty texts are scored like texts without words. Columns of those names are replaced.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop("score", "predicted")
    place = base.columns.index(text)
    schema = base.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches):
        for batch in in_parts(batches, place):
            s = [known.value.score(t) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array([int(v >= threshold) for v in s], pa.int32())], names=schema.names)

    return base.mapInArrow(run, schema)
