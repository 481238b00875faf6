"""Language identification by hierarchical discrimination.

Training takes a bounded sample of labelled documents. Languages are first gathered into
families by agglomerative clustering of their mean n-gram profiles; a linear support vector
machine per family (one against the rest) picks the family, and one-versus-one linear
machines separate the languages within it. Features are hashed byte 2- to 4-grams of the
lower-cased letters, as shares of a text's n-grams, so a text of any length is scored whole
in bounded memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import in_parts, slices

#: Letters stay, ASCII characters that are no letters become blanks.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PAD = b"\0\0\0"
_GRAMS = (2, 3, 4)
_SCALE = 100.0  # shares of n-grams are small numbers; this keeps the regulariser's unit sensible
UNDETERMINED = "und"


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _clean(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "


def _gram_ids(buf: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Hashed n-gram ids for each start position; ``buf`` ends with three spare bytes."""
    n = len(buf) - len(_PAD)
    h = buf[:n].astype(np.uint32)
    for k in range(1, max(_GRAMS)):
        h = h * np.uint32(0x01000193) ^ buf[k : n + k]
        if k + 1 in _GRAMS:
            yield (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def _profile(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(_clean(text) + _PAD, np.uint8)
    ids, counts = np.unique(np.concatenate(list(_gram_ids(buf, bits))), return_counts=True)
    return ids, counts / counts.sum()


@dataclass
class LangModel:
    """Weights by hashed n-gram: a column per family, then a column per pair of languages."""

    languages: list[str]
    families: list[list[int]]
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # (2 ** bits, families + pairs)
    bias: np.ndarray
    slope: np.ndarray
    bits: int = 16
    trained_on: int = 0
    chunk: int = field(default=1 << 19)

    def margins(self, texts: list[str]) -> np.ndarray:
        """A row of margins per text; the texts are taken in pieces of bounded size."""
        clean = [_clean(t) for t in texts]
        out = np.zeros((len(texts), self.weights.shape[1]))
        for a, b in slices([len(c) for c in clean], self.chunk):
            if b - a == 1 and len(clean[a]) > self.chunk:
                whole, total = clean[a] + _PAD, np.zeros(self.weights.shape[1])
                for s in range(0, len(clean[a]), self.chunk):
                    buf = np.frombuffer(whole[s : min(s + self.chunk, len(clean[a])) + len(_PAD)], np.uint8)
                    for ids in _gram_ids(buf, self.bits):
                        total += self.weights[ids].sum(0, dtype=np.float64)
                out[a] = total / (len(clean[a]) * len(_GRAMS))
                continue
            buf = np.frombuffer(_PAD.join(clean[a:b]) + _PAD, np.uint8)
            sizes = np.array([len(c) for c in clean[a:b]])
            starts = np.concatenate([[0], np.cumsum(sizes + len(_PAD))[:-1]])
            edges = np.stack([starts, starts + sizes], 1).ravel()[: 2 * (b - a)]
            for ids in _gram_ids(np.concatenate([buf, np.zeros(len(_PAD), np.uint8)]), self.bits):
                out[a:b] += np.add.reduceat(self.weights[ids], edges, axis=0)[::2] / (sizes * len(_GRAMS))[:, None]
        return out * _SCALE + self.bias

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        if not self.languages or not known:
            return out
        prob = 1 / (1 + np.exp(-np.clip(self.margins([texts[i] for i in known]) * self.slope, -30, 30)))
        for i, p in zip(known, prob, strict=True):
            f = int(np.argmax(p[: len(self.families)]))
            members = self.families[f]
            votes = {m: 0.0 for m in members}
            score = {m: 1.0 for m in members}
            for j, (x, y) in enumerate(self.pairs):
                if x in votes:
                    q = float(p[len(self.families) + j])
                    votes[x if q >= 0.5 else y] += 1
                    score[x], score[y] = min(score[x], q), min(score[y], 1 - q)
            best = max(members, key=lambda m: (votes[m], score[m], -m))
            out[i] = (self.languages[best], float(p[f]) * score[best])
        return out


def _fit_svm(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n: int, dim: int, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 50) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by accelerated gradient; ``y`` holds -1 and 1."""
    w, b = np.zeros(dim), 0.0
    v, vb = w.copy(), b
    norm = np.bincount(rows, vals * vals, n)
    rate = 1 / (2 * (weight * (norm + 1)).sum() * 0.5 + l2)
    step = 1.0
    for _ in range(steps):
        m = np.bincount(rows, vals * v[cols], n) + vb
        g = np.maximum(0, 1 - y * m) * weight * -2 * y
        nw = v - rate * (np.bincount(cols, vals * g[rows], dim) + l2 * v)
        nb = vb - rate * g.sum()
        nstep = (1 + math.sqrt(1 + 4 * step * step)) / 2
        v, vb = nw + (step - 1) / nstep * (nw - w), nb + (step - 1) / nstep * (nb - b)
        w, b, step = nw, nb, nstep
    return w, b


def _families(profiles: np.ndarray, wanted: int) -> list[list[int]]:
    """Average-linkage clusters of the languages by the cosine of their mean profiles."""
    unit = np.sqrt(profiles)
    unit = unit - unit.mean(0)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    near, groups = unit @ unit.T, [[i] for i in range(len(profiles))]
    while len(groups) > wanted:
        _, i, j = max(
            (float(near[np.ix_(groups[i], groups[j])].mean()), -i, -j)
            for i in range(len(groups)) for j in range(i + 1, len(groups))
        )
        i, j = -i, -j
        groups[i] = sorted(groups[i] + groups.pop(j))
    return sorted(groups)


def training_sample(docs: DataFrame, usable: Column, per_language: int) -> DataFrame:
    """(doc_id, lang, text) of at most ``per_language`` documents of each language, chosen by a hash of the id.

    Only ids and labels are ranked, first within a language's buckets and then the best of
    those, so a language of very many rows is no single task. The few chosen ids, bounded by
    ``per_language`` times the number of languages, then fetch their texts by a broadcast
    join. Rows without an id are not learned from; of rows that share an id and a language the
    one with the smallest hash of its text is taken.
    """
    usable_rows = docs.filter(usable & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ranked = usable_rows.select(F.col("lang").alias("_lang"), F.col("doc_id").alias("_id")).distinct().withColumn("_h", F.xxhash64("_id")).withColumn("_bucket", F.pmod("_h", F.lit(64)))
    for parts in (("_lang", "_bucket"), ("_lang",)):
        ranked = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(*parts).orderBy("_h", "_id"))).filter(F.col("_n") <= per_language)
    return (
        usable_rows.join(F.broadcast(ranked.select("_lang", "_id")), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
        .groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("_t"))
        .select("doc_id", "lang", "_t.text")
    )


def fit(docs: DataFrame, usable: Column, per_language: int = 400, bits: int = 16) -> LangModel:
    """Train on the usable rows of ``docs(doc_id, text, lang)``.

    ``per_language`` bounds the sample of labelled rows (documented bound, 400 for each
    language value). Rows with null text or language are not learned from. Without any
    usable row the model knows no language and predicts ``und``.
    """

    def featurise(batches):
        for batch in in_parts(batches, 1):
            t = batch.to_pydict()
            keep = [i for i, x in enumerate(t["text"]) if has_letter(x)]
            profs = [_profile(t["text"][i], bits) for i in keep]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([t["doc_id"][i] for i in keep], pa.int64()),
                "lang": pa.array([t["lang"][i] for i in keep], pa.string()),
                "ids": pa.array([p[0].astype(np.int32) for p in profs], pa.list_(pa.int32())),
                "vals": pa.array([p[1].astype(np.float32) for p in profs], pa.list_(pa.float32())),
            })

    sample = training_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), usable, per_language)
    t = sample.mapInArrow(featurise, "doc_id long, lang string, ids array<int>, vals array<float>").toArrow()
    order = sorted(range(t.num_rows), key=lambda i: (t["doc_id"][i].as_py() is None, t["doc_id"][i].as_py() or 0))
    langs = [t["lang"][i].as_py() for i in order]
    names, dim, n = sorted(set(langs)), 1 << bits, len(order)
    if not names:
        return LangModel([], [], [], np.zeros((dim, 0), np.float32), np.zeros(0), np.zeros(0), bits)
    ids = [t["ids"][i].values.to_numpy() for i in order]
    rows = np.repeat(np.arange(n), [len(x) for x in ids])
    cols = np.concatenate(ids)
    vals = np.concatenate([t["vals"][i].values.to_numpy() for i in order]).astype(np.float64) * _SCALE
    y = np.array([names.index(x) for x in langs])
    sizes = np.bincount(y, minlength=len(names))
    profiles = np.stack([np.bincount(cols[y[rows] == k], vals[y[rows] == k], dim) / sizes[k] for k in range(len(names))])
    families = _families(profiles, max(1, round(math.sqrt(len(names)))))
    family_of = {m: f for f, g in enumerate(families) for m in g}
    fam = np.array([family_of[k] for k in y])
    tasks = [(np.where(fam == f, 1, -1), np.ones(n, bool)) for f in range(len(families))]
    pairs = [(a, b) for g in families for i, a in enumerate(g) for b in g[i + 1 :]]
    tasks += [(np.where(y == a, 1, -1), (y == a) | (y == b)) for a, b in pairs]
    weights, bias, slope = np.zeros((dim, len(tasks)), np.float32), np.zeros(len(tasks)), np.ones(len(tasks))
    for k, (target, used) in enumerate(tasks):
        if len(set(target[used])) < 2:  # one family only: it is always the answer
            bias[k] = 10.0 * target[used][0]
            continue
        balance = np.where(target > 0, 0.5 / max(1, (target[used] > 0).sum()), 0.5 / max(1, (target[used] < 0).sum())) * used
        w, b = _fit_svm(rows, cols, vals, n, dim, target, balance)
        m = np.bincount(rows, vals * w[cols], n) + b
        weights[:, k], bias[k] = w, b
        slope[k] = _platt(m[used] * target[used])
    return LangModel(names, families, pairs, weights, bias, slope, bits, n)


def _platt(signed: np.ndarray) -> float:
    """The slope of a logistic curve through zero that fits the signed margins best."""
    grid = np.geomspace(0.5, 50, 40)
    return float(grid[np.argmin([np.logaddexp(0, -a * signed).mean() + 0.002 * a for a in grid])])


def identify(docs: DataFrame, model: LangModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1); ``und`` and 0 for null texts and texts without a letter.

    Every other column passes through; columns named lang_pred or score are replaced.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop("lang_pred", "score")
    place = base.columns.index(text)
    schema = base.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches):
        for batch in in_parts(batches, place):
            pred = known.value.predict(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([p[0] for p in pred], pa.string()), pa.array([p[1] for p in pred], pa.float64())],
                names=schema.names,
            )

    return base.mapInArrow(run, schema)
