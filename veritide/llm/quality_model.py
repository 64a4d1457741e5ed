"""Quality classifier: Naive Bayes support vectors.

Features are indicators of n-grams: of words, and of word shapes in a row (the
shape of a word that repeats the one before it is ``=``).  Each indicator is
scaled by its log-count ratio between the classes; a linear hinge-loss model is
fitted on the scaled indicators by dual coordinate descent, and its margin is
turned into a score by a logistic curve fitted on the training margins.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, table

_RUNS = ((re.compile(r"[^\W\d_a-zà-öø-ÿ]+"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "9"))
_REPEATED = re.compile(r"([^\w\s])\1+")
_CACHE_SIZE = 200_000


def shape(word: str) -> str:
    """Capital runs as A, other letters as a, digits as 9, runs of one sign as that sign twice."""
    if word.isalpha():
        if word.islower():
            return "a"
        if word[1:].islower() and word[0].isupper():
            return "Aa"
    for pattern, mark in _RUNS:
        word = pattern.sub(mark, word)
    return _REPEATED.sub(r"\1\1", word)


class Features:
    """Distinct n-gram indicators of a text."""

    def __init__(self, orders: tuple[int, ...] = (1, 2)):
        self.orders = orders
        self.shapes: dict[str, str] = {}

    def __call__(self, text: str) -> set:
        words = text.split()
        known = self.shapes
        if len(known) > _CACHE_SIZE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = shape(w)
        row = [known[w] for w in words]
        row[1:] = ["=" if a == b else s for a, b, s in zip(words, words[1:], row[1:], strict=False)]
        out: set = set(words)
        for n in self.orders:
            out.update(zip(*(row[i:] for i in range(n)), strict=False))
        return out


@dataclass
class Model:
    """weights by n-gram (already scaled by the ratios), bias, and the logistic curve's slope and offset."""

    weights: dict = field(default_factory=dict)
    bias: float = 0.0
    slope: float = 0.0
    offset: float = 0.0

    def score(self, features: set) -> float:
        w = self.weights
        margin = self.bias + sum([w[f] for f in features if f in w])
        z = self.slope * margin + self.offset
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def descend(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, c: float, epochs: int, seed: int) -> np.ndarray:
    """Weights of a hinge-loss model with penalty c; the last weight is the bias's. Rows hold indices of indicators."""
    w = np.zeros(len(scale) + 1)
    full = np.append(scale, 1.0)
    idx = [np.append(r, len(scale)) for r in rows]
    val = [full[i] for i in idx]
    square = np.array([v @ v for v in val])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[idx[i]] @ val[i]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), c)
            if step := new - alpha[i]:
                w[idx[i]] += step * y[i] * val[i]
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-4 * c:
            break
    return w


def curve(margin: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve, fitted by Newton steps to softened labels."""
    n1, n0 = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    theta = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p))
        theta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit(features: list[set], labels: list[int], min_count: int = 5, c: float = 0.1, epochs: int = 30, smooth: float = 1.0) -> Model:
    """Model from labelled indicator sets; with one class or none, every score is a half."""
    y = np.asarray(labels)
    if len(set(labels)) < 2:
        return Model()
    count: dict = {}
    for f in features:
        for g in f:
            count[g] = count.get(g, 0) + 1
    index = {g: i for i, g in enumerate(sorted((g for g, n in count.items() if n >= min_count), key=repr))}
    rows = [np.array(sorted(index[g] for g in f if g in index), np.int64) for f in features]
    sums = np.full((2, len(index)), smooth)
    for r, k in zip(rows, y.tolist(), strict=True):
        sums[k][r] += 1
    ratio = np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())
    w = descend(rows, ratio, 2.0 * y - 1, c, epochs, seed=7)
    scaled = w[:-1] * ratio
    margin = np.array([scaled[r].sum() + w[-1] for r in rows])
    slope, offset = curve(margin, y)
    return Model({g: float(scaled[i]) for g, i in index.items() if scaled[i]}, float(w[-1]), slope, offset)


def held_out(doc_id: str, folds: int = 5):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows_per_class: int = 2000) -> Model:
    """Fit on at most ``rows_per_class`` labelled rows of each class, those outside the held-out fold with the smallest hashes.

    That bound is all that reaches the driver; the sample's texts stay in the
    tasks, which send their n-grams.  Of rows that repeat a doc_id, the text with
    the smallest hash counts.  Null labels and documents with contradicting labels
    are left out, null texts count as empty; with labels of one class or none, or
    an empty table, every score is a half.
    """
    clean = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(doc_id))
        .groupBy(F.col(doc_id).alias("doc_id"))
        .agg(F.min(label).alias("y"), F.max(label).alias("z"))
        .where("y = z")
        .select("doc_id", "y", F.xxhash64("doc_id").alias("h"))
    )
    picked = None
    for k in (0, 1):
        part = clean.where(F.col("y") == k).orderBy("h", "doc_id").limit(rows_per_class)
        picked = part if picked is None else picked.union(part)
    sample = (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        .join(F.broadcast(picked.drop("h")), "doc_id")
        .groupBy("doc_id", "y")
        .agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
        .select("y", "one.text")
    )

    def make():
        extract = Features()
        import json

        return lambda texts: {"grams": [json.dumps(sorted(extract(t), key=repr)) for t in texts]}

    import json

    found = map_texts(sample, ["y"], "text", make, "grams string").collect()
    found.sort(key=lambda r: (r["y"], r["grams"]))
    sets = [{tuple(g) if isinstance(g, list) else g for g in json.loads(r["grams"])} for r in found]
    return fit(sets, [r["y"] for r in found])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The columns ``keep``, score and predicted of every row; only the text counts, null as empty.

    Repeated rows give repeated results, whatever their ids; an empty table gives an empty result.
    """

    def make():
        extract = Features()

        def run(texts: list[str]) -> dict[str, list]:
            scores = [model.score(extract(t)) for t in texts]
            return {"score": scores, "predicted": np.array([s >= threshold for s in scores], np.int32)}

        return run

    return map_texts(docs, list(keep), text, make, "score double, predicted int")


def op1_quality_nbsvm(spark, sf_dir: str) -> DataFrame:
    """Score every document with a model trained outside the held-out fold; see train() and score() for nulls, empty texts and repeats."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
