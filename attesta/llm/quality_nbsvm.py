"""Operator 10, quality classifier: naive Bayes support vectors.

Binary n-gram indicators (words, pairs of words, pairs of word shapes) are
hashed into a fixed number of features and scaled by the log-count ratio of the
classes; a linear hinge-loss model over them is fitted by dual coordinate
descent, drawn towards the plain naive Bayes weights, and its margin is turned
into a probability on a part of the sample that the fit has not seen.

The model alone is fitted on a bounded, hash-drawn sample of labelled rows:
MAX_ROWS.  Every document is scored over its whole text.

Defined results: a null or empty text has no n-gram and scores the intercept;
equal texts score the same; without usable labels every score is 0.5; an empty
table gives no rows; further columns are not carried.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attesta.llm.common import beside, text_of
from attesta.llm.labelled import fold, logistic, sample

#: Labelled rows that the model may be fitted on.
MAX_ROWS = 8_000
#: Share of them for the weights; the rest calibrates.
FIT_PART = 0.75
BITS = 17
SMOOTHING = 1.0
COST = 1.0
ROUNDS = 12
#: Share of the fitted weights; the rest is their mean size (naive Bayes alone).
BLEND = 0.25
TOKEN = re.compile(r"\w+|[^\w\s]+")


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    intercept: float


def shape(token: str) -> str:
    """What a token looks like: case of a word, or the first signs of a symbol run."""
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:4]
    if token.isupper():
        return "AA" if len(token) > 1 else "A"
    if token[0].isupper():
        return "Aa"
    return "9" if token.isdigit() else "a"


def indicators(text: str) -> np.ndarray:
    """The hashed n-grams of a whole text, sorted, each once."""
    tokens = TOKEN.findall(text)
    grams = {t.lower() for t in tokens}
    known = {t: shape(t) for t in set(tokens)}
    shapes = [known[t] for t in tokens]
    grams.update(f"{a}\x00{b}" for a, b in set(zip(shapes, shapes[1:])))
    if any(a == b for a, b in zip(tokens, tokens[1:])):
        repeats = sum(a == b for a, b in zip(tokens, tokens[1:]))
        grams.add(f"=\x00{min(4, repeats * 20 // len(tokens))}")
    mask = (1 << BITS) - 1
    return np.unique(np.fromiter((zlib.crc32(g.encode("utf-8", "surrogatepass")) & mask for g in grams), np.int32, len(grams)))


def coordinate_descent(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: float = COST,
                       rounds: int = ROUNDS, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights of a hinge-loss linear model on indicators scaled by ``ratio``, and the bias.

    Dual coordinate descent: each document's multiplier, held between 0 and
    ``cost``, is moved to its optimum with the others fixed.
    """
    w, bias = np.zeros(len(ratio)), 0.0
    values = [ratio[r] for r in rows]
    norm = np.array([float(v @ v) + 1.0 for v in values])
    alpha, rng = np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        largest = 0.0
        for i in rng.permutation(len(rows)).tolist():
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(cost, max(0.0, alpha[i] - gradient / norm[i]))
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-4:
            break
    return w, bias


def _indicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(grams=[indicators(t).tolist() for t in pdf.pop("text")])[["label", "part", "grams"]]


def train(rows: list[np.ndarray], labels: np.ndarray, parts: np.ndarray) -> Model:
    size = 1 << BITS
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(size), 0.0, 0.0, 0.0)
    own = np.flatnonzero(parts < FIT_PART) if len(set(labels[parts < FIT_PART].tolist())) > 1 else np.arange(len(rows))
    y = np.where(labels == 1, 1.0, -1.0)
    p, q = np.full(size, SMOOTHING), np.full(size, SMOOTHING)
    for i in own:
        (p if y[i] > 0 else q)[rows[i]] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    w, bias = coordinate_descent([rows[i] for i in own], ratio, y[own])
    used = np.abs(w[w != 0]).mean() if (w != 0).any() else 0.0
    weights = ((1 - BLEND) * used + BLEND * w) * ratio
    rest = np.setdiff1d(np.arange(len(rows)), own)
    rest = rest if len(set(labels[rest].tolist())) > 1 else np.arange(len(rows))
    margin = np.array([weights[rows[i]].sum() + BLEND * bias for i in rest])
    spread = margin.std() or 1.0
    slope, intercept = logistic((margin / spread)[:, None], labels[rest])
    return Model(weights, BLEND * bias, slope / spread, intercept)


def fit(docs: DataFrame, labels: DataFrame, usable, text: str = "text", doc_id: str = "doc_id",
        most: int = MAX_ROWS) -> Model:
    """The model from at most about ``most`` labelled rows, which reach the driver as hashed n-grams."""
    rows = sample(docs, labels, "quality", usable, most, text, doc_id)
    seen = rows.select("label", "part", "text").mapInPandas(
        _indicate, "label int, part double, grams array<int>").toPandas()
    return train([np.asarray(g, dtype=np.int32) for g in seen["grams"]], seen["label"].to_numpy(), seen["part"].to_numpy())


def _score(model: Model):
    weights = model.weights.astype(np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            margin = np.array([weights[indicators(t)].sum() + model.bias for t in pdf.pop("text")], dtype=float)
            score = 1 / (1 + np.exp(-np.clip(model.slope * margin + model.intercept, -30, 30)))
            yield pdf.assign(score=score, predicted=(score >= 0.7).astype(np.int32))
    return run


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), (fold(F.col(doc_id), 4) == 2).alias("held_out"),
                       text_of(text).alias("text"))
    return beside(slim, _score(model), {"score": ("double", pa.float64()), "predicted": ("int", pa.int32())}, text="text")
