"""Labelled samples for the two classifiers: bounded, drawn by hash, without label leaks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from attesta.llm.common import materialize, text_of


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int,
           text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, label, part, text) of about ``most`` usable labelled documents at most.

    A label row enters when the hash of its id is below ``most`` / usable rows,
    so the sample is the same on every run; ``part`` in [0, 1) splits it.  Label
    rows that repeat an id count once (the largest label).  The label side is
    bounded by ``most`` rows of two numbers and may be broadcast.
    """
    own = labels.filter(usable & F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    n = own.count()
    u = F.pmod(F.xxhash64(F.lit(label), F.col(doc_id)), F.lit(1 << 52)) / float(1 << 52)
    part = F.pmod(F.xxhash64(F.lit("part"), F.col(doc_id)), F.lit(1 << 52)) / float(1 << 52)
    chosen = (own.filter(u < most / max(1, n)).groupBy(F.col(doc_id).alias("doc_id"))
              .agg(F.max(label).cast("int").alias("label")).withColumn("part", part))
    texts = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    return materialize(texts.join(F.broadcast(chosen), "doc_id", "inner")
                       .select("doc_id", "label", "part", "text"), f"sample-{label}")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression (Newton steps).

    Labels are drawn in from 0 and 1 as Platt does, so separable data keep
    finite scores.  With one class only, the intercept alone says so.
    """
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if len(y) == 0:
        return w
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - target) + penalty @ w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, grad)
        w = w - step * min(1.0, 10 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w
