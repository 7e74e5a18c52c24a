"""Operator 9, toxicity: maximum-scoring segments over token log-odds.

Log-odds of tokens and of their stems between toxic and other documents are
shrunk by a Dirichlet prior that is proportional to the tokens' overall counts;
tokens whose log-odds are clearly above zero score them, every other token
scores the same small negative amount.  A linear scan finds all maximal scoring segments of a
document; a segment's score is turned into a significance by the extreme-value
law of such maxima (a scale from the scores, a constant from clean documents),
and the significances of a document's segments make its score.

Only the model (term scores, extreme-value constants, score calibration) is
fitted on a bounded, hash-drawn sample of labelled rows: MAX_ROWS.  Every
document is scored over its whole text.

Defined results: a null or empty text has no segment; equal texts score the
same; without usable labels every score is the same prior; an empty table
gives no rows; further columns are not carried.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attesta.llm.labelled import fold, logistic, sample
from attesta.llm.common import TEXT, beside, text_of

#: Labelled rows that the model may be fitted on.
MAX_ROWS = 20_000
#: Terms with a positive score (the largest by significance).
MAX_TERMS = 5_000
#: A term's log-odds must exceed zero by so many standard deviations.
LEAST_Z = 2.5
#: And this much: a term that is merely a little more frequent is like any other.
LEAST_ODDS = 2.0
#: Documents of prior, as a share of the sample.
PRIOR_SHARE = 0.1
#: Share of the sample for the terms; the rest calibrates.
TERM_PART = 0.7
#: A passage is significant when fewer than so many as good are expected by chance.
SIGNIFICANT = 0.05
TOKEN = re.compile(r"[^\W_]+")


@dataclass
class Model:
    scores: dict[str, float]
    drift: float
    scale: float
    constant: float
    weights: list[float]


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments: (score, first token, last token), in order.

    ``hits`` are the tokens with a positive score; all others score ``drift``.
    Each segment links to the latest one that began at a lower running total,
    so that the scan passes every segment a bounded number of times.
    """
    low, high, first, final, link = [], [], [], [], []
    total, at = 0.0, -1
    for i, s in hits:
        total += drift * (i - at - 1)
        new_low, new_first = total, i
        total += s
        at = i
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= new_low:
                j = link[j]
            if j < 0 or high[j] >= total:
                break
            new_low, new_first = low[j], first[j]
            del low[j:], high[j:], first[j:], final[j:], link[j:]
        low.append(new_low)
        high.append(total)
        first.append(new_first)
        final.append(i)
        link.append(j)
    return [(h - lo, a, b) for lo, h, a, b in zip(low, high, first, final)]


#: Characters of a token's stem, which is a term of its own (written with a hyphen).
STEM = 4


def measure(text: str, model: Model) -> tuple[int, list[tuple[float, int, int]]]:
    """Number of tokens and the segments of a whole text."""
    get = model.scores.get
    tokens = TOKEN.findall(text.lower())
    hits = [(i, s) for i, t in enumerate(tokens) if (s := get(t) or get(t[:STEM] + "-")) is not None]
    return len(tokens), segments(hits, model.drift)


def evidence(n: int, found: list[tuple[float, int, int]], model: Model) -> tuple[float, float]:
    """Calibrated strength of the best segment, and of all segments together."""
    chance = math.log(max(model.constant * max(n, 1), 1e-12))
    strength = [max(0.0, model.scale * s - chance) for s, _, _ in found]
    return min(40.0, max(strength, default=0.0)), min(80.0, sum(strength))


def _terms(rows: DataFrame) -> tuple[dict[str, float], float]:
    """Scores of the toxic terms and the drift of all others, from document counts."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    stems = F.transform(words, lambda w: F.concat(F.left(w, F.lit(STEM)), F.lit("-")))
    tokens = F.concat(words, F.array_distinct(stems))
    counts = rows.select("label", F.explode(tokens).alias("term")).groupBy("term").agg(
        F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    n = rows.agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).first()
    n_t, n_c = float(n["t"] or 0), float(n["c"] or 0)
    if not n_t or not n_c:
        return {}, -0.01
    prior = F.lit(PRIOR_SHARE) * (F.col("t") + F.col("c")) / (n_t + n_c)  # per document of prior
    a_t, a_c = prior * n_t + 0.01, prior * n_c + 0.01
    y_t, y_c = F.col("t") + a_t, F.col("c") + a_c
    w_t, w_c = n_t * (1 + PRIOR_SHARE) + 0.02, n_c * (1 + PRIOR_SHARE) + 0.02
    odds = F.log(y_t / (w_t - y_t + 0.5)) - F.log(y_c / (w_c - y_c + 0.5))
    z = odds / F.sqrt(1 / y_t + 1 / y_c)
    top = (counts.filter("t >= 2").select("term", odds.alias("odds"), z.alias("z"))
           .filter((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("z"), "term").limit(MAX_TERMS).collect())
    return {r["term"]: float(min(8.0, r["odds"])) for r in top}, -0.01


def _measured(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [measure(t, model) for t in pdf["text"]]
            yield pd.DataFrame({"label": pdf["label"], "n": [n for n, _ in out],
                                "hits": [len(f) for _, f in out],
                                "best": [max((s for s, _, _ in f), default=0.0) for _, f in out],
                                "total": [sum(s for s, _, _ in f) for _, f in out],
                                "scores": [[s for s, _, _ in f] for _, f in out]})
    return run


def scale_of(scores: list[float], drift: float, rate: float) -> float:
    """The root of E[exp(scale * score)] = 1 when a term turns up with probability ``rate``."""
    if not scores:
        return 1.0
    s = np.array(scores)
    low, high = 1e-3, 8.0
    for _ in range(60):
        mid = (low + high) / 2
        value = rate * np.exp(np.minimum(mid * s, 50)).mean() + (1 - rate) * math.exp(mid * drift)
        low, high = (mid, high) if value < 1 else (low, mid)
    return (low + high) / 2


def fit(docs: DataFrame, labels: DataFrame, usable, text: str = "text", doc_id: str = "doc_id",
        most: int = MAX_ROWS) -> Model:
    """The model from at most about ``most`` labelled rows."""
    rows = sample(docs, labels, "toxic", usable, most, text, doc_id)
    scores, drift = _terms(rows.filter(F.col("part") < TERM_PART))
    model = Model(scores, drift, 1.0, 1e-3, [0.0, 0.0, 0.0])
    seen = rows.filter(F.col("part") >= TERM_PART).select("label", "text").mapInPandas(
        _measured(model), "label int, n long, hits long, best double, total double, scores array<double>").toPandas()
    if not len(seen):
        return model
    clean = seen[seen["label"] == 0]
    rate = (clean["hits"].sum() + 0.5) / (clean["n"].sum() + 1.0)
    model.scale = scale_of(list(scores.values()), drift, float(min(rate, 0.05)))
    typical = float(np.median(list(scores.values()))) if scores else 1.0
    expected = float((clean["n"] * math.exp(-model.scale * typical)).sum())
    model.constant = float((clean["best"] >= typical).sum() + 0.5) / max(expected, 1e-9)
    x = np.array([evidence(n, [(s, 0, 0) for s in f], model) for n, f in zip(seen["n"], seen["scores"])])
    model.weights = [float(v) for v in logistic(x / 10, seen["label"].to_numpy())]
    return model


def _score(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bound = -math.log(SIGNIFICANT)
        for pdf in batches:
            score, passages = [], []
            for t in pdf.pop("text"):
                n, found = measure(t, model)
                best, total = evidence(n, found, model)
                chance = math.log(max(model.constant * max(n, 1), 1e-12))
                x = model.weights[0] * best / 10 + model.weights[1] * total / 10 + model.weights[2]
                score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))))
                passages.append(",".join(f"{a}:{b + 1}" for s, a, b in found if model.scale * s - chance >= bound))
            yield pdf.assign(score=score, predicted=np.array([s >= 0.5 for s in score], dtype=np.int32),
                             passages=passages)
    return run


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted, and the significant passages as token spans."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), (fold(F.col(doc_id), 5) == 0).alias("held_out"),
                       text_of(text).alias("text"))
    return beside(slim, _score(model), {"score": ("double", pa.float64()), "predicted": ("int", pa.int32()),
                                        "passages": TEXT}, text="text")
