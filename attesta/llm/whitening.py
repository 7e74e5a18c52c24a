"""Operator 13, embedding whitening: leading components by FEAST contour integration.

Vectors become fixed-point integers, so counts, sums and the covariance's numerator are exact sums
that do not depend on how rows are dealt out.  The covariance, a matrix of the dimension squared
whatever the corpus, is solved on the driver.  Inertia counts (signs of the pivots of a symmetric
factorisation of V - s) say how many eigenvalues lie above a shift; they place the intervals that
hold the wanted ones.  In each interval a quadrature of shifted complex solves around a circle
projects a random block onto its eigenvectors, Rayleigh-Ritz extracts them, and the count says
whether one is missing; if so the block grows.

Defined results: a vector that is null, has null or non-finite entries or entries whose fixed-point
form is no long is left out, as is one whose length is not the most frequent (ties: the longest);
repeated vectors count once in the fit and have their own rows in the result; fewer components than
asked for are returned where the covariance has fewer positive eigenvalues (none for a single
distinct vector); a deviation beyond a long is null; an empty table gives no rows; further columns
come along where ``keep`` names them, those of the result excepted.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from attesta.llm.common import materialize

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
RESULT = ("component", "n", "deviation", "whitened", "explained", "identity_error")
#: Quadrature nodes on the half circle, and the width of an interval as a ratio of its ends.
NODES, RATIO = 8, 4.0
#: Eigenvalues below this share of the trace are rounding.
NOISE = 1e-13
LONG = 2 ** 63 - 1


class Model(NamedTuple):
    n: int
    sums: np.ndarray         # exact, Python integers
    vectors: np.ndarray      # dimension x components
    values: np.ndarray       # eigenvalues, falling
    trace: float


# --- the eigenproblem -----------------------------------------------------------------------

def inertia(a: np.ndarray) -> tuple[int, int, int]:
    """Numbers of negative, zero and positive eigenvalues of a symmetric matrix.

    Signs of the pivot blocks of a symmetric factorisation with complete
    (Bunch-Parlett) pivoting, which is stable for indefinite matrices.
    """
    a = np.array(a, dtype=np.float64)
    alpha, tiny = (1 + 17 ** 0.5) / 8, np.abs(a).max(initial=0.0) * 1e-300
    signs = [0, 0, 0]
    while len(a):
        off = np.abs(a)
        diagonal = np.diag(off).copy()
        np.fill_diagonal(off, 0)
        p, most = int(diagonal.argmax()), int(off.argmax())
        r, s = divmod(most, len(a))
        if max(diagonal[p], off[r, s]) <= tiny:
            signs[1] += len(a)
            break
        chosen = [p] if diagonal[p] >= alpha * off[r, s] else sorted((r, s))
        for to, i in enumerate(chosen):  # the pivot's rows and columns go first
            a[[to, i]] = a[[i, to]]
            a[:, [to, i]] = a[:, [i, to]]
        k = len(chosen)
        block, side = a[:k, :k], a[k:, :k]
        if k == 1:
            signs[2 if block[0, 0] > 0 else 0] += 1
            a = a[1:, 1:] - np.outer(side, side / block[0, 0])
        else:  # the pivot rule makes the block indefinite
            signs[0] += 1
            signs[2] += 1
            a = a[2:, 2:] - side @ np.linalg.solve(block, side.T)
    return tuple(signs)


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues are greater than the shift."""
    return inertia(v - shift * np.eye(len(v)))[2]


def place(v: np.ndarray, k: int, known: dict[float, int], tolerance: float = 1e-3) -> tuple[float, float]:
    """An interval, as narrow as the tolerance, that holds the k-th largest eigenvalue.

    ``known`` has the counts above the shifts tried so far, zero and an upper bound among them.
    """
    floor = max(known) * NOISE
    while True:
        low = max(x for x, n in known.items() if n >= k)
        high = min(x for x, n in known.items() if n < k)
        if high - low <= tolerance * high or high <= floor:
            return low, high
        middle = (low + high) / 2 if low else high / 8
        known[middle] = above(v, middle)


def cut_below(v: np.ndarray, k: int, high: float) -> tuple[float, int]:
    """A shift with at least k eigenvalues above it, in the widest relative gap at hand; the count."""
    positive = above(v, high * NOISE)
    last = min(positive, k + 8)
    if last <= k:
        return high * NOISE, positive
    known = {0.0: len(v), high: 0}
    spots = [place(v, j, known) for j in range(k, last + 1)]
    gaps = [(spots[i][0] - spots[i + 1][1]) / spots[i][1] for i in range(len(spots) - 1)]
    if positive > last and max(gaps) <= 0:  # one cluster: take all of it
        return high * NOISE, positive
    if positive == last:
        gaps.append(1.0 if max(gaps) <= 0 else -1.0)
        spots.append((high * NOISE, high * NOISE))
    i = int(np.argmax(gaps))
    shift = (spots[i][0] + spots[i + 1][1]) / 2
    return shift, above(v, shift)


def intervals(v: np.ndarray, low: float, high: float) -> list[tuple[float, float, int]]:
    """[low, high] in intervals whose ends are of like size, with their numbers of eigenvalues."""
    edges, counts = [high], [0]
    while edges[-1] > low:
        wanted = max(low, edges[-1] / RATIO)
        if wanted <= low * 1.5:
            wanted = low
        else:  # an end with no eigenvalue beside it
            tries = [wanted * (1 + t) for t in np.linspace(-0.2, 0.2, 9)]
            room = [(above(v, t * 0.999) - above(v, t * 1.001), abs(t - wanted), t) for t in tries]
            wanted = min(room)[2]
        edges.append(wanted)
        counts.append(above(v, wanted))
    return [(edges[i + 1], edges[i], counts[i + 1] - counts[i]) for i in range(len(edges) - 1) if counts[i + 1] > counts[i]]


def feast(v: np.ndarray, low: float, high: float, count: int, seed: int = 7) -> np.ndarray:
    """Unit eigenvectors of the ``count`` eigenvalues in an interval."""
    d, middle, radius = len(v), (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(1j * (-np.pi / 2) * (nodes - 1))
    scale = np.abs(v).max()
    width = min(d, max(count + 6, 2 * count))
    while True:
        y, best, kept = np.random.default_rng(seed).standard_normal((d, width)), np.inf, None
        shifted = [(middle + radius * t) * np.eye(d) - v for t in turns]
        for _ in range(24):
            q = sum(w / 2 * (radius * t * np.linalg.solve(m, y.astype(complex))).real
                    for w, t, m in zip(weights, turns, shifted))
            left, sizes, _ = np.linalg.svd(q, full_matrices=False)
            basis = left[:, sizes > sizes[0] * 1e-15]
            basis, _ = np.linalg.qr(basis)
            values, small = np.linalg.eigh(basis.T @ v @ basis)
            y = basis @ small
            inside = (values > low) & (values < high)
            worst = np.linalg.norm(v @ y[:, inside] - y[:, inside] * values[inside], axis=0).max(initial=0.0) / scale
            if inside.sum() == count and worst < best:
                better, best, kept = worst < best / 4, worst, y[:, inside]
                if worst < 1e-15 or not better:
                    break
            elif kept is not None:
                break
        if kept is not None and (best < 1e-10 or width == d):
            return kept
        if width == d:
            raise ArithmeticError(f"{count} eigenvalues in [{low}, {high}], {int(inside.sum())} found")
        width = min(d, 2 * width)


def leading(v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The up to k largest positive eigenvalues, falling, and their unit eigenvectors."""
    high = float(np.trace(v)) * (1 + 1e-9)
    if not len(v) or not high > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    low, _ = cut_below(v, k, high)
    found = np.hstack([feast(v, *i) for i in intervals(v, low, high)])
    basis, _ = np.linalg.qr(found)  # Rayleigh-Ritz once more over all intervals
    values, small = np.linalg.eigh(basis.T @ v @ basis)
    if (values > low).sum() != above(v, low):
        raise ArithmeticError("an eigenvalue is missing")
    order = np.argsort(-values)[:k]
    return values[order], basis @ small[:, order]


# --- exact sums over the rows ---------------------------------------------------------------

def fixed(vector: str) -> Column:
    """The vector as fixed-point longs; null if it has none."""
    entry = lambda e: e.cast("double")
    good = lambda e: e.isNotNull() & ~F.isnan(entry(e)) & (F.abs(entry(e)) < 2.0 ** 56)
    c = F.col(f"`{vector}`")
    return F.when(c.isNotNull() & F.forall(c, good),
                  F.transform(c, lambda e: F.floor(entry(e) * SCALE) + F.lit(SHIFT).cast("long")))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def products(z: np.ndarray) -> np.ndarray:
    """Exact sums of the rows' products, as Python integers where longs would not do."""
    most = int(np.abs(z).max(initial=0)) if z.dtype != object else max(map(abs, z.ravel()), default=0)
    if len(z) * most * most < 2 ** 53:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    z = z.astype(object) if len(z) * most * most >= 2 ** 62 else z
    return z.T @ z


WIDE = "decimal(38,0)"


def _sum_rows(rows: DataFrame, d: int, partial) -> np.ndarray:
    """Sum over all rows of ``partial(matrix)``, an integer matrix of bounded size, exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = partial(matrix(b.column(0).slice(at, 4096), d)).astype(object)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([[str(x) for x in r] for r in total])], ["i", "v"])

    parts = rows.mapInArrow(run, "i int, v array<string>")
    flat = parts.select("i", F.posexplode("v").alias("j", "v"))
    sums = flat.groupBy("i", "j").agg(F.sum(F.col("v").cast(WIDE)).alias("v")).collect()  # one row per cell
    out = np.zeros((max((r["i"] for r in sums), default=-1) + 1, max((r["j"] for r in sums), default=-1) + 1), dtype=object)
    for r in sums:
        out[r["i"], r["j"]] = int(r["v"])
    return out


def fit(distinct: DataFrame, d: int, components: int = COMPONENTS) -> Model | None:
    """The model of distinct fixed-point vectors in the column ``_x``; None without rows."""
    def first(x: np.ndarray) -> np.ndarray:
        x = x.astype(object) if int(np.abs(x).max()) * len(x) >= 2 ** 62 else x
        return np.vstack([np.full(d, len(x), dtype=object), x.sum(axis=0)])

    got = _sum_rows(distinct.select("_x"), d, first)
    if not got.size:
        return None
    n, sums = int(got[0, 0]), got[1]
    # Centred at the nearest integers to the means; what is left of the means is below one half.
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=object)
    centre_long = centre.astype(np.int64)
    grams = _sum_rows(distinct.select("_x"), d, lambda x: products(x - centre_long))
    rest = np.array([s - n * c for s, c in zip(sums, centre)], dtype=object)
    v = ((n * grams - np.outer(rest, rest)) / (n * n)).astype(np.float64)
    values, vectors = leading(v, components)
    return Model(n, sums, vectors, values, float(np.trace(v)))


def scaled(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S, exact, and the whitened rows."""
    most = model.n * int(np.abs(x).max(initial=0)) + max(map(abs, model.sums))
    off = model.n * x.astype(object if most >= 2 ** 62 else np.int64) - model.sums.astype(object if most >= 2 ** 62 else np.int64)
    return off, (off / model.n).astype(np.float64) @ model.vectors / np.sqrt(model.values)


def deviations(off: np.ndarray) -> list[int | None]:
    most = max(map(abs, off.ravel())) if off.dtype == object else int(np.abs(off).max(initial=0))
    if off.shape[1] * most * most >= 2 ** 62:
        off = off.astype(object)
    return [int(s) if s <= LONG else None for s in (off * off).sum(axis=1)]


#: Whitened values are added up as integers of this unit, so that the check does not depend on order.
UNIT = 2 ** 40


def identity_error(distinct: DataFrame, d: int, model: Model) -> float:
    """Largest entry of (covariance of the whitened fit list - identity), from its rows."""
    k = len(model.values)

    def run(x: np.ndarray) -> np.ndarray:
        w = scaled(x, model)[1]
        both = np.vstack([w.sum(axis=0), w.T @ w])
        return np.array([[int(c) for c in r] for r in np.rint(both * UNIT)], dtype=object)

    got = _sum_rows(distinct.select("_x"), d, run)
    mean = got[0].astype(np.float64) / UNIT / model.n
    cov = got[1:].astype(np.float64) / UNIT / model.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max())


def whiten(docs: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",),
           components: int = COMPONENTS) -> DataFrame:
    """``keep`` and the RESULT columns: one row per remaining vector and component."""
    names = [c for c in keep if c not in RESULT]
    slots = [f"k{i}" for i in range(len(names))]
    rows = docs.select(*[F.col(f"`{c}`").alias(s) for c, s in zip(names, slots)], fixed(vector).alias("_x"))
    rows = rows.filter(F.size("_x") > 0)
    usual = rows.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = usual["d"] if usual else 1
    rows = rows.filter(F.size("_x") == d)
    distinct = materialize(rows.select("_x").distinct(), "fit")
    model = fit(distinct, d, components)
    if model is None:
        model = Model(1, np.zeros(d, dtype=object), np.zeros((d, 0)), np.zeros(0), 0.0)
    error = identity_error(distinct, d, model) if len(model.values) else 0.0
    kinds = "".join(f"{s} {rows.schema[s].dataType.simpleString()}, " for s in slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("_x")
            off, white = scaled(matrix(b.column(at), d), model)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(b.num_columns) if i != at],
                 pa.array(deviations(off), pa.int64()), pa.array(list(white), pa.list_(pa.float64()))],
                [*[c for c in b.schema.names if c != "_x"], "deviation", "whitened"])

    made = rows.mapInArrow(run, f"{kinds}deviation long, whitened array<double>")
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")
    return (made.select(*slots, "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select(*[F.col(s).alias(c) for s, c in zip(slots, names)], (F.col("at") + 1).alias("component"),
                    F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")))
