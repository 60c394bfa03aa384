"""Linear models of many row subsets at once: every fold, and every inner fold, in one pass per step.

A *member* is one model: the rows it is trained on (all but a fold, perhaps but an inner fold), its weights per class and its penalty.
Each step sends all members' coefficients out, every partition returns the sums of their losses and gradients, and the sums are added in a
tree. The number of jobs is that of the slowest member's steps, whatever the number of members; the rows are read once per step.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

#: partial sums that one task adds up
_FAN_IN = 64
#: a step of the line search is halved so often; a hinge leaves no better point near its bends
_HALVINGS = 10


@dataclass(frozen=True)
class Member:
    """Trained on rows whose fold is not ``fold`` and whose inner fold is not ``inner`` (None: on all)."""

    fold: int | None = None
    inner: int | None = None


@dataclass(frozen=True)
class Models:
    """Coefficients (one row per member, the intercept last)."""

    members: tuple[Member, ...]
    weights: np.ndarray


def total(df: DataFrame, part: Callable[[dict[str, np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """The sum of ``part`` over batches of rows, in one job; None without rows. ``df``: column x (array<double>) and plain columns.

    Partial sums meet in groups of ``_FAN_IN`` until so few are left that the driver may add them.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = None
        for batch in batches:
            if batch.num_rows:
                y = part(columns(batch))
                got = y if got is None else got + y
        if got is not None:
            yield pa.record_batch([pa.array([got.ravel().tobytes()], pa.binary()), pa.array([list(got.shape)], pa.list_(pa.int64()))],
                                  names=["sums", "shape"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, shape = None, None
        for batch in batches:
            for x, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                y = np.frombuffer(x)
                got, shape = y if got is None else got + y, s
        if got is not None:
            yield pa.record_batch([pa.array([got.tobytes()], pa.binary()), pa.array([shape], pa.list_(pa.int64()))], names=["sums", "shape"])

    ddl = "sums binary, shape array<bigint>"
    parts = df.rdd.getNumPartitions()
    sums = df.mapInArrow(local, ddl)
    while parts > _FAN_IN:
        parts = -(-parts // _FAN_IN)
        sums = sums.coalesce(parts).mapInArrow(add, ddl)
    out = None
    for r in sums.collect():
        y = np.frombuffer(r["sums"]).reshape(r["shape"])
        out = y if out is None else out + y
    return out


def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = {}
    for name, c in zip(batch.schema.names, batch.columns):
        if name == "x":
            values = c.flatten().to_numpy(zero_copy_only=False)
            out[name] = values.reshape(len(c), -1)
        else:
            out[name] = c.to_numpy(zero_copy_only=False)
    return out


def dense(df: DataFrame, *keep: str, features: str = "features") -> DataFrame:
    """x and the kept columns."""
    return df.select(vector_to_array(features).alias("x"), *keep)


def _mask(members: Sequence[Member], c: dict[str, np.ndarray]) -> np.ndarray:
    """rows x members: is the row one that the member is trained on?"""
    out = np.ones((len(c["label"]), len(members)), dtype=bool)
    for i, m in enumerate(members):
        if m.fold is not None:
            out[:, i] &= c["fold"] != m.fold
        if m.inner is not None:
            out[:, i] &= c["inner"] != m.inner
    return out


def _logistic(z: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = z * sign
    return np.logaddexp(0.0, -t), -sign / (1.0 + np.exp(np.clip(t, -700, 700)))


def _hinge(z: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = 1.0 - z * sign
    return np.maximum(t, 0.0), np.where(t > 0, -sign, 0.0)


LOSSES = {"logistic": _logistic, "hinge": _hinge}


def lbfgs(x: np.ndarray, max_iter: int, tol: float, memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Yields points, is sent (value, gradient) there, and returns the last accepted point."""
    f, g = yield x
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(max_iter):
        d = g.copy()
        kept = []
        for s, y, r in reversed(steps):
            a = r * (s @ d)
            kept.append(a)
            d -= a * y
        if steps:
            s, y, r = steps[-1]
            d *= 1.0 / (r * (y @ y))
        for (s, y, r), a in zip(steps, reversed(kept)):
            d += s * (a - r * (y @ d))
        slope = -(g @ d)
        if slope >= 0:
            d, slope, steps = g.copy(), -(g @ g), []
        t = 1.0 if steps else min(1.0, 1.0 / max(math.sqrt(g @ g), 1e-12))
        for _ in range(_HALVINGS):
            new = x - t * d
            f_new, g_new = yield new
            if f_new <= f + 1e-4 * t * slope:
                break
            t /= 2.0
        else:
            return x
        s, y = new - x, g_new - g
        if s @ y > 1e-12 * (y @ y):
            steps = [*steps[1 - memory:], (s, y, 1.0 / (s @ y))] if len(steps) >= memory else [*steps, (s, y, 1.0 / (s @ y))]
        done = abs(f - f_new) <= tol * max(abs(f), abs(f_new), 1e-12)
        x, f, g = new, f_new, g_new
        if done or math.sqrt(g @ g) <= tol:
            return x
    return x


def fit(rows: DataFrame, members: Sequence[Member], loss: str, penalty: Callable[[int], float], balanced: bool = False,
        max_iter: int = 100, tol: float = 1e-6) -> Models:
    """Minimise for each member the weighted mean of its rows' losses plus penalty(rows) / 2 * |w|^2 (the intercept is free).

    ``rows``: x, label (0 or 1) and, where members name them, fold and inner; best cached. ``balanced``: a class of a fold's training rows
    weighs n / (2 * its rows), inner folds included.
    """
    by = [c for c in ("fold", "inner") if c in rows.columns]
    counts = rows.groupBy("label", *by).agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).collect()
    dim = max((r["d"] for r in counts), default=0)

    def size(m: Member, label: int | None = None, inner: bool = True) -> int:
        return sum(r["n"] for r in counts if (label is None or r["label"] == label) and (m.fold is None or r["fold"] != m.fold)
                   and (not inner or m.inner is None or r["inner"] != m.inner))

    sizes = np.array([size(m) for m in members])
    class_weight = np.ones((len(members), 2))
    if balanced:
        class_weight = np.array([[size(m, None, False) / (2.0 * max(size(m, y, False), 1)) for y in (0, 1)] for m in members])
    weight_sum = np.array([sum(class_weight[i, y] * size(m, y) for y in (0, 1)) for i, m in enumerate(members)])
    penalties = np.array([penalty(max(int(n), 1)) for n in sizes])
    of_loss = LOSSES[loss]
    runs = [lbfgs(np.zeros(dim + 1), max_iter, tol) for _ in members]
    points = np.array([next(r) for r in runs]).reshape(len(members), dim + 1)
    active = [i for i in range(len(members)) if sizes[i]]

    while active:
        some, w, cw = [members[i] for i in active], points[active], class_weight[active]

        def part(c: dict[str, np.ndarray]) -> np.ndarray:
            y = c["label"].astype(np.int64)
            z = c["x"] @ w[:, :-1].T + w[:, -1]
            value, slope = of_loss(z, (2.0 * y - 1.0)[:, None])
            rate = _mask(some, c) * cw[:, y].T
            slope *= rate
            return np.column_stack([(value * rate).sum(axis=0), slope.T @ c["x"], slope.sum(axis=0)])

        sums = total(rows, part) / weight_sum[active][:, None]
        left = []
        for i, s, at in zip(active, sums, w):
            f = s[0] + 0.5 * penalties[i] * (at[:-1] @ at[:-1])
            g = s[1:].copy()
            g[:-1] += penalties[i] * at[:-1]
            try:
                points[i] = runs[i].send((float(f), g))
                left.append(i)
            except StopIteration as stop:
                points[i] = stop.value
        active = left
    return Models(tuple(members), points)


def platt(rows: DataFrame, models: Models, folds: Sequence[int | None], max_iter: int = 50) -> np.ndarray:
    """(slope, offset) per fold: logistic regression of the label on the margin that each training row has by the model that left its
    inner fold out. Newton's method, all folds in one job per step."""
    at = {m: i for i, m in enumerate(models.members)}
    inner = sorted({m.inner for m in models.members if m.inner is not None})
    table = np.array([[at[Member(f, j)] for j in inner] for f in folds])
    w = models.weights

    def margins(c: dict[str, np.ndarray]) -> np.ndarray:
        z = c["x"] @ w[:, :-1].T + w[:, -1]
        which = np.searchsorted(inner, c["inner"])
        return np.take_along_axis(z, table[:, which].T, axis=1)

    params = np.tile([1.0, 0.0], (len(folds), 1))
    for _ in range(max_iter):
        now = params.copy()

        def part(c: dict[str, np.ndarray]) -> np.ndarray:
            z, y = margins(c), c["label"].astype(float)[:, None]
            use = _mask([Member(f) for f in folds], c).astype(float)
            p = 1.0 / (1.0 + np.exp(-np.clip(z * now[:, 0] + now[:, 1], -700, 700)))
            e, h = (p - y) * use, np.maximum(p * (1 - p), 1e-12) * use
            return np.column_stack([(e * z).sum(0), e.sum(0), (h * z * z).sum(0), (h * z).sum(0), h.sum(0), use.sum(0)])

        sums = total(rows, part)
        if sums is None:
            return params
        g, n = sums[:, :2] / sums[:, 5:], sums[:, 5]
        ridge = 1e-8  # separable margins would send the slope to infinity
        a, b, d = sums[:, 2] / n + ridge, sums[:, 3] / n, sums[:, 4] / n + ridge
        det = np.maximum(a * d - b * b, 1e-300)
        step = np.column_stack([(d * g[:, 0] - b * g[:, 1]) / det, (a * g[:, 1] - b * g[:, 0]) / det])
        params = now - np.clip(step, -5.0, 5.0)
        if np.abs(params - now).max() < 1e-8:
            break
    return params


def probabilities(models: Models, params: np.ndarray | None, folds: Sequence[int | None]):
    """An Arrow function (x, fold) -> struct<raw, prob1>: each row by the model of its fold (a fold of None: by the only model)."""
    at = {m: i for i, m in enumerate(models.members)}
    w = models.weights[[at[Member(f)] for f in folds]]
    p = np.tile([1.0, 0.0], (len(folds), 1)) if params is None else params
    names = [-1 if f is None else f for f in folds]

    @F.arrow_udf("struct<raw:double, prob1:double>")
    def score(x: pa.Array, fold: pa.Array) -> pa.Array:
        features = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        i = np.searchsorted(names, fold.to_numpy(zero_copy_only=False))
        raw = np.einsum("nd,nd->n", features, w[i, :-1]) + w[i, -1] if len(features) else np.empty(0)
        z = raw * p[i, 0] + p[i, 1]
        return pa.StructArray.from_arrays([pa.array(raw), pa.array(1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))))], names=["raw", "prob1"])

    return score
