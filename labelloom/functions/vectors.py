"""Vector expressions on ``array<float|double>`` columns and probability helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

from .text import _col


def crop(v: Column | str, dim: int) -> Column:
    """First ``dim`` entries; ``dim <= 0`` keeps all; a longer crop than the vector is an error."""
    v = _col(v)
    if dim <= 0:
        return v
    too_long = F.raise_error(
        F.concat(F.lit(f"crop to {dim} exceeds vector size "), F.size(v).cast("string"))
    )
    return F.when(F.size(v) >= dim, F.slice(v, 1, dim)).when(v.isNotNull(), too_long)


def concat_vectors(vs: Sequence[Column | str]) -> Column:
    return F.concat(*[_col(v) for v in vs])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also when the body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def l2_normalize(v: Column | str) -> Column:
    """Unit length; a zero vector stays as it is."""
    v = F.transform(_col(v), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return let(norm, lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x)))


def logit(p: Column | str, eps: float = 1e-12) -> Column:
    """ln(p / (1 - p)) with p clipped to [eps, 1 - eps]."""
    p = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), _col(p)))
    return F.ln(p / (F.lit(1.0) - p))


def decide(prob1: Column | str, threshold: float = 0.5) -> Column:
    """1 when the positive probability reaches the threshold."""
    return (_col(prob1) >= F.lit(float(threshold))).cast("int")


def decide_raw(score: Column | str) -> Column:
    """1 when a raw decision score is not negative (models without probabilities)."""
    return (_col(score) >= F.lit(0.0)).cast("int")


def given_and_alternative(label: Column | str, prob0: Column | str, prob1: Column | str) -> dict[str, Column]:
    """Probability of the given binary label, the other label, and its probability."""
    y, p0, p1 = _col(label), _col(prob0), _col(prob1)
    return {
        "given_label_prob": F.when(y == 1, p1).otherwise(p0),
        "alt_label_suggestion": (1 - y).cast("int"),
        "alt_label_prob": F.when(y == 1, p0).otherwise(p1),
    }
