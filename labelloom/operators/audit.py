"""Suspicious labels, least-certain rows and confident learning on class probabilities."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import given_and_alternative
from .joins import drop_listed
from .ranking import SMALL_LIMIT, smallest_k

THRESHOLD = 0.3
TOP_N = 30
LEAST_CERTAIN_SHARE = 0.01
LEAST_CERTAIN_BELOW = 0.51

REPORT_COLUMNS = ("row_index", "text", "given_label_raw", "given_label_binary", "given_label_prob",
                  "alt_label_suggestion", "alt_label_prob", "suspicious")


def issue_report(scored: DataFrame, ignore: DataFrame | None = None, threshold: float = THRESHOLD,
                 top_n: int = TOP_N, row_min: int | None = None, row_max: int | None = None,
                 rank: str = "row_index") -> DataFrame:
    """One row per input row with a ``suspicious`` flag.

    Input: ``row_index, text, label_raw, label, prob0, prob1``. Suspicious = probability of the given
    label under ``threshold``, not on the ignore list, and among the first ``top_n`` of those by
    ``row_index`` (``rank='confidence'``: by probability). The optional row range is applied after
    flagging and only when both ends are given.
    """
    named = given_and_alternative("label", "prob0", "prob1")
    report = scored.select(
        "row_index", "text", F.col("label_raw").alias("given_label_raw"),
        F.col("label").cast("int").alias("given_label_binary"),
        *[c.alias(n) for n, c in named.items()],
    )
    low = report.select("row_index", "given_label_prob").filter(F.col("given_label_prob") < F.lit(threshold))
    if ignore is not None:
        low = drop_listed(low, ignore)
    value = "row_index" if rank == "row_index" else "given_label_prob"
    picked = smallest_k(low, top_n, value, "row_index").select("row_index", F.lit(True).alias("_hit"))
    if top_n <= SMALL_LIMIT:
        picked = F.broadcast(picked)
    report = report.join(picked, "row_index", "left").withColumn(
        "suspicious", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")
    if row_min is not None and row_max is not None:
        report = report.filter(F.col("row_index").between(row_min, row_max))
    return report.select(*REPORT_COLUMNS)


def ranked_report(report: DataFrame) -> DataFrame:
    """Suspicious rows first, then by ascending probability of the given label."""
    return report.orderBy(F.desc("suspicious"), F.asc("given_label_prob"), "row_index")


def suspicious_only(report: DataFrame) -> DataFrame:
    return report.filter("suspicious").select("row_index", "text", "given_label_raw")


def drop_suspicious(df: DataFrame, report: DataFrame, key: str = "row_index") -> DataFrame:
    """Rows not flagged in the report; rows outside a filtered report stay."""
    return drop_listed(df, report.filter("suspicious").select(key), key)


def least_certain(scored: DataFrame, key: str, pred: str = "prediction", share: float = LEAST_CERTAIN_SHARE,
                  below: float = LEAST_CERTAIN_BELOW) -> DataFrame:
    """The ``ceil(share * n)`` rows (at least 1) with the lowest self-confidence, only those under ``below``.

    Adds ``self_confidence``. Filtering first is equal to filtering last, because the filter keeps a
    prefix of the order.
    """
    n = scored.count()
    if n == 0:
        return scored.withColumn("self_confidence", F.lit(None).cast("double"))
    k = max(1, math.ceil(share * n))
    own = F.when(F.col(pred).cast("int") == 1, F.col("prob1")).otherwise(F.col("prob0"))
    candidates = scored.withColumn("self_confidence", own).filter(F.col("self_confidence") < F.lit(below))
    return smallest_k(candidates, k, "self_confidence", key)


def confident_learning(scored: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Rows whose other class is confidently predicted: ``key, label, suggested, self_confidence``.

    Class threshold = mean self-confidence of that class (Northcutt et al. 2021); among the classes
    over their threshold the most probable one wins.
    """
    own = F.when(F.col(label) == 1, F.col("prob1")).otherwise(F.col("prob0"))
    # one row: the two class thresholds
    means = scored.agg(
        F.avg(F.when(F.col(label) == 0, F.col("prob0"))).alias("t0"),
        F.avg(F.when(F.col(label) == 1, F.col("prob1"))).alias("t1"),
    ).first()
    t0 = F.lit(means["t0"] if means["t0"] is not None else float("inf"))
    t1 = F.lit(means["t1"] if means["t1"] is not None else float("inf"))
    ok0, ok1 = F.col("prob0") >= t0, F.col("prob1") >= t1
    pick = (
        F.when(ok0 & ok1, F.when(F.col("prob1") > F.col("prob0"), 1)
               .when(F.col("prob0") > F.col("prob1"), 0).otherwise(F.col(label)))
        .when(ok1, 1).when(ok0, 0)
    )
    return (
        scored.select(key, F.col(label).cast("int").alias("label"), pick.cast("int").alias("suggested"),
                      own.alias("self_confidence"))
        .filter(F.col("suggested") != F.col("label"))
    )
