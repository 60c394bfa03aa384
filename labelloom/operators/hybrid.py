"""Lexicon rules on top of model probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import decide


def hybrid_scores(df: DataFrame, hit: str = "hit", prob1: str = "prob1", hard_override: bool = False,
                  boost_floor: float = 0.98, threshold: float = 0.5) -> DataFrame:
    """Replace/add ``prediction, prob0, prob1``.

    A lexicon hit always predicts 1. Its probability becomes 1 with ``hard_override``, otherwise at
    least ``boost_floor``. Without a hit the model's values stand.
    """
    p = F.col(prob1)
    is_hit = F.col(hit) == 1
    boosted = F.lit(1.0) if hard_override else F.greatest(p, F.lit(float(boost_floor)))
    out = df.withColumn("prediction", F.when(is_hit, 1).otherwise(decide(p, threshold)))
    return out.withColumn("prob1", F.when(is_hit, boosted).otherwise(p)).withColumn(
        "prob0", F.lit(1.0) - F.col("prob1")
    )
