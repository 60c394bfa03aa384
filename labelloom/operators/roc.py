"""ROC points and AUC per score column, for any number of rows.

Rows collapse to (category, score) counts first. Running totals are then taken inside
score-range buckets and shifted by per-bucket totals, so no task sees a whole category.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from .ranking import bucket_by_group, quantile_bounds


def score_columns(df: DataFrame, label: str, drop: Sequence[str] = ("Question",)) -> list[str]:
    """Every column but the label and the named non-score ones."""
    return [c for c in df.columns if c != label and c not in drop]


def valid_scores(df: DataFrame, label: str, scores: Sequence[str]) -> DataFrame:
    """``category, score, y``: numeric scores with a label, long form."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    wide = df.select(
        F.col(label).cast("int").alias("y"),
        *[(F.col(f"`{c}`").try_cast("double") if c in text else F.col(f"`{c}`").cast("double")).alias(c)
          for c in scores],
    )
    long = wide.unpivot("y", list(scores), "category", "score")
    return long.filter(F.col("score").isNotNull() & ~F.isnan("score") & F.col("y").isNotNull())


def _cumulative(long: DataFrame, buckets: int) -> DataFrame:
    """Per distinct score: own counts, counts at or above it, class totals and the next lower counts."""
    bounds = quantile_bounds(long, "score", by="category", buckets=buckets)
    counts = long.groupBy("category", "score").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")
    ).withColumn("_b", bucket_by_group(long, "category", "score", bounds))
    per_bucket = counts.groupBy("category", "_b").agg(
        F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"),
        F.max_by(F.struct("pos", "neg"), F.col("score")).alias("_top"),
    )
    # at most ``buckets`` rows per category from here to the join
    down = Window.partitionBy("category").orderBy(F.desc("_b"))
    whole = Window.partitionBy("category")
    offsets = per_bucket.select(
        "category", "_b",
        (F.sum("_bp").over(down) - F.col("_bp")).alias("_p0"),
        (F.sum("_bn").over(down) - F.col("_bn")).alias("_n0"),
        F.sum("_bp").over(whole).alias("P"), F.sum("_bn").over(whole).alias("N"),
        F.lead("_top").over(down).alias("_next_bucket"),
    ).filter((F.col("P") > 0) & (F.col("N") > 0))
    inside = Window.partitionBy("category", "_b").orderBy(F.desc("score"))
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    staged = counts.select(
        "*", F.sum("pos").over(run).alias("_p"), F.sum("neg").over(run).alias("_n"),
        F.lead(F.struct("pos", "neg")).over(inside).alias("_next"),
    )
    return staged.join(offsets, ["category", "_b"]).select(
        "category", "score", "pos", "neg", "P", "N",
        (F.col("_p0") + F.col("_p")).alias("tp"), (F.col("_n0") + F.col("_n")).alias("fp"),
        F.coalesce("_next", "_next_bucket").alias("nxt"),
    )


def roc_points(df: DataFrame, label: str, scores: Sequence[str], drop_collinear: bool = False,
               buckets: int = 64) -> DataFrame:
    """``category, threshold, fpr, tpr``: one point per distinct score plus the (inf, 0, 0) start.

    Categories with one class only are left out. ``drop_collinear`` removes points on a straight
    line between their neighbours.
    """
    cum = _cumulative(valid_scores(df, label, scores), buckets)
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    if drop_collinear:
        nxt = F.col("nxt")
        # a point is on a line when the step after it equals the step into it; the ends always stay
        on_line = (nxt["pos"] == F.col("pos")) & (nxt["neg"] == F.col("neg"))
        cum = cum.filter(first | nxt.isNull() | ~on_line)
    point = F.struct(F.col("score").alias("threshold"), (F.col("fp") / F.col("N")).alias("fpr"),
                     (F.col("tp") / F.col("P")).alias("tpr"))
    start = F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    # the row with the highest score of a category also yields its start point
    return cum.select("category", F.inline(F.when(first, F.array(start, point)).otherwise(F.array(point))))


def auc_by_score(df: DataFrame, label: str, scores: Sequence[str], buckets: int = 64) -> DataFrame:
    """``category, n_pos, n_neg, auc``; tied scores count one half."""
    cum = _cumulative(valid_scores(df, label, scores), buckets)
    wins = F.col("pos") * (F.col("N") - F.col("fp") + F.col("neg") / 2.0)
    return cum.groupBy("category").agg(
        F.first("P").alias("n_pos"), F.first("N").alias("n_neg"),
        (F.sum(wins) / (F.first("P") * F.first("N"))).alias("auc"),
    )
