"""Embedding x classifier grid with results saved after every embedding."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..operators import features as X, models as M
from ..sources.sinks import upsert_tsv


def run(texts: DataFrame, encoders: Mapping[str, X.Encoder], out: str, zoo: Mapping[str, M.Trainer] | None = None,
        folds: int = 10, threshold: float = 0.5, key: str = "row_id") -> dict[str, DataFrame]:
    """``texts``: key, text, label. Three versioned TSV tables (accuracy, f1, precision) are upserted
    per embedding, so finished rows survive a later failure. Vectors belong to their own encoder.
    """
    spark = texts.sparkSession
    zoo = zoo or M.default_zoo(key, threshold=threshold)
    done = None
    for name, encoder in encoders.items():
        ready = M.with_features(X.embed(texts, "text", encoder)).drop("text")
        results = M.compare_models(ready, zoo, key, folds, threshold=threshold, feature_set=name)
        for metric, table in M.result_tables(results, list(zoo)).items():
            upsert_tsv(spark, f"{out}/results_{metric}", "feature_set", table)
        done = results if done is None else done.unionByName(results)
    return {"results": done, "top": M.best_models(done) if done is not None else None}


def task_grid(examples: DataFrame, key: str, zoo: Mapping[str, M.Trainer], encoder: X.Encoder,
              positive: str = "Yes", folds: int = 5) -> DataFrame:
    """Leaderboard input per task of the fan-out (``key, task, x, y``): each task's examples against
    the positive label.
    """
    out = None
    for task in sorted(r["task"] for r in examples.select("task").distinct().collect()):
        rows = examples.filter(F.col("task") == task).select(
            F.xxhash64(key, "x").alias("row_id"), F.col("x").alias("text"),
            (F.col("y") == positive).cast("int").alias("label"))
        ready = M.with_features(X.embed(rows, "text", encoder)).drop("text")
        part = M.compare_models(ready, zoo, folds=folds, feature_set=task)
        out = part if out is None else out.unionByName(part)
    return out
