"""Find suspicious labels in a labelled table and write the report and the cleaned table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.labels import normalize_label
from ..functions.vectors import l2_normalize
from ..operators import audit as A, features as X, models as M
from ..sources import readers as R, sinks as S


def run(spark: SparkSession, path: str, out: str, encoder: X.Encoder, trainer: M.Trainer | None = None,
        text_col: str = "Question", label_col: str = "Potentially_Pejorative", folds: int = 10, seed: int = 42,
        ignore_paths: Sequence[str] = (), row_min: int | None = None, row_max: int | None = None,
        cache: bool = True) -> dict[str, DataFrame]:
    """Embeddings and out-of-fold probabilities are read-through stages under ``out`` when ``cache``."""
    S.write_run_config(spark, {
        "path": path, "text_col": text_col, "label_col": label_col, "folds": folds, "seed": seed,
        "encoder": getattr(encoder, "name", type(encoder).__name__), "ignore": list(ignore_paths),
    }, f"{out}/config")
    rows = R.read_labeled_tsv(spark, path, text_col, label_col, with_row_index=True)
    rows = rows.select("row_index", F.col(text_col).alias("text"), F.col(label_col).alias("label_raw"),
                       normalize_label(label_col, "strict_positive").alias("label"))

    def embedded() -> DataFrame:
        coded = X.embed(rows, "text", encoder, templates=("{text}",))
        return coded.withColumn("embedding", l2_normalize("embedding").cast("array<float>"))

    vectors = S.materialize(embedded, f"{out}/embeddings", spark, overwrite=not cache)
    ready = M.with_features(vectors.withColumn("row_id", F.col("row_index")))
    model = trainer or M.rbf_svm(1.0, balanced=True)
    probs = S.materialize(lambda: M.out_of_fold(ready.drop("text", "label_raw"), model, folds=folds, seed=seed),
                          f"{out}/oof", spark, overwrite=not cache)
    scored = vectors.drop("embedding").join(
        probs.select(F.col("row_id").alias("row_index"), "prob0", "prob1"), "row_index")
    ignore = R.read_exclusions(spark, ignore_paths) if ignore_paths else None
    report = A.issue_report(scored, ignore, row_min=row_min, row_max=row_max)
    S.write_issue_report(report, out)
    kept = A.drop_suspicious(rows, report).select(F.col("text").alias(text_col), F.col("label_raw").alias(label_col))
    S.write_tsv(kept, f"{out}/data_dropped", null_text="")
    return {"report": report, "dropped": kept, "snapshot": M.quick_snapshot(ready, folds=folds, seed=seed)}
