"""Embed -> train -> score -> write, and the active-learning round built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.labels import normalize_label
from ..functions.text import is_missing_title, join_nonempty, question_with_desc, sanitize, sanitize_columns
from ..functions.vectors import decide
from ..operators import audit, features as X, models as M
from ..operators.ranking import row_ordinal
from ..sources import readers as R, sinks as S


def embed_table(spark: SparkSession, path: str, out: str, encoder: X.Encoder, fmt: str = "tsv",
                text_cols: Sequence[str] = ("Question",), label_col: str | None = None, dim: int = 512,
                templates: Sequence[str] = X.DEFAULT_PROMPTS,
                schema: str = "qid string, category string, title string, desc string, answer string") -> DataFrame:
    """Read a TSV or JSON corpus, embed its text and save rows and vectors together as Parquet.

    TSV labels follow ``non_empty``, JSON labels ``truthy``. Text and vectors share a row, so nothing
    has to be aligned by position later.
    """
    if fmt == "tsv":
        df = row_ordinal(R.require_columns(R.read_table_tsv(spark, path), *text_cols)).withColumnRenamed(
            "row_index", "row_id")
        text, policy = sanitize(text_cols[0]), "non_empty"
    else:
        df = R.require_rows(R.read_json_any(spark, path, schema)).withColumn("row_id", F.monotonically_increasing_id())
        text, policy = join_nonempty([c for c in text_cols if c in df.columns]), "truthy"
    df = df.withColumn("_text", text)
    if label_col and label_col in df.columns:
        df = df.withColumn("label", normalize_label(label_col, policy))
    meta = [c for c in df.columns if c not in ("_text", "row_id", "label")]
    df = sanitize_columns(df, meta)
    coded = X.embed(df, "_text", encoder, templates, dim).drop("_text")
    S.write_embeddings(coded, out, getattr(encoder, "name", type(encoder).__name__), path, fmt, text_cols)
    return spark.read.parquet(out)


def train_and_predict(spark: SparkSession, train_path: str, infer_path: str, out: str,
                      trainer: M.Trainer | None = None, threshold: float = 0.5) -> DataFrame:
    """Fit on labelled embeddings, add probability and label to every inference row, write both outputs."""
    train = M.with_features(R.read_embeddings(spark, train_path, labelled=True))
    infer = R.read_embeddings(spark, infer_path)
    score = (trainer or M.rbf_svm(1.0))(train)
    ready = M.with_features(infer)
    scored = M.attach_predictions(ready, score, threshold).drop("features", "embedding")
    S.write_split(scored, out)
    return spark.read.schema(scored.schema).json(f"{out}/augmented")


def label_round(spark: SparkSession, train_path: str, questions_path: str, out: str, encoder: X.Encoder,
                trainer: M.Trainer | None = None, threshold: float = 0.5) -> dict[str, DataFrame]:
    """One active-learning round: train, label the new questions, pick the least-certain 1 %.

    Writes ``predicted_labels`` and ``lowest_confidence`` (six decimals) as TSV.
    """
    train = R.read_labeled_tsv(spark, train_path, with_row_index=True).withColumns({
        "label": normalize_label("Potentially_Pejorative", "non_empty_cs"), "row_id": F.col("row_index")})
    ready = M.with_features(X.embed(train.select("row_id", F.col("Question").alias("text"), "label"), "text", encoder))
    score = (trainer or M.rbf_svm(1.0))(ready)
    questions = R.read_json_any(spark, questions_path, "title string, desc string").filter(~is_missing_title("title"))
    questions = R.require_rows(questions, questions_path).withColumn("row_id", F.monotonically_increasing_id())
    infer = questions.select(
        "row_id", F.col("title").alias("Question"), F.coalesce("desc", F.lit("")).alias("desc"),
        question_with_desc("title", "desc").alias("text"))
    scored = score(M.with_features(X.embed(infer, "text", encoder)))
    # scored rows are read for both outputs: keep them as a table, not as a recomputation
    kept = scored.select("row_id", "Question", "desc", "prob0", "prob1", decide("prob1", threshold).alias("prediction"))
    kept = S.materialize(kept, f"{out}/scored", overwrite=True)
    shown = sanitize_columns(kept, ["Question", "desc"]).withColumn(
        "Potentially_Pejorative", F.col("prediction") == 1)
    labels = shown.select("Question", "desc", "Potentially_Pejorative")
    low = audit.least_certain(shown, "row_id").orderBy("self_confidence", "row_id").select(
        "Question", "desc", "Potentially_Pejorative", "self_confidence")
    S.write_tsv(labels, f"{out}/predicted_labels")
    S.write_tsv(low, f"{out}/lowest_confidence", float_format="%.6f")
    return {"predicted_labels": labels, "lowest_confidence": low}
