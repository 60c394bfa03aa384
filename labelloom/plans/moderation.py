"""Score a labelled table with a moderation function and judge the scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.labels import normalize_label
from ..functions.text import first_text
from ..operators import pivot, roc, scoring
from ..operators.ranking import row_ordinal
from ..sources import readers as R, sinks as S


def score_table(spark: SparkSession, path: str, out: str, scorer: Callable[[str, str | None], dict],
                categories: Sequence[str] = scoring.MODERATION_CATEGORIES, **kw) -> None:
    """Input columns plus score columns, in input order."""
    rows = R.read_table_tsv(spark, path)
    base = rows.columns
    rows = row_ordinal(rows).withColumn("_text", first_text(rows))
    # stored before it is sorted: a sort reads its input twice, and every call would be made twice
    scored = S.materialize(scoring.score_rows(rows, scorer, "_text", categories, **kw), f"{out.rstrip('/')}.scored", overwrite=True)
    shown = [F.col(f"`{c}`") for c in [*base, *[c for c in categories if c not in base]]]
    S.write_tsv(scored.orderBy("row_index").select(*shown), out)


def score_dynamic(spark: SparkSession, path: str, out: str, scorer: Callable[[str], dict], text: str = "Question",
                  label: str = "Potentially_Pejorative", **kw) -> None:
    """One call per row; the categories found become columns ('' where missing)."""
    rows = R.require_rows(R.require_columns(R.read_table_tsv(spark, path), text, label), path)
    rows = row_ordinal(rows).select("row_index", text, normalize_label(F.coalesce(label, F.lit("")), "fill_none").alias(label))
    # the calls are made once; the distinct category names come from the stored rows
    scored = S.materialize(scoring.score_rows_map(rows, scorer, text, **kw), f"{out}/scored", overwrite=True)
    wide = pivot.widen_scores(scored, as_text=True)
    S.write_tsv(wide.orderBy("row_index").drop("row_index"), f"{out}/table")


def judge_scores(spark: SparkSession, path: str, label: str = "Potentially_Pejorative",
                 policy: str = "non_empty") -> dict[str, DataFrame]:
    """ROC points and ranked AUC of every score column."""
    df = R.read_score_table(spark, path, label)
    df = df.withColumn(label, normalize_label(label, policy))
    cols = roc.score_columns(df, label)
    return {
        "roc": roc.roc_points(df, label, cols),
        "auc": roc.auc_by_score(df, label, cols).orderBy(F.desc("auc"), "category"),
    }
