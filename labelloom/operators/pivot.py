"""Dynamic category columns out of a map column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.text import category_column_name

MAX_CATEGORIES = 10_000


def categories_of(df: DataFrame, scores: str = "scores") -> list[str]:
    """The distinct normalised category names, sorted; refuses to build an absurdly wide table."""
    names = df.select(F.explode(F.map_keys(scores)).alias("k")).distinct()
    rows = names.select(category_column_name("k").alias("c")).distinct().limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories")
    return sorted(r["c"] for r in rows)


def widen_scores(df: DataFrame, scores: str = "scores", categories: Sequence[str] | None = None,
                 as_text: bool = False) -> DataFrame:
    """Replace the map by one column per category; a missing category is NULL (or '' as text).

    The columns are read out of each row's own map, so nothing is shuffled beyond the one
    distinct-names pass (skipped when ``categories`` is given).
    """
    categories = categories_of(df, scores) if categories is None else list(categories)
    renamed = F.map_from_entries(F.transform(
        F.map_entries(scores), lambda e: F.struct(category_column_name(e["key"]), e["value"])
    ))
    staged = df.withColumn("_m", renamed).drop(scores)
    cols = []
    for c in categories:
        v = F.try_element_at("_m", F.lit(c))
        cols.append((F.coalesce(v.cast("string"), F.lit("")) if as_text else v).alias(c))
    return staged.select(*[c for c in staged.columns if c != "_m"], *cols)
