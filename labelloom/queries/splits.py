"""Folds, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import splits as S
from .base import query, table


def _sql_rank(seed: int, within: str | None = None) -> str:
    part = f"PARTITION BY {within} " if within else ""
    total = f"(PARTITION BY {within})" if within else "()"
    return (f"r AS (SELECT *, row_number() OVER ({part}ORDER BY md5('{seed}:' || doc_id), doc_id) AS k, "
            f"count(*) OVER {total} AS n FROM labels)")


@query("kfold_assign", f"WITH {_sql_rank(42, 'toxic')} SELECT doc_id, toxic, ((k - 1) % 10)::INT AS fold FROM r")
def kfold_assign(spark, d) -> DataFrame:
    return S.stratified_folds(table(spark, d, "labels"), "doc_id", "toxic", 10).select("doc_id", "toxic", "fold")


@query("shuffle_split", f"""WITH {_sql_rank(3)}, c AS (SELECT *, floor(n * 0.3::DOUBLE) AS v FROM r)
SELECT doc_id, CASE WHEN k <= n - 2 * v THEN 'train' WHEN k <= n - v THEN 'val' ELSE 'test' END AS split FROM c""")
def shuffle_split(spark, d) -> DataFrame:
    return S.shuffle_split(table(spark, d, "labels"), "doc_id", 0.3, 0.3, seed=3).select("doc_id", "split")


@query("stratified_split", f"""WITH {_sql_rank(42, 'toxic')}, c AS (SELECT *, round(n * 0.2::DOUBLE) AS t FROM r),
 e AS (SELECT *, round((n - t) * (0.2::DOUBLE / 0.8::DOUBLE)) AS v FROM c)
SELECT doc_id, toxic, CASE WHEN k <= t THEN 'test' WHEN k <= t + v THEN 'dev' ELSE 'train' END AS split FROM e""")
def stratified_split(spark, d) -> DataFrame:
    return S.stratified_split(table(spark, d, "labels"), "doc_id", "toxic").select("doc_id", "toxic", "split")


@query("sample_n", "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 600")
def sample_n(spark, d) -> DataFrame:
    return S.sample_rows(table(spark, d, "documents"), "doc_id", 600).select("doc_id", "lang")


@query("sample_large", """SELECT event_id, user_id FROM events ORDER BY md5('7:' || event_id), event_id
LIMIT (SELECT count(*) // 2 FROM events)""")
def sample_large(spark, d) -> DataFrame:
    """Half of the events: beyond what one task may hold at scale, so selected by counting."""
    ev = table(spark, d, "events")
    return S.sample_rows(ev, "event_id", ev.count() // 2, seed=7).select("event_id", "user_id")


@query("first_n", "SELECT doc_id, quality FROM labels ORDER BY doc_id LIMIT 200")
def first_n(spark, d) -> DataFrame:
    return S.first_rows(table(spark, d, "labels"), "doc_id", 200).select("doc_id", "quality")
