"""Label audit on the out-of-fold neighbour probabilities."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..functions.labels import label_text
from ..operators import audit as A
from .base import query, table
from .vectors import SQL_OOF, oof_frame

_SQL_SCORED = SQL_OOF + """,
 s AS (SELECT vec_id AS row_index, 'vec ' || vec_id AS text, CASE WHEN label = 1 THEN 'Potentially' ELSE 'None' END AS label_raw,
              label, 1 - prob1 AS prob0, prob1, (prob1 >= 0.5)::INT AS prediction FROM oof),
 g AS (SELECT *, CASE WHEN label = 1 THEN prob1 ELSE prob0 END AS given, CASE WHEN label = 1 THEN prob0 ELSE prob1 END AS alt FROM s),
 b AS (SELECT row_index FROM g WHERE given < 0.3::DOUBLE AND row_index % 7 <> 0 ORDER BY row_index LIMIT 30),
 rep AS (SELECT row_index, text, label_raw AS given_label_raw, label AS given_label_binary, round(given, 6) AS given_label_prob,
          (1 - label)::INT AS alt_label_suggestion, round(alt, 6) AS alt_label_prob,
          (row_index IN (SELECT row_index FROM b))::INT AS suspicious FROM g)"""


def _scored(spark, d) -> DataFrame:
    """Cached: the report reads it more than once (the audit job keeps it as a table instead)."""
    return oof_frame(spark, d).select(
        F.col("vec_id").alias("row_index"), F.concat(F.lit("vec "), F.col("vec_id").cast("string")).alias("text"),
        label_text("label").alias("label_raw"), "label", "prob0", "prob1",
        (F.col("prob1") >= 0.5).cast("int").alias("prediction")).persist(StorageLevel.MEMORY_AND_DISK)


def _report(spark, d, scored: DataFrame | None = None, **kw) -> DataFrame:
    ignored = table(spark, d, "embeddings").filter("vec_id % 7 = 0").select(F.col("vec_id").alias("row_index"))
    return A.issue_report(_scored(spark, d) if scored is None else scored, ignore=ignored, **kw)


def _shown(report: DataFrame) -> DataFrame:
    return report.withColumns({
        "given_label_prob": F.round("given_label_prob", 6), "alt_label_prob": F.round("alt_label_prob", 6),
        "suspicious": F.col("suspicious").cast("int")})


@query("issue_report", f"WITH {_SQL_SCORED} SELECT * FROM rep")
def issue_report(spark, d) -> DataFrame:
    return _shown(_report(spark, d))


@query("issue_report_range", f"WITH {_SQL_SCORED} SELECT * FROM rep WHERE row_index BETWEEN 100 AND 400")
def issue_report_range(spark, d) -> DataFrame:
    """The report's own row-range option: applied after flagging, so flagged rows outside it are gone too."""
    return _shown(_report(spark, d, row_min=100, row_max=400))


@query("suspicious_labels", f"WITH {_SQL_SCORED} SELECT row_index, text, given_label_raw FROM rep WHERE suspicious = 1")
def suspicious_labels(spark, d) -> DataFrame:
    return A.suspicious_only(_report(spark, d))


@query("suspicious_by_confidence", f"""WITH {_SQL_SCORED}
SELECT row_index, round(given, 6) AS given_label_prob FROM g WHERE given < 0.3::DOUBLE ORDER BY given, row_index LIMIT 12""")
def suspicious_by_confidence(spark, d) -> DataFrame:
    rep = A.issue_report(_scored(spark, d), top_n=12, rank="confidence").filter("suspicious")
    return rep.select("row_index", F.round("given_label_prob", 6).alias("given_label_prob"))


@query("dropped_dataset", f"WITH {_SQL_SCORED} SELECT row_index, label_raw FROM g WHERE row_index NOT IN (SELECT row_index FROM b)")
def dropped_dataset(spark, d) -> DataFrame:
    scored = _scored(spark, d)
    return A.drop_suspicious(scored, _report(spark, d, scored)).select("row_index", "label_raw")


@query("least_certain", f"""WITH {_SQL_SCORED}, q AS (SELECT row_index, prediction,
   CASE WHEN prediction = 1 THEN prob1 ELSE prob0 END AS self_confidence FROM g),
 k AS (SELECT * FROM q ORDER BY self_confidence, row_index LIMIT (SELECT greatest(1, ceil(0.01::DOUBLE * count(*)))::BIGINT FROM q))
SELECT row_index, prediction, round(self_confidence, 6) AS self_confidence FROM k WHERE self_confidence < 0.51::DOUBLE""")
def least_certain(spark, d) -> DataFrame:
    out = A.least_certain(_scored(spark, d), "row_index")
    return out.select("row_index", "prediction", F.round("self_confidence", 6).alias("self_confidence"))


@query("confident_learning", f"""WITH {_SQL_SCORED},
 t AS (SELECT avg(prob0) FILTER (label = 0) AS t0, avg(prob1) FILTER (label = 1) AS t1 FROM g),
 c AS (SELECT g.*, CASE WHEN prob0 >= t0 AND prob1 >= t1 THEN CASE WHEN prob1 > prob0 THEN 1 WHEN prob0 > prob1 THEN 0 ELSE label END
        WHEN prob1 >= t1 THEN 1 WHEN prob0 >= t0 THEN 0 END AS suggested FROM g, t)
SELECT row_index, label, suggested, round(given, 6) AS self_confidence FROM c WHERE suggested <> label""")
def confident_learning(spark, d) -> DataFrame:
    return A.confident_learning(_scored(spark, d), "row_index").withColumn(
        "self_confidence", F.round("self_confidence", 6))
