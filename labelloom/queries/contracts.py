"""What SQL can state about trained models: folds, one scored row per input row, the threshold rule, and the
predictions themselves on classes that lie apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import features as X, models as M
from ..operators.matching import flag_any_term
from .base import query, table
from .lexicon import lexicon_of, sql_lexicon
from .models import labelled_texts

FOLDS = 4


def apart(spark, d) -> DataFrame:
    """Vectors whose first component is the class; the others are small."""
    v = F.col("embedding").cast("array<double>")
    sign = F.when(v[0] >= 0, 1.0).otherwise(-1.0)
    return M.with_features(table(spark, d, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.array(sign, v[1] / 10, v[2] / 10).alias("embedding"),
        (v[0] >= 0).cast("int").alias("label")))


def _sql_folds(rows: str, key: str, folds: int) -> str:
    return f"""r AS ({rows}), k AS (SELECT *, ((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || {key}), {key}) - 1)
  % {folds})::INT AS fold FROM r)"""


_ROWS = "SELECT vec_id AS row_id, (embedding[1] >= 0)::INT AS label FROM embeddings"
_SQL = f"""WITH {_sql_folds(_ROWS, 'row_id', FOLDS)}
SELECT row_id, label, fold, label AS prediction, true AS sums_to_one, true AS by_threshold FROM k"""
_TEXT_ROWS = "SELECT doc_id AS row_id, quality::INT AS label FROM labels JOIN documents USING (doc_id)"
_SQL_TEXTS = f"WITH {_sql_folds(_TEXT_ROWS, 'row_id', 2)} SELECT row_id, label, fold, true AS sums_to_one, true AS by_threshold FROM k"


def _contract(scored: DataFrame, *more: str) -> DataFrame:
    one = F.abs(F.col("prob0") + F.col("prob1") - 1) < 1e-9
    rule = F.col("prediction") == (F.col("prob1") >= 0.5).cast("int")
    return scored.select("row_id", "label", "fold", *more, one.alias("sums_to_one"), rule.alias("by_threshold"))


def _out_of_fold(spark, d, trainer: M.Trainer, folds: int = FOLDS) -> DataFrame:
    return _contract(M.out_of_fold(apart(spark, d), trainer, folds=folds), "prediction")


@query("oof_logreg", _SQL)
def oof_logreg(spark, d) -> DataFrame:
    return _out_of_fold(spark, d, M.logistic_regression())


@query("oof_tree", _SQL)
def oof_tree(spark, d) -> DataFrame:
    return _out_of_fold(spark, d, M.decision_tree())


@query("oof_forest", _SQL)
def oof_forest(spark, d) -> DataFrame:
    return _out_of_fold(spark, d, M.random_forest())


# the margin models start a Spark job for every step of every inner fold: two folds
_SQL_TWO = f"""WITH {_sql_folds(_ROWS, 'row_id', 2)}
SELECT row_id, label, fold, label AS prediction, true AS sums_to_one, true AS by_threshold FROM k"""


@query("oof_svm_linear", _SQL_TWO)
def oof_svm_linear(spark, d) -> DataFrame:
    return _out_of_fold(spark, d, M.linear_svm(1.0, folds=2, max_iter=10), 2)


@query("oof_svm_sigmoid", _SQL_TWO)
def oof_svm_sigmoid(spark, d) -> DataFrame:
    return _out_of_fold(spark, d, M.sigmoid_svm(1.0, landmarks=64, folds=2, max_iter=10), 2)


@query("oof_svm_rbf", _SQL_TWO)
def oof_svm_rbf(spark, d) -> DataFrame:
    return _out_of_fold(spark, d, M.rbf_svm(1.0, dim=64, folds=2, max_iter=10), 2)


@query("oof_adaboost", _SQL)
def oof_adaboost(spark, d) -> DataFrame:
    return _out_of_fold(spark, d, M.ada_boost())


@query("snapshot_apart", "SELECT 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1 FROM (SELECT count(*) FROM embeddings)")
def snapshot_apart(spark, d) -> DataFrame:
    return M.quick_snapshot(apart(spark, d), folds=FOLDS)


@query("attached_rows", f"""WITH r AS ({_ROWS})
SELECT row_id, label, label AS predicted_label, true AS by_threshold, true AS is_probability FROM r""")
def attached_rows(spark, d) -> DataFrame:
    v = apart(spark, d)
    out = M.attach_predictions(v, M.logistic_regression()(v))
    p = F.col("predicted_prob")
    return out.select("row_id", "label", F.col("predicted_label").cast("int").alias("predicted_label"),
                      (F.col("predicted_label") == (p >= 0.5)).alias("by_threshold"), p.between(0, 1).alias("is_probability"))


@query("oof_tfidf", _SQL_TEXTS)
def oof_tfidf(spark, d) -> DataFrame:
    return _contract(M.out_of_fold(labelled_texts(spark, d), M.on_text(M.logistic_regression(50)), folds=2))


@query("oof_mixed_features", _SQL_TEXTS)
def oof_mixed_features(spark, d) -> DataFrame:
    texts = X.encode(labelled_texts(spark, d), "text", X.NgramHashEncoder(64))
    return _contract(M.out_of_fold(texts, M.on_text(M.logistic_regression(50), embedding="embedding"), folds=2))


@query("oof_hybrid", f"""WITH {_sql_folds(_TEXT_ROWS, 'row_id', 2)}, {sql_lexicon((3,))},
 f AS (SELECT doc_id AS row_id, EXISTS (SELECT 1 FROM lex WHERE contains(text, term)) AS hit FROM documents)
SELECT row_id, label, fold, true AS sums_to_one, CASE WHEN hit THEN 1 END AS ruled FROM k JOIN f USING (row_id)""")
def oof_hybrid(spark, d) -> DataFrame:
    """With a lexicon hit the rules alone decide; without one the model does."""
    texts = flag_any_term(labelled_texts(spark, d), "text", lexicon_of(spark, d, (3,)), "row_id").select(
        "row_id", "label", "text", "hit")
    ready = M.with_features(X.encode(texts, "text", X.NgramHashEncoder(64)).drop("text"))
    scored = M.out_of_fold(ready, M.with_rules(M.logistic_regression(50)), folds=2).join(texts.select("row_id", "hit"), "row_id")
    one = F.abs(F.col("prob0") + F.col("prob1") - 1) < 1e-9
    return scored.select("row_id", "label", "fold", one.alias("sums_to_one"),
                         F.when(F.col("hit") == 1, F.col("prediction")).alias("ruled"))
