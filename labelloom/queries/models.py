"""Classifiers: cross-validation, hybrids, comparison. Only the neighbour vote can be stated in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import features as X, models as M
from ..operators.matching import flag_any_term
from .base import query, table
from .lexicon import lexicon_of
from .metrics import sql_weighted
from .vectors import SQL_OOF


def vectors(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("embedding"),
        (F.col("label") % 2).cast("int").alias("label"))
    return M.with_features(e)


def labelled_texts(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.join(table(spark, d, "labels"), "doc_id").select(
        F.col("doc_id").alias("row_id"), "text", F.col("quality").cast("int").alias("label"))


def _cv(spark, d, name: str, trainer: M.Trainer, folds: int = 3) -> DataFrame:
    out = M.cross_validate(vectors(spark, d), trainer, folds=folds)
    return out.select(F.lit(name).alias("classifier"), *out.columns)


@query("cv_logreg")
def cv_logreg(spark, d) -> DataFrame:
    return _cv(spark, d, "Logistic Regression", M.logistic_regression(50), folds=3)


@query("cv_forest")
def cv_forest(spark, d) -> DataFrame:
    return _cv(spark, d, "Random Forest", M.random_forest(100))


@query("cv_tree")
def cv_tree(spark, d) -> DataFrame:
    return _cv(spark, d, "Decision Tree", M.decision_tree())


@query("cv_svm_linear")
def cv_svm_linear(spark, d) -> DataFrame:
    return _cv(spark, d, "SVM (Linear Kernel)", M.linear_svm(1.0, folds=3, max_iter=15), folds=2)


@query("cv_svm_rbf")
def cv_svm_rbf(spark, d) -> DataFrame:
    return _cv(spark, d, "SVM (C=1)", M.rbf_svm(1.0, dim=128, folds=2, max_iter=15), folds=2)


@query("cv_svm_sigmoid")
def cv_svm_sigmoid(spark, d) -> DataFrame:
    return _cv(spark, d, "SVM (Sigmoid Kernel)", M.sigmoid_svm(1.0, landmarks=64, folds=2, max_iter=15), folds=2)


@query("cv_adaboost")
def cv_adaboost(spark, d) -> DataFrame:
    return _cv(spark, d, "AdaBoost", M.ada_boost(10), folds=2)


@query("cv_knn", f"""WITH {SQL_OOF}, o AS (SELECT *, (prob1 >= 0.5)::INT AS pred FROM oof),
 w AS ({sql_weighted('o', 'label', 'pred', 'fold', None)})
SELECT 'Nearest Neighbors' AS classifier, round(avg(accuracy), 6) AS mean_accuracy, round(avg(f1), 6) AS mean_f1,
       round(avg("precision"), 6) AS mean_precision FROM w""")
def cv_knn(spark, d) -> DataFrame:
    out = _cv(spark, d, "Nearest Neighbors", M.nearest_neighbours(10), folds=5)
    return out.select("classifier", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("oof_svm_balanced")
def oof_svm_balanced(spark, d) -> DataFrame:
    """Out-of-fold probabilities of the class-balanced SVM, for every row."""
    out = M.out_of_fold(vectors(spark, d), M.linear_svm(1.0, balanced=True, folds=2, max_iter=15), folds=2)
    return out.select("row_id", "label", "fold", F.round("prob1", 4).alias("prob1"), "prediction")


@query("quick_snapshot")
def quick_snapshot(spark, d) -> DataFrame:
    return M.quick_snapshot(vectors(spark, d), folds=3)


@query("model_comparison")
def model_comparison(spark, d) -> DataFrame:
    zoo = {"Logistic Regression": M.logistic_regression(50), "Decision Tree": M.decision_tree(5),
           "Nearest Neighbors": M.nearest_neighbours(10)}
    return M.best_models(M.compare_models(vectors(spark, d), zoo, folds=3, feature_set="embeddings"))


@query("tfidf_classifier")
def tfidf_classifier(spark, d) -> DataFrame:
    out = M.cross_validate(labelled_texts(spark, d), M.on_text(M.logistic_regression(20)), folds=2)
    return out.select(F.lit("TF-IDF").alias("features"), *out.columns)


@query("mixed_features_classifier")
def mixed_features_classifier(spark, d) -> DataFrame:
    texts = X.encode(labelled_texts(spark, d), "text", X.NgramHashEncoder(64))
    out = M.cross_validate(texts, M.on_text(M.logistic_regression(20), embedding="embedding"), folds=2)
    return out.select(F.lit("TF-IDF + embedding").alias("features"), *out.columns)


@query("hybrid_cv")
def hybrid_cv(spark, d) -> DataFrame:
    """Lexicon rules inside each fold of a logistic regression on embedded documents."""
    texts = flag_any_term(labelled_texts(spark, d), "text", lexicon_of(spark, d, (3,)), "row_id")
    ready = M.with_features(X.encode(texts, "text", X.NgramHashEncoder(64)).drop("text"))
    out = M.cross_validate(ready, M.with_rules(M.logistic_regression(50)), folds=3)
    return out.select(F.lit("Logistic Regression+Rules").alias("classifier"), *out.columns)


@query("attach_predictions")
def attach_predictions(spark, d) -> DataFrame:
    """Train on one half of the vectors' folds, score every row, keep the positives' columns."""
    v = vectors(spark, d)
    scored = M.attach_predictions(v, M.logistic_regression(50)(v))
    return scored.select("row_id", "label", F.round("predicted_prob", 4).alias("predicted_prob"),
                         F.col("predicted_label").cast("int").alias("predicted_label"))
