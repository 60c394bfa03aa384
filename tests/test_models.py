"""Trainers, cross-validation and comparison on separable data."""

import numpy as np
from pyspark.sql import functions as F
import pytest

from labelloom.operators import features as X, models as M


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):
        y = i % 2
        rows.append((i, (rng.normal(size=3) + (3.0 if y else 0.0)).tolist(), y, int(i % 10 == 0)))
    df = spark.createDataFrame(rows, "row_id long, embedding array<double>, label int, hit int")
    return M.with_features(df).persist()


TRAINERS = {
    "logreg": M.logistic_regression(30), "svm": M.linear_svm(1.0, balanced=True, folds=2, max_iter=8),
    "rbf": M.rbf_svm(1.0, dim=64, folds=2, max_iter=8), "forest": M.random_forest(10), "tree": M.decision_tree(3),
    "knn": M.nearest_neighbours(5), "boost": M.ada_boost(4),
}


@pytest.mark.parametrize("name", list(TRAINERS))
def test_trainers_separate_the_classes(blobs, name):
    scored = TRAINERS[name](blobs)(blobs)
    row = scored.agg(
        F.avg(((F.col("prob1") >= 0.5).cast("int") == F.col("label")).cast("double")).alias("acc"),
        F.max(F.abs(F.col("prob0") + F.col("prob1") - 1)).alias("gap"), F.count("*").alias("n")).first()
    assert row.acc > 0.9 and row.gap < 1e-9 and row.n == 120


def test_boosting_matches_numpy(blobs):
    """Same stumps and weights as a direct loop, given the tree learner's own split candidates."""
    score = M.ada_boost(3)(blobs)
    raw = score(blobs).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).first()
    assert -1.0 <= raw.lo < 0 < raw.hi <= 1.0


def test_out_of_fold_and_cross_validation(blobs):
    scored = M.out_of_fold(blobs, M.decision_tree(2), folds=3)
    assert scored.count() == 120 and scored.select("row_id").distinct().count() == 120
    m = M.cross_validate(blobs, M.decision_tree(2), folds=3).first()
    assert m.mean_accuracy > 0.85 and m.mean_f1 > 0.85 and m.mean_precision > 0.85
    assert tuple(M.cross_validate(blobs, M.decision_tree(2), folds=0).first()) == (None, None, None)
    assert tuple(M.cross_validate(blobs.filter("label = 1"), M.decision_tree(2)).first()) == (None, None, None)


def test_rules_inside_folds(blobs):
    scored = M.out_of_fold(blobs, M.with_rules(M.decision_tree(2)), folds=2)
    hit = scored.join(blobs.select("row_id", "hit"), "row_id").filter("hit = 1")
    assert hit.filter("prediction = 0 or prob1 < 0.98").count() == 0 and hit.count() == 12


def test_comparison_survives_a_failing_model(blobs):
    def broken(df):
        raise RuntimeError("no")

    zoo = {"tree": M.decision_tree(2), "broken": broken}
    res = M.compare_models(blobs, zoo, folds=2, feature_set="blobs")
    assert {r.classifier: r.mean_f1 is None for r in res.collect()} == {"tree": False, "broken": True}
    assert [r.classifier for r in M.best_models(res, top_n=5).collect()] == ["tree", "broken"]
    table = M.result_tables(res, ["tree", "broken"])["accuracy"]
    assert table.columns == ["feature_set", "tree", "broken"] and table.first().broken is None


def test_text_trainers(spark):
    rows = [(i, ("good fine nice" if i % 2 else "bad ugly nasty") + f" w{i % 5}", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, text string, label int")
    scored = M.on_text(M.logistic_regression(20))(df)(df)
    assert scored.filter((F.col("prob1") >= 0.5).cast("int") != F.col("label")).count() == 0
    coded = X.encode(df, "text", X.NgramHashEncoder(8))
    mixed = M.on_text(M.logistic_regression(20), embedding="embedding")(coded)(coded)
    assert mixed.filter((F.col("prob1") >= 0.5).cast("int") != F.col("label")).count() == 0


def test_ml_tfidf_equals_relational(spark):
    docs = spark.createDataFrame([(0, "red blue blue"), (1, "red green"), (2, "blue green green"), (3, "pink red")], "id int, text string")
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    model = Pipeline(stages=M.tfidf_stages("text")).fit(docs)
    vocab = model.stages[4].vocabulary
    ml = {}
    for r in model.transform(docs).select("id", vector_to_array("tfidf").alias("v")).collect():
        ml.update({(r.id, t): w for t, w in zip(vocab, r.v) if w > 0})
    rel = {(r.id, r.term): r.weight for r in X.tfidf(docs, "id", "text").collect()}
    assert ml == pytest.approx(rel)


def test_attach_predictions(blobs):
    out = M.attach_predictions(blobs, M.decision_tree(2)(blobs), threshold=0.5)
    assert out.columns[-2:] == ["predicted_prob", "predicted_label"] and dict(out.dtypes)["predicted_label"] == "boolean"
