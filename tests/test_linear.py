"""Linear models of all folds at once against fits on their own and against Spark ML."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from labelloom.operators import linear, models as M
from labelloom.operators.splits import stratified_folds


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4))
    y = (x @ [1.5, -2, 0.5, 1] + rng.normal(size=400) > 0.3).astype(int)
    df = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))], "row_id bigint, embedding array<double>, label int")
    return stratified_folds(M.with_features(df), "row_id", "label", 4, 1).coalesce(1).cache()


@pytest.mark.parametrize("loss, balanced", [("logistic", False), ("hinge", True)])
def test_members_equal_their_own_fits(points, loss, balanced):
    rows = linear.dense(points.withColumn("inner", F.col("row_id") % 3), "label", "fold", "inner").cache()
    members = [linear.Member(i, j) for i in range(4) for j in (0, 2, None)]
    options = dict(loss=loss, penalty=lambda n: 1.0 / n, balanced=balanced, max_iter=12, tol=1e-9)
    together = linear.fit(rows, members, **options)
    for i in (1, 5):
        m, w = members[i], together.weights[i]
        assert np.abs(linear.fit(rows, [m], **options).weights[0] - w).max() < 1e-6
        if not balanced:
            own = rows.filter(F.col("fold") != m.fold)
            own = own if m.inner is None else own.filter(F.col("inner") != m.inner)
            assert np.abs(linear.fit(own, [linear.Member()], **options).weights[0] - w).max() < 1e-6


def test_logistic_regression_equals_spark_ml(points):
    rows = linear.dense(points, "label", "fold")
    got = linear.fit(rows, [linear.Member(i) for i in range(4)], "logistic", lambda n: 1.0 / n, max_iter=30, tol=1e-10)
    for i in range(2):
        own = points.filter(F.col("fold") != i)
        want = LogisticRegression(maxIter=500, tol=1e-12, regParam=1.0 / own.count(), standardization=False).fit(own)
        assert np.abs(np.append(want.coefficients.toArray(), want.intercept) - got.weights[i]).max() < 1e-4


def test_one_job_per_step_whatever_the_number_of_folds(spark, points, monkeypatch):
    steps = []
    total = linear.total
    monkeypatch.setattr(linear, "total", lambda *a: (steps.append(1), total(*a))[1])
    rows = linear.dense(points, "label", "fold").cache()
    options = dict(loss="logistic", penalty=lambda n: 1.0 / n, max_iter=8, tol=1e-8)
    linear.fit(rows, [linear.Member(i) for i in range(4)], **options)
    together = len(steps)
    alone = []
    for i in range(4):
        steps.clear()
        linear.fit(rows, [linear.Member(i)], **options)
        alone.append(len(steps))
    assert together == max(alone)


def test_sums_meet_in_a_tree(spark):
    rows = spark.range(1000).select(F.array(F.col("id").cast("double")).alias("x"), F.lit(1).alias("label")).repartition(150)
    assert linear.total(rows, lambda c: c["x"].sum(axis=0)).tolist() == [499500.0]
    assert linear.total(rows.filter("label = 2"), lambda c: c["x"].sum(axis=0)) is None


@pytest.mark.parametrize("trainer", [M.logistic_regression(30), M.linear_svm(folds=3, balanced=True, max_iter=8)])
def test_out_of_fold_equals_fold_by_fold(points, trainer):
    got = {r["row_id"]: r for r in M.out_of_fold(points, trainer, cache=False).collect()}
    assert len(got) == 400 and np.mean([r["prediction"] == r["label"] for r in got.values()]) > 0.85
    for i in (2,):
        score = trainer(points.filter(F.col("fold") != i))
        for r in score(points.filter(F.col("fold") == i)).collect():
            assert abs(r["prob1"] - got[r["row_id"]]["prob1"]) < 0.02


def test_one_class_and_no_rows(spark, points):
    one = points.filter("label = 1")
    w = linear.fit(linear.dense(one, "label", "fold"), [linear.Member(i) for i in range(4)], "hinge", lambda n: 1.0 / n, max_iter=5)
    assert np.isfinite(w.weights).all()
    none = linear.dense(points.filter("label = 7"), "label", "fold")
    assert linear.fit(none, [linear.Member(0)], "hinge", lambda n: 1.0).weights.shape == (1, 1)
