"""Text models without a dictionary: the same steps as with one, and nothing of its size on the driver."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F

from labelloom.operators import features as X, linear, models as M, text_linear


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[:45] if i % 2 else words[15:], size=int(rng.integers(1, 12)))) if i % 20 else "", i % 2)
            for i in range(160)]
    return X.encode(spark.createDataFrame(rows, "row_id long, text string, label int").repartition(3), "text", X.NgramHashEncoder(4)).cache()


@pytest.mark.parametrize("embedding", [None, "embedding"])
def test_folds_take_the_steps_of_a_fit_with_a_dictionary(texts, monkeypatch, embedding):
    def no_dictionary(*a):
        raise AssertionError("a dictionary on the driver")

    folded = M.stratified_folds(texts, "row_id", "label", 2).cache()
    stages = M.tfidf_stages("text")
    own = folded.filter("fold != 0")
    model = Pipeline(stages=stages).fit(own)

    def dense(rows):
        x = M.vector_to_array("tfidf")
        return model.transform(rows).select("row_id", F.concat(x, F.col(embedding).cast("array<double>")).alias("x") if embedding else x.alias("x"), "label")

    w = linear.fit(dense(own), [linear.Member()], "logistic", lambda n: 1.0 / n, max_iter=4).weights[0]
    want = {r["row_id"]: 1 / (1 + np.exp(-(np.array(r["x"]) @ w[:-1] + w[-1]))) for r in dense(folded.filter("fold = 0")).collect()}

    monkeypatch.setattr(CountVectorizer, "_fit", no_dictionary)
    got = M.out_of_fold(folded, M.on_text(M.logistic_regression(4), embedding=embedding, local_bytes=0), cache=False).collect()
    assert len(got) == 160
    assert {r["row_id"]: r["prob1"] for r in got if r["fold"] == 0} == pytest.approx(want, abs=1e-5)


def test_steps_move_only_what_they_add(texts, monkeypatch):
    """A step does not shuffle what former steps found, and a row's own fold is left out of what travels."""
    plans, sizes = [], []
    staged, products = text_linear.staged, text_linear._products

    def seen(df):
        if "sums" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df)

    def measured(postings, v, k, *args, **kw):
        out = products(postings, v, k, *args, **kw)
        sizes.append(sum(len(r["z"]) // 8 for r in out.select("z").collect()))
        return out

    def above_caches(plan):
        inside = None
        for line in plan.splitlines():
            depth = len(line) - len(line.lstrip(" :+-"))
            if inside is not None and depth > inside:
                continue
            inside = depth if "InMemoryTableScan" in line else None
            yield line

    monkeypatch.setattr(text_linear, "staged", seen)
    monkeypatch.setattr(text_linear, "_products", measured)
    M.out_of_fold(texts, M.on_text(M.logistic_regression(5), local_bytes=0), folds=4).collect()
    assert len(plans) > 4 and not any("Exchange" in line for p in plans[1:] for line in above_caches(p))
    assert sizes[0] == 160 * 4 and set(sizes[1:-1]) == {160 * 3} and sizes[-1] == 160


def test_texts_up_to_the_limit_keep_their_dictionary(texts):
    assert not M.on_text(M.logistic_regression(4)).together(texts)
    assert M.on_text(M.logistic_regression(4), local_bytes=0).together(texts)
    assert not hasattr(M.on_text(M.logistic_regression(4), vocabulary=10), "together")
    assert M.with_rules(M.on_text(M.logistic_regression(4), local_bytes=0)).together(texts)


def test_base_is_orthonormal():
    rng = np.random.default_rng(0)
    u = rng.normal(size=(4, 9))
    u = np.vstack([u, u[0] + u[2]])
    base, seen = text_linear._Base(6), []
    for x in u:
        at = base.add(np.array([x @ y for y in seen]), x @ x)
        seen.append(x)
        assert np.allclose(base.weights(at) @ np.array(seen), x)
    q = base.of @ u
    assert len(q) == 4 and np.allclose(q @ q.T, np.eye(4))
