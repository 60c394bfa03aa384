"""Binary classifiers behind one small contract, cross-validation, out-of-fold scores, comparison.

A *trainer* is ``trainer(train_df) -> scorer`` and a *scorer* is ``scorer(df) -> df`` with ``prob0``
and ``prob1`` added (and ``raw`` where the model has a margin). Frames carry ``key``, ``label`` and
``features`` (an ML vector); the kNN trainer reads an array column instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
import logging
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import StorageLevel, keyword_only
from pyspark.errors import IllegalArgumentException, PySparkException
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier, LinearSVC, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import (
    CountVectorizer, ElementwiseProduct, IDF, NGram, Normalizer, RegexTokenizer, SQLTransformer,
    StopWordsRemover, VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.vectors import decide
from ..session import staged
from . import linear, text_linear
from .hybrid import hybrid_scores
from .knn import knn, knn_probability
from .metrics import fold_means, leaderboard, score_table, weighted_metrics
from .splits import stratified_folds

log = logging.getLogger(__name__)

Trainer = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]
MEMORY_THEN_DISK = StorageLevel.MEMORY_AND_DISK


ROWS_PER_TASK = 20_000


def cached(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cached frame, the same rows in no more tasks than their number is worth).

    Iterative fits run one job per step, so tiny partitions would cost more than the arithmetic.
    Large inputs keep their partitions: coalescing never goes above the present number.
    """
    df = df.persist(MEMORY_THEN_DISK)
    return df, df.coalesce(max(1, math.ceil(df.count() / ROWS_PER_TASK)))


def with_features(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """``array<float>`` -> ML vector, only at the border to Spark ML."""
    return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def _with_probabilities(df: DataFrame, drop: Sequence[str]) -> DataFrame:
    p = vector_to_array("probability")
    return df.withColumns({"prob0": p[0], "prob1": p[1]}).drop("probability", *drop)


def probabilistic(build: Callable[[], Estimator]) -> Trainer:
    """Trainer from a factory of a Spark ML classifier that outputs probabilities."""
    def train(df: DataFrame):
        model = build().fit(df)
        return lambda rows: _with_probabilities(model.transform(rows), ["rawPrediction", "prediction"])

    return train


def logistic_regression(max_iter: int = 10_000) -> Trainer:
    # an L2 penalty of 1/(C*n) on the mean loss is the C=1 penalty on the summed loss
    def train(df: DataFrame):
        n = df.count()
        return probabilistic(
            lambda: LogisticRegression(maxIter=max_iter, regParam=1.0 / max(n, 1), standardization=False)
        )(df)

    def all_folds(folded: DataFrame, key: str, ids: Sequence[int]) -> DataFrame:
        rows = linear.dense(folded, "label", "fold")
        models = linear.fit(rows, [linear.Member(i) for i in ids], "logistic", lambda n: 1.0 / n, max_iter=max_iter)
        return _scored(folded, models, None, ids)

    train.all_folds = all_folds
    train.max_iter = max_iter  # a penalised logistic regression that ``on_text`` may fit without a dictionary
    return train


#: features of more places are left to Spark ML's solvers, which keep them sparse, one fold after another
MOST_DENSE = 16_384


def _width(df: DataFrame) -> int:
    first = df.select(F.size(vector_to_array("features")).alias("d")).first()
    return first["d"] if first else 0


def _scored(rows: DataFrame, models: linear.Models, params: np.ndarray | None, folds: Sequence[int | None]) -> DataFrame:
    """raw, prob0 and prob1 of every row by the model of its fold."""
    score = linear.probabilities(models, params, folds)
    fold = F.lit(-1) if list(folds) == [None] else F.col("fold").cast("int")
    p = F.col("_p")
    return rows.withColumn("_p", score(vector_to_array("features"), fold)).withColumns(
        {"raw": p["raw"], "prob0": 1.0 - p["prob1"], "prob1": p["prob1"]}).drop("_p")


def random_forest(trees: int = 100, seed: int = 10) -> Trainer:
    return probabilistic(lambda: RandomForestClassifier(numTrees=trees, seed=seed))


def decision_tree(depth: int = 10, seed: int = 10) -> Trainer:
    return probabilistic(lambda: DecisionTreeClassifier(maxDepth=depth, seed=seed))


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight`` = n / (classes * class size)."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    n = sum(counts.values())
    w = F.lit(1.0)
    for cls, c in counts.items():
        w = F.when(F.col(label) == F.lit(cls), F.lit(n / (len(counts) * c))).otherwise(w)
    return df.withColumn("weight", w)


def linear_svm(c: float = 1.0, balanced: bool = False, key: str = "row_id", folds: int = 5,
               seed: int = 42, max_iter: int = 100) -> Trainer:
    """Linear SVM with Platt probabilities.

    A one-feature logistic regression is fitted on out-of-fold margins, then the margin model is
    refitted on everything: all these models in the same pass per step.
    """
    def fitted(rows: DataFrame, outer: Sequence[int | None]) -> tuple[linear.Models, np.ndarray]:
        members = [linear.Member(i, j) for i in outer for j in [*range(folds), None]]
        stored, rows = cached(rows)
        try:
            models = linear.fit(rows, members, "hinge", lambda n: 1.0 / (c * n), balanced, max_iter)
            return models, linear.platt(rows, models, outer)
        finally:
            stored.unpersist()

    def all_folds(folded: DataFrame, key: str, ids: Sequence[int]) -> DataFrame:
        inner = stratified_folds(folded, key, "label", folds, seed, "inner")
        return _scored(folded, *fitted(linear.dense(inner, "label", "fold", "inner"), ids), ids)

    def train_dense(df: DataFrame):
        inner = stratified_folds(df, key, "label", folds, seed, "inner")
        models, params = fitted(linear.dense(inner, "label", "inner"), [None])
        return lambda rows: _scored(rows, models, params, [None])

    def svc(df: DataFrame):
        est = LinearSVC(maxIter=max_iter, regParam=1.0 / (c * max(df.count(), 1)), standardization=False)
        return (est.setWeightCol("weight") if balanced else est).fit(df)

    def margin(model, df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("raw", vector_to_array("rawPrediction")[1]).drop(
            "rawPrediction", "prediction"
        )

    def train(df: DataFrame):
        if _width(df) <= MOST_DENSE:
            return train_dense(df)
        df = balanced_weights(df) if balanced else df
        stored, folded = cached(stratified_folds(df, key, "label", folds, seed, "_platt"))
        try:
            parts = [
                margin(svc(folded.filter(F.col("_platt") != i)), folded.filter(F.col("_platt") == i))
                for i in range(folds)
            ]
            out_of_fold = reduce(DataFrame.unionByName, parts).select(
                "label", array_to_vector(F.array("raw")).alias("_margin")
            )
            platt = LogisticRegression(featuresCol="_margin").fit(out_of_fold)
            model = svc(folded)
        finally:
            stored.unpersist()

        def score(rows: DataFrame) -> DataFrame:
            out = margin(model, rows).withColumn("_margin", array_to_vector(F.array("raw")))
            return _with_probabilities(platt.transform(out), ["rawPrediction", "prediction", "_margin"])

        return score

    train.all_folds = all_folds
    return train


def fourier_features(df: DataFrame, gamma: float, dim: int = 256, seed: int = 42,
                     vector: str = "features", out: str = "features") -> DataFrame:
    """Random Fourier features of the RBF kernel exp(-gamma |x-y|^2) (Rahimi & Recht 2007)."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = b = None
        for v in batches:
            x = np.asarray(v.tolist(), dtype=np.float64)
            if w is None and len(x):
                rng = np.random.default_rng(seed)
                w = rng.normal(scale=np.sqrt(2.0 * gamma), size=(x.shape[1], dim))
                b = rng.uniform(0.0, 2.0 * np.pi, dim)
            yield pd.Series(list(np.sqrt(2.0 / dim) * np.cos(x @ w + b)) if len(x) else [], dtype=object)

    project = F.pandas_udf(run, T.ArrayType(T.DoubleType()))
    return df.withColumn(out, array_to_vector(project(vector_to_array(vector))))


def scale_gamma(df: DataFrame, vector: str = "features") -> float:
    """1 / (dimension * variance of all entries)."""
    v = vector_to_array(vector)
    stats = df.select(
        F.size(v).alias("d"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("s"),
        F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x).alias("ss"),
    ).agg(F.max("d").alias("d"), F.sum("d").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).first()
    var = stats["ss"] / stats["n"] - (stats["s"] / stats["n"]) ** 2
    return 1.0 / (stats["d"] * var) if var > 0 else 1.0


def rbf_svm(c: float = 1.0, balanced: bool = False, dim: int = 256, key: str = "row_id", **kw) -> Trainer:
    """RBF-kernel SVM, approximated by random Fourier features and a linear SVM."""
    def train(df: DataFrame):
        gamma = scale_gamma(df)
        inner = linear_svm(c, balanced, key, **kw)(fourier_features(df, gamma, dim))
        return lambda rows: inner(fourier_features(rows, gamma, dim))

    return train


#: rows that a Nystroem map is made of at most; the map is a matrix of that square
MOST_LANDMARKS = 512


def sigmoid_kernel(x: np.ndarray, y: np.ndarray, gamma: float, coef0: float = 0.0) -> np.ndarray:
    return np.tanh(gamma * (x @ y.T) + coef0)


def nystroem_map(marks: np.ndarray, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Kernel values against the landmarks times this matrix are features whose products approximate the kernel (Williams & Seeger 2000).

    Only the positive part of the landmarks' kernel matrix is used: a sigmoid is not positive definite everywhere.
    """
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    use = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
    return vectors[:, use] / np.sqrt(values[use])


def sigmoid_svm(c: float = 1.0, coef0: float = 0.0, landmarks: int = 128, key: str = "row_id", seed: int = 42, **kw) -> Trainer:
    """SVM with the kernel tanh(gamma x.y + coef0), by a Nystroem map of at most ``MOST_LANDMARKS`` training rows (those with the least
    hashes of their key) and a linear SVM."""
    def train(df: DataFrame):
        gamma = scale_gamma(df)
        some = df.select(vector_to_array("features").alias("x")).orderBy(
            F.xxhash64(F.lit(seed), F.col(key)), key).limit(min(landmarks, MOST_LANDMARKS)).collect()
        marks = np.array([r["x"] for r in some], dtype=np.float64)
        shared = df.sparkSession.sparkContext.broadcast((marks, nystroem_map(marks, lambda x, y: sigmoid_kernel(x, y, gamma, coef0))))

        @F.arrow_udf("array<double>")
        def mapped(column: pa.Array) -> pa.Array:
            at, root = shared.value
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            return pa.array(list(sigmoid_kernel(x, at, gamma, coef0) @ root) if len(x) else [], pa.list_(pa.float64()))

        def features(rows: DataFrame) -> DataFrame:
            return rows.withColumn("features", array_to_vector(mapped(vector_to_array("features"))))

        inner = linear_svm(c, key=key, seed=seed, **kw)(features(df))
        return lambda rows: inner(features(rows))

    return train


def nearest_neighbours(k: int = 10, key: str = "row_id", vector: str = "embedding", strategy: str = "auto") -> Trainer:
    def train(df: DataFrame):
        def score(rows: DataFrame) -> DataFrame:
            found = knn(rows, df, k, key=key, vector=vector, strategy=strategy)
            return rows.join(knn_probability(found), key)

        return score

    return train


def ada_boost(rounds: int = 50, seed: int = 10) -> Trainer:
    """SAMME over depth-1 trees (Zhu et al. 2009).

    A stump is a comparison on one feature, so each round's row weights are a plain expression over
    the original rows: nothing is materialised between rounds and the plan does not nest.
    """
    def stump(model):
        root = model._call_java("rootNode")
        if root.subtreeDepth() == 0:
            return lambda v: F.lit(float(root.prediction()))
        f, thr = root.split().featureIndex(), root.split().threshold()
        left, right = float(root.leftChild().prediction()), float(root.rightChild().prediction())
        return lambda v: F.when(v[f] <= F.lit(thr), F.lit(left)).otherwise(F.lit(right))

    def votes(terms, v):
        return sum((a * (2.0 * s(v) - 1.0) for a, s in terms), F.lit(0.0)) / float(sum(a for a, _ in terms))

    def train(df: DataFrame):
        stored, base = cached(df.select("label", "features", vector_to_array("features").alias("_v")))
        terms: list = []
        try:
            exponent = F.lit(0.0)
            for r in range(rounds):
                weighted = base.withColumn("weight", F.exp(exponent))
                est = DecisionTreeClassifier(maxDepth=1, seed=seed + r, weightCol="weight")
                pick = stump(est.fit(weighted))
                miss = (pick(F.col("_v")) != F.col("label").cast("double")).cast("double")
                e = weighted.agg((F.sum(F.col("weight") * miss) / F.sum("weight")).alias("e")).first()["e"]
                if e <= 0:
                    terms.append((1.0, pick))
                    break
                if e >= 0.5:
                    if not terms:
                        terms.append((1.0, pick))
                    break
                alpha = float(np.log((1.0 - e) / e))
                terms.append((alpha, pick))
                exponent = exponent + F.lit(alpha) * miss
        finally:
            stored.unpersist()

        def score(rows: DataFrame) -> DataFrame:
            d = votes(terms, vector_to_array("features"))
            return rows.withColumn("raw", d).withColumn("prob1", 1.0 / (1.0 + F.exp(-F.col("raw")))).withColumn(
                "prob0", 1.0 - F.col("prob1")
            )

        return score

    return train


class SmoothedTfIdf(Estimator, HasInputCol, HasOutputCol):
    """Spark's IDF plus one, applied to counts and L2-normalised: idf = ln((1+n)/(1+df)) + 1."""

    @keyword_only
    def __init__(self, inputCol: str = "counts", outputCol: str = "tfidf"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _fit(self, dataset: DataFrame):
        idf = IDF(inputCol=self.getInputCol(), outputCol="_idf").fit(dataset).idf.toArray() + 1.0
        return Pipeline(stages=[
            ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol=self.getInputCol(), outputCol="_weighted"),
            Normalizer(p=2.0, inputCol="_weighted", outputCol=self.getOutputCol()),
        ]).fit(dataset)


def tfidf_stages(text: str, out: str = "tfidf", min_df: int = 2, max_df: float = 0.95,
                 vocabulary: int = (1 << 31) - 1) -> list:
    """Spark ML stages text -> TF-IDF vector over words and bigrams.

    A model's dictionary and coefficients live on the driver (but see ``on_text``): raise ``min_df``, or set ``vocabulary``
    (the most frequent terms win), when the corpus has more terms than a model should. The relational
    ``features.tfidf`` has no such dictionary.
    """
    return [
        RegexTokenizer(inputCol=text, outputCol="_words", gaps=False, pattern=r"[\p{L}\p{N}_]{2,}"),
        StopWordsRemover(inputCol="_words", outputCol="_kept"),
        NGram(n=2, inputCol="_kept", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_kept, _pairs) AS _terms FROM __THIS__"),
        CountVectorizer(inputCol="_terms", outputCol="counts", minDF=min_df, maxDF=max_df, vocabSize=vocabulary),
        SmoothedTfIdf(inputCol="counts", outputCol=out),
    ]


_TFIDF_TEMPS = ("_words", "_kept", "_pairs", "_terms", "counts", "_weighted")


def placed(rows: DataFrame) -> DataFrame:
    """The rows, staged, with their ``_place`` in what was staged."""
    return staged(rows.withColumn("_place", F.monotonically_increasing_id()))


#: texts of more bytes in all have too many terms for a dictionary on the driver
MOST_LOCAL_TEXT = 16 << 20


def on_text(inner: Trainer, text: str = "text", embedding: str | None = None, local_bytes: int = MOST_LOCAL_TEXT, **tfidf_args) -> Trainer:
    """Trainer on TF-IDF features, or on TF-IDF followed by an embedding column (mixed features).

    The vocabulary is fitted on the training rows only, so it can be cross-validated as a whole. The folds of a logistic regression on texts of
    more than ``local_bytes`` are fitted together by ``text_linear``, without a dictionary; a bounded ``vocabulary`` needs one.
    """
    def train(df: DataFrame):
        stages = tfidf_stages(text, out="tfidf" if embedding else "features", **tfidf_args)
        if embedding:
            stages.append(VectorAssembler(inputCols=["tfidf", "_dense"], outputCol="features"))

        def prepared(rows: DataFrame) -> DataFrame:
            if embedding:
                rows = rows.withColumn("_dense", array_to_vector(F.col(embedding).cast("array<double>")))
            return rows.drop("features")

        model = Pipeline(stages=stages).fit(prepared(df))

        def featurize(rows: DataFrame) -> DataFrame:
            return model.transform(prepared(rows)).drop(*_TFIDF_TEMPS, "tfidf", "_dense")

        score = inner(featurize(df))
        return lambda rows: score(featurize(rows))

    def size(rows: DataFrame) -> int:
        return rows.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0

    def all_folds(folded: DataFrame, key: str, ids: Sequence[int]) -> DataFrame:
        rows = folded if "_place" in folded.columns else placed(folded)
        words = rows
        for stage in tfidf_stages(text)[:4]:
            words = stage.transform(words)
        terms = F.transform("_terms", lambda t: F.xxhash64(t))
        scores = text_linear.fold_scores(words, terms, ids, size(rows), F.col(embedding) if embedding else None, inner.max_iter, **tfidf_args)
        p = 1.0 / (1.0 + F.exp(-F.col("raw")))
        return rows.join(scores, "_place").withColumns({"prob0": 1.0 - p, "prob1": p}).drop("_place")

    if hasattr(inner, "max_iter") and "vocabulary" not in tfidf_args:
        train.all_folds = all_folds
        train.together = lambda rows: size(rows) > local_bytes
    return train


def with_rules(inner: Trainer, hit: str = "hit", hard_override: bool = False, boost_floor: float = 0.98,
               threshold: float = 0.5) -> Trainer:
    """Model plus lexicon rules; the frames carry the 0/1 lexicon flag in ``hit``."""
    def train(df: DataFrame):
        score = inner(df)
        return lambda rows: hybrid_scores(score(rows), hit, "prob1", hard_override, boost_floor, threshold)

    if hasattr(inner, "all_folds"):
        train.all_folds = lambda folded, key, ids: hybrid_scores(
            inner.all_folds(folded, key, ids), hit, "prob1", hard_override, boost_floor, threshold)
        if hasattr(inner, "together"):
            train.together = inner.together
    return train


def default_zoo(key: str = "row_id", rules: bool = False, threshold: float = 0.5) -> dict[str, Trainer]:
    """The named classifiers of the comparison. With ``rules`` the frames need a ``hit`` column."""
    zoo: dict[str, Trainer] = {
        "Logistic Regression": logistic_regression(),
        "SVM (C=0.1)": rbf_svm(0.1, key=key),
        "SVM (C=1)": rbf_svm(1.0, key=key),
        "SVM (Linear Kernel)": linear_svm(1.0, key=key),
        "SVM (Sigmoid Kernel)": sigmoid_svm(1.0, key=key),
        "Random Forest": random_forest(),
        "Nearest Neighbors": nearest_neighbours(10, key=key),
        "Decision Tree": decision_tree(),
        "AdaBoost": ada_boost(),
    }
    if rules:
        zoo["Logistic Regression+Rules"] = with_rules(logistic_regression(), threshold=threshold)
        zoo["SVM (C=1)+Rules"] = with_rules(rbf_svm(1.0, key=key), threshold=threshold)
    return zoo


def _predicted(scored: DataFrame, threshold: float) -> DataFrame:
    """Keep the rules' own prediction, otherwise threshold the probability."""
    if "prediction" in scored.columns:
        return scored
    return scored.withColumn("prediction", decide("prob1", threshold))


def out_of_fold(df: DataFrame, trainer: Trainer, key: str = "row_id", folds: int = 10, seed: int = 42,
                threshold: float = 0.5, cache: bool = True) -> DataFrame:
    """``key, label, fold, prob0, prob1, prediction`` for every row, each scored by a model that has not seen it.

    Linear models are trained for all folds at once, one job per step; others fold by fold.

    The features are cached for the fold models and stay cached for the returned plan (staged, if ``trainer`` is one on texts of more than a
    model's dictionary may come from); pass ``cache=False`` for a frame that already is.
    """
    folded = df if "fold" in df.columns else stratified_folds(df, key, "label", folds, seed)
    keep = [key, "label", "fold", "prob0", "prob1", "prediction"]
    if hasattr(trainer, "together"):
        # texts are too long for the cache: they are written once, for all that reads them
        rows = placed(folded.drop("_place")) if cache else folded
        ids = sorted(r["fold"] for r in rows.select("fold").distinct().collect())
        if len(ids) > 1 and trainer.together(rows):
            return _predicted(trainer.all_folds(rows, key, ids), threshold).select(*keep)
        folded = rows.drop("_place") if cache else folded
    if cache:
        _, folded = cached(folded)
    ids = sorted(r["fold"] for r in folded.select("fold").distinct().collect())
    if hasattr(trainer, "all_folds") and not hasattr(trainer, "together") and len(ids) > 1 and _width(folded) <= MOST_DENSE:
        return _predicted(trainer.all_folds(folded, key, ids), threshold).select(*keep)
    parts = []
    for i in ids:
        score = trainer(folded.filter(F.col("fold") != i))
        scored = _predicted(score(folded.filter(F.col("fold") == i)), threshold)
        parts.append(scored.select(*keep))
    return reduce(DataFrame.unionByName, parts)


def cross_validate(df: DataFrame, trainer: Trainer, key: str = "row_id", folds: int = 5, seed: int = 42,
                   threshold: float = 0.5, cache: bool = True) -> DataFrame:
    """One row ``mean_accuracy, mean_f1, mean_precision``: means of the weighted fold metrics.

    ``folds <= 1`` or a single class gives NULLs.
    """
    if folds <= 1 or df.select("label").distinct().count() < 2:
        null = F.lit(None).cast("double")
        return df.sparkSession.range(1).select(
            *[null.alias(f"mean_{m}") for m in ("accuracy", "f1", "precision")]
        )
    scored = out_of_fold(df, trainer, key, folds, seed, threshold, cache)
    return fold_means(weighted_metrics(scored, "label", "prediction", by=["fold"]))


def train_and_validate(df: DataFrame, trainer: Trainer, **kw):
    """(scorer fitted on all rows, cross-validation metrics)."""
    return trainer(df), cross_validate(df, trainer, **kw)


def quick_snapshot(df: DataFrame, key: str = "row_id", folds: int = 10, seed: int = 42) -> DataFrame:
    """Pooled out-of-fold predictions of a logistic regression: one row of weighted metrics."""
    scored = out_of_fold(df, logistic_regression(2000), key, folds, seed)
    return weighted_metrics(scored, "label", "prediction").select("accuracy", "precision", "recall", "f1")


def compare_models(df: DataFrame, zoo: Mapping[str, Trainer], key: str = "row_id", folds: int = 5, seed: int = 42,
                   threshold: float = 0.5, feature_set: str = "default") -> DataFrame:
    """``feature_set, classifier, mean_accuracy, mean_f1, mean_precision``; a failing model gets NULLs."""
    spark = df.sparkSession
    schema = "feature_set string, classifier string, mean_accuracy double, mean_f1 double, mean_precision double"
    stored, base = cached(df if "fold" in df.columns else stratified_folds(df, key, "label", folds, seed))
    rows = []
    for name, trainer in zoo.items():
        try:
            m = cross_validate(base, trainer, key, folds, seed, threshold, cache=False).first()
            rows.append((feature_set, name, m["mean_accuracy"], m["mean_f1"], m["mean_precision"]))
        except Exception as e:
            if isinstance(e, (Py4JError, PySparkException)) and not isinstance(e, IllegalArgumentException):
                stored.unpersist()
                raise  # of the cluster, not of the model
            log.exception("%s failed", name)
            rows.append((feature_set, name, None, None, None))
    stored.unpersist()
    return spark.createDataFrame(rows, schema)  # one row per model


def result_tables(results: DataFrame, classifiers: Sequence[str]) -> dict[str, DataFrame]:
    """Three tables (accuracy, F1, precision): feature set x classifier."""
    return {m: score_table(results, "feature_set", "classifier", f"mean_{m}", classifiers)
            for m in ("accuracy", "f1", "precision")}


def best_models(results: DataFrame, metric: str = "mean_precision", top_n: int = 3) -> DataFrame:
    return leaderboard(results, "classifier", metric, top_n)


def attach_predictions(df: DataFrame, scorer: Callable[[DataFrame], DataFrame], threshold: float = 0.5) -> DataFrame:
    """Input columns plus ``predicted_prob`` (double) and ``predicted_label`` (boolean)."""
    scored = scorer(df)
    return scored.select(
        *df.columns, F.col("prob1").alias("predicted_prob"),
        (F.col("prob1") >= F.lit(float(threshold))).alias("predicted_label"),
    )
