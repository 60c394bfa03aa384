"""Approximate neighbours against brute force, and the sigmoid kernel's map against the full matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators import ann, knn, models as M


def rows_of(x):
    return [(i, [float(t) for t in v], "clash") for i, v in enumerate(x)]


@pytest.fixture(scope="module", params=["clusters", "noise"])
def points(request):
    rng = np.random.default_rng(2)
    if request.param == "noise":  # lists rule nothing out here
        return rng.normal(size=(900, 12))
    x = np.concatenate([rng.normal(c, 0.3, size=(150, 8)) for c in range(0, 12, 2)])
    return np.concatenate([x, np.repeat(x[:1], 300, axis=0)])  # a third are copies of one row


@pytest.mark.parametrize("block", [4096, 40])
def test_recall_and_distances(spark, points, block, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", block)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", block)
    df = spark.createDataFrame(rows_of(points), "id bigint, embedding array<double>, cell string").repartition(3)
    index = ann.Index(df, 5)
    got = {}
    for r in index.search(df.filter("id % 10 = 0")).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["neighbour"], r["distance"]))
    assert set(got) == set(range(0, len(points), 10)) and all(len(v) == 5 for v in got.values())
    found = 0
    for i, near in got.items():
        d = np.sqrt(((points - points[i]) ** 2).sum(1))
        assert np.allclose([x for _, x in near], [d[j] for j, _ in near], atol=1e-9) and [x for _, x in near] == sorted(x for _, x in near)
        true = sorted(range(len(points)), key=lambda j: (d[j], j))[:5]
        found += sum(x <= d[true[-1]] + 1e-9 for _, x in near)
    assert found >= 0.9 * 5 * len(got)
    if block == 4096 and len(points) == 1200:
        assert index.probes < len(index.centres)


def test_odd_indexes(spark):
    schema = "id bigint, embedding array<double>"
    none = spark.createDataFrame([], schema)
    some = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [0.0, 1.0])], schema)
    assert ann.Index(none).search(some).count() == 0 and ann.Index(some).search(none).count() == 0
    got = [tuple(r) for r in ann.Index(some, 5).search(some).orderBy("id", "rank").collect()]
    assert got == [(1, 1, 1, 0.0), (1, 2, 3, 0.0), (3, 1, 1, 0.0), (3, 2, 3, 0.0)]


def test_search_shuffles_each_row_once(spark, monkeypatch):
    """Neither queries are repeated for the lists they probe nor rows for the blocks of queries, and keys may be of any kind, repeated or NULL."""
    x = np.random.default_rng(3).normal(size=(400, 6))
    monkeypatch.setattr(ann, "BLOCK_ROWS", 30)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 30)
    packs = []

    def watched(kept):
        def run(frame):
            packs.append(kept(frame))
            return packs[-1]
        return run

    monkeypatch.setattr(ann, "staged", watched(ann.staged))
    monkeypatch.setattr(knn, "staged", watched(knn.staged))
    monkeypatch.setattr(ann, "discard", lambda *frames: None)
    rows = [(None if i == 7 else i, [float(t) for t in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>").repartition(3)
    index = ann.Index(df, 4)
    names = [(None if i == 5 else "twice" if i in (8, 9) else f"q{i}", v) for i, (_, v) in enumerate(rows)]
    queries = spark.createDataFrame(names, "name string, embedding array<double>")
    got = {}
    for r in index.search(queries, "name", probes=len(index.centres)).orderBy("name", "rank").collect():
        got.setdefault(r["name"], []).append((r["id"], r["distance"]))
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    for i, (name, _) in enumerate(names):
        near = np.sort(d[i])[:4] if name != "twice" else np.sort(np.concatenate([d[8], d[9]]))[:4]
        assert [t for _, t in got[name]] == pytest.approx(near.tolist())
    assert got["q7"][0] == (None, 0.0) and got["q6"][0] == (6, 0.0) and got[None][0] == (5, 0.0)
    lists, blocks = [f for f in packs if "sub" in f.columns]
    assert sum(len(r["id"]) // 8 for r in lists.collect()) == 400
    packed = blocks.collect()
    assert sum(len(r["keys"]) for r in packed) == sum(len(r["vec"]) // 48 for r in packed) == 400
    assert len(packed) > 5 and max(len(r["keys"]) for r in packed) < 100


def test_sample_is_of_the_least_hashes(spark, monkeypatch):
    """Tasks send few more rows than are wanted, also where one key has most of the rows."""
    wide = spark.range(6000).select(F.when(F.col("id") < 3000, F.col("id")).otherwise(7).alias("id"), F.array(F.col("id").cast("double")).alias("vec"))
    sent = []
    limit = type(wide).limit
    monkeypatch.setattr(type(wide), "limit", lambda self, n: sent.append(self.count()) or limit(self, n))
    for df in (wide.filter("id <> 7"), wide):
        ids, x = ann._sample(df, "id", "vec", 50, "s", df.count())
        h = [r["id"] for r in df.select("id", F.xxhash64(F.lit("s"), "id").alias("h")).orderBy("h", "id").collect()]
        assert ids == h[:50] and x.shape == (50, 1)
    assert sent[0] < 300


def test_sigmoid_map_approximates_the_kernel():
    x = np.random.default_rng(0).normal(size=(300, 5))
    kernel = lambda a, b: M.sigmoid_kernel(a, b, 0.05)
    whole = kernel(x, x)

    def error(n):
        f = kernel(x, x[:n]) @ M.nystroem_map(x[:n], kernel)
        return np.abs(f @ f.T - whole).mean() / np.abs(whole).mean()

    values = np.linalg.eigvalsh(whole)
    assert error(5) > error(40) > 0.9 * error(300) and error(40) < 0.05 + 2 * np.abs(values[values < 0]).sum() / np.abs(values).sum()
    assert M.nystroem_map(x[:0], kernel).shape == (0, 0)


def test_sigmoid_svm_separates(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(-1, 0.4, (60, 3)), rng.normal(1, 0.4, (60, 3))])
    df = M.with_features(spark.createDataFrame([(i, v.tolist(), int(i >= 60)) for i, v in enumerate(x)],
                                               "row_id bigint, embedding array<double>, label int"))
    out = M.out_of_fold(df, M.sigmoid_svm(landmarks=30, folds=2, max_iter=6), folds=2).collect()
    assert np.mean([r["prediction"] == r["label"] for r in out]) > 0.95
