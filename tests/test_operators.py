"""Operators against brute force on small frames, including skewed ones."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F
import pytest

from labelloom.operators import (
    audit, features, joins, knn, lexicon, matching, metrics, pivot, ranking, roc, scoring, splits, tasks,
)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- matching -----------------------------------------------------------------------------------

TEXTS = ["abcabc", "", None, "贵州人和abc🐶", "🐶🐶 b\x00c", "aaaa", "x" * 70 + "abc" + "x" * 90]
TERMS = ["abc", "a", "贵州", "🐶", "aa", "zzz", "abcx", "b\x00", ""]


def brute_pairs():
    return sorted((i, t) for i, s in enumerate(TEXTS) for t in set(TERMS) if t and s and t in s)


@pytest.mark.parametrize("strategy", ["array", "automaton", "join"])
def test_matching_strategies_agree(spark, strategy):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").repartition(3)
    terms = spark.createDataFrame([(t,) for t in TERMS + TERMS], "term string")
    assert rows(matching.matched_terms(texts, "t", terms, strategy=strategy)) == brute_pairs()
    flags = dict(rows(matching.flag_any_term(texts, "t", terms, "id", strategy=strategy).select("id", "hit")))
    assert flags == {i: int(any(p[0] == i for p in brute_pairs())) for i in range(len(TEXTS))}
    want = sorted((t, len(list(g))) for t, g in itertools.groupby(sorted(p[1] for p in brute_pairs())))
    assert rows(matching.term_hit_counts(texts, "t", terms, strategy=strategy)) == want


def test_matching_many_random_terms(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    texts = [word(rng.randint(0, 200)) for _ in range(60)] + ["abca" * 40] * 40  # a third are copies
    terms = sorted({word(rng.randint(1, 6)) for _ in range(200)})
    tdf = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    ldf = spark.createDataFrame([(t,) for t in terms], "term string")
    want = sorted((t, sum(t in s for s in texts)) for t in terms if any(t in s for s in texts))
    for strategy in ("automaton", "join"):
        assert rows(matching.term_hit_counts(tdf, "t", ldf, strategy=strategy)) == want


def test_term_list_refuses_oversized_broadcast(spark, monkeypatch):
    terms = matching.TermList(spark.createDataFrame([("abc",), ("de",)], "term string"))
    monkeypatch.setattr(matching, "AUTOMATON_NODES", 3)
    monkeypatch.setattr(matching, "ARRAY_TERMS", 0)
    assert terms.strategy() == "join"
    with pytest.raises(ValueError):
        terms.collect()


def test_lexicon_cleaning(spark):
    corpus = spark.createDataFrame(
        [(1, "good catfish", "None"), (2, "badword here", "Potentially"), (3, "badword and ab", "Potentially"),
         (4, "badword x, rude, grp", "Potentially"), (5, "rude rude", "Potentially"), (6, "rude grp", "Potentially"),
         (7, "grp", "Possible"), (8, "qq", "Potentially"), (9, "qq qq", "Potentially"), (10, "qq", "Potentially")],
        "id int, sentence string, label string")
    lex = spark.createDataFrame(
        [("cat", "animal", "a"), ("badword", "plain", "a"), ("x", "one", "a"), ("qq", "latin", "a"),
         ("rude", "本意 kind", "a"), ("grp", "plain", "Others"), ("none", "ok", "a")],
        "term string, definition string, category string")
    staged = lexicon.lexicon_with_stages(lex, corpus)
    stage = {r.term: r.stage for r in staged.collect()}
    assert stage == {"cat": 0, "x": 1, "qq": 2, "rude": 3, "none": 4, "grp": 5, "badword": 6}
    assert [r.terms for r in lexicon.funnel(staged).orderBy("stage").collect()] == [7, 6, 5, 4, 3, 2, 1]
    cleaned = lexicon.clean_lexicon(staged)
    cov = {r.label: (r.rows, r.hits, r.pct) for r in lexicon.coverage(corpus, "sentence", "label", cleaned, "id").collect()}
    assert cov == {"None": (1, 0, 0.0), "Potentially": (8, 3, 37.5)}
    assert rows(lexicon.terms_without_class(lex, corpus, "sentence", "label").select("term")) == sorted(
        (t,) for t in stage if t != "cat")


def test_nfkc_lower_and_usable_terms(spark):
    df = spark.createDataFrame([("ＡＢｃ",), (None,), (" b ",), ("b",), ("",)], "term string")
    assert [r[0] for r in df.select(lexicon.nfkc_lower("term")).collect()] == ["abc", "", " b ", "b", ""]
    assert rows(lexicon.usable_terms(df)) == [("b",), ("ＡＢｃ",)]


# --- ranking and splits ---------------------------------------------------------------------------

def test_hash_rank_is_a_permutation_per_class(spark):
    df = spark.range(500).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    ranked = ranking.hash_rank(df, "id", 7, within=["y"]).collect()
    for y in (0, 1):
        mine = [r for r in ranked if r.y == y]
        assert sorted(r.rank for r in mine) == list(range(1, len(mine) + 1))
        assert {r.rank_total for r in mine} == {len(mine)}


def test_folds_and_splits(spark):
    df = spark.range(103).withColumn("y", (F.col("id") < 20).cast("int"))
    folds = splits.stratified_folds(df, "id", "y", 4).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in folds if r.y == y]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1
    got = dict(rows(splits.shuffle_split(df, "id", 0.3, 0.3).groupBy("split").count()))
    assert got == {"train": 43, "val": 30, "test": 30}
    got = rows(splits.stratified_split(df, "id", "y").groupBy("y", "split").count())
    assert got == [(0, "dev", 17), (0, "test", 17), (0, "train", 49), (1, "dev", 4), (1, "test", 4), (1, "train", 12)]
    assert splits.sample_rows(df, "id", 10).count() == 10 and splits.sample_rows(df, "id", 999).count() == 103
    assert [r.id for r in splits.first_rows(df, "id", 3).collect()] == [0, 1, 2]


@pytest.mark.parametrize("values", [
    [i * 0.37 % 1 for i in range(400)],
    [0.5] * 200 + [i / 400 for i in range(200)],           # half of the rows are one value
    [0.1] * 400,
    [1e-300 * i for i in range(200)] + [1e300] * 200,       # a range no equal-width bucket can split at once
])
@pytest.mark.parametrize("k", [1, 57, 399, 400, 500])
def test_smallest_k_by_count(spark, values, k):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    want = sorted((v, i) for i, v in enumerate(values))[:k]
    assert rows(ranking.smallest_k_by_count(df, k, "v", "id").select("v", "id")) == want
    assert rows(ranking.smallest_k(df, k, "v", "id").select("v", "id")) == want


def test_sample_by_count_equals_sample_by_sort(spark, monkeypatch):
    df = spark.range(3000)
    plain = rows(splits.sample_rows(df, "id", 700))
    monkeypatch.setattr(splits, "SMALL_LIMIT", 10)
    monkeypatch.setattr(ranking, "SMALL_LIMIT", 10)
    assert rows(splits.sample_rows(df, "id", 700)) == plain


# --- metrics --------------------------------------------------------------------------------------

def test_binary_and_weighted(spark):
    pairs = [(1, 1)] * 3 + [(1, 0)] * 2 + [(0, 1)] + [(0, 0)] * 4
    df = spark.createDataFrame(pairs, "y int, p int")
    b = metrics.binary_metrics(df, "y", "p").first()
    assert (b.accuracy, b.precision, b.f1) == pytest.approx((0.7, 0.75, 2 * 3 / 9))
    w = metrics.weighted_metrics(df, "y", "p").first()
    assert w.precision == pytest.approx((5 * 3 / 4 + 5 * 4 / 6) / 10) and w.recall == pytest.approx(0.7)
    never = metrics.binary_metrics(spark.createDataFrame([(1, 0)], "y int, p int"), "y", "p").first()
    assert (never.precision, never.f1) == (0.0, 0.0)


def test_multilabel_invariants(spark):
    rng = random.Random(3)
    ids = list("456789") + ["0", "q", "w"]
    data = [([i for i in ids if rng.random() < 0.3], [i for i in ids if rng.random() < 0.3] + ["zz"]) for _ in range(50)]
    df = spark.createDataFrame(data, "g array<string>, p array<string>")
    m = metrics.multilabel_metrics(df, "g", "p").first().asDict()
    assert m["hamming_loss"] == pytest.approx(1 - m["macro_accuracy"])
    assert m["macro_f1"] == pytest.approx(np.mean([v for k, v in m.items() if k.startswith("f1_")]))
    assert m["subset_accuracy"] == pytest.approx(np.mean([set(g) == set(p) - {"zz"} for g, p in data]))
    long = {r.label_id: r for r in metrics.multilabel_by_label(df, "g", "p").collect()}
    tp = sum("7" in g and "7" in p for g, p in data)
    assert long["7"].precision == pytest.approx(tp / sum("7" in p for _, p in data))


def brute_auc(y, s):
    pos, neg = [v for v, t in zip(s, y) if t], [v for v, t in zip(s, y) if not t]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("buckets", [2, 64])
def test_roc_and_auc(spark, buckets):
    rng = random.Random(5)
    y = [rng.randint(0, 1) for _ in range(200)]
    a = [round(rng.random() + 0.2 * t, 2) for t in y]
    b = [0.5 if i % 3 else round(rng.gauss(0, 1), 1) for i in range(200)]  # two thirds are ties
    df = spark.createDataFrame([(t, u, str(v) if v != 0.5 else "0.5", None) for t, u, v in zip(y, a, b)],
                               "y int, a double, b string, c double").repartition(3)
    auc = {r.category: r.auc for r in roc.auc_by_score(df, "y", ["a", "b", "c"], buckets=buckets).collect()}
    assert auc == pytest.approx({"a": brute_auc(y, a), "b": brute_auc(y, b)})
    pts = sorted((r.fpr, r.tpr, -r.threshold) for r in roc.roc_points(df, "y", ["a"], buckets=buckets).collect())
    assert len(pts) == len(set(a)) + 1 and pts[0][:2] == (0.0, 0.0) and pts[-1][:2] == (1.0, 1.0)
    for fpr, tpr, t in pts[1:]:
        assert tpr == pytest.approx(sum(u >= -t and q for u, q in zip(a, y)) / sum(y))
        assert fpr == pytest.approx(sum(u >= -t and not q for u, q in zip(a, y)) / (len(y) - sum(y)))
    thin = sorted((r.fpr, r.tpr) for r in roc.roc_points(df, "y", ["a"], drop_collinear=True, buckets=buckets).collect())
    area = lambda p: sum((x2 - x1) * (y1 + y2) / 2 for (x1, y1), (x2, y2) in zip(p, p[1:]))
    assert len(thin) <= len(pts) and area(thin) == pytest.approx(auc["a"])
    flipped = df.withColumn("a", 1 - F.col("a"))
    assert roc.auc_by_score(flipped, "y", ["a"]).first().auc == pytest.approx(1 - auc["a"])


def test_score_columns(spark):
    df = spark.createDataFrame([("q", "l", 1.0)], "Question string, y string, hate double")
    assert roc.score_columns(df, "y") == ["hate"]


def test_texts_of_a_batch_are_matched_in_runs_of_bounded_size(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(matching, "TEXT_BYTES", 100)
    texts = ["x" * n for n in (30, 0, 40, 250, 10, 20, 90, 5)] + [None]
    batch = pa.record_batch([pa.array(texts), pa.array(range(len(texts)))], names=["text", "at"])
    runs = [run.column(0).to_pylist() for run in matching._slices(batch)]
    assert [t for run in runs for t in run] == texts
    assert all(len(run) == 1 or sum(len(t or "") for t in run[1:]) <= 100 for run in runs) and len(runs) == 3
    assert list(matching._slices(batch.slice(0, 0))) == []


# --- nearest neighbours ---------------------------------------------------------------------------

def brute_knn(points, folds, k):
    out = {}
    for i, (p, f) in enumerate(zip(points, folds)):
        cand = sorted((sum((a - b) ** 2 for a, b in zip(p, q)), j) for j, (q, g) in enumerate(zip(points, folds)) if g != f)
        out[i] = [j for _, j in cand[:k]]
    return out


@pytest.mark.parametrize("strategy,block", [("broadcast", 4096), ("blocks", 4096), ("blocks", 16)])
def test_knn_exact_with_copies(spark, strategy, block):
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(size=(60, 4)), rng.normal(size=(60, 4)) + 8, np.tile([[1.0, 2.0, 3.0, 4.0]], (60, 1))])
    folds = [i % 3 for i in range(len(points))]  # a third of the rows are copies of one vector
    df = spark.createDataFrame([(i, p.tolist(), i % 2, f) for i, (p, f) in enumerate(zip(points, folds))],
                               "id long, embedding array<double>, label int, fold int").repartition(4)
    near = knn.knn(df, df, 5, fold="fold", strategy=strategy, block_rows=block, pivots=6)
    got = {r.id: [n.id for n in r.neighbours] for r in near.collect()}
    assert got == brute_knn(points.tolist(), folds, 5)
    prob = {r.id: r.prob1 for r in knn.knn_probability(near).collect()}
    assert prob[0] == pytest.approx(np.mean([j % 2 for j in got[0]]))


def test_knn_blocks_shuffle_no_row_per_block_pair(spark, monkeypatch):
    """Each side is packed once: rows are not repeated for the blocks of the other side, and few parts give k rows per query."""
    from labelloom.operators import knn as module

    rng = np.random.default_rng(1)
    points = rng.normal(size=(300, 4))
    df = spark.createDataFrame([(i, p.tolist(), i % 2) for i, p in enumerate(points)],
                               "id long, embedding array<double>, label int")
    seen = []

    def watched(frame):
        seen.append(kept(frame))
        return seen[-1]

    kept = module.staged
    monkeypatch.setattr(module, "staged", watched)
    monkeypatch.setattr(module, "discard", lambda *frames: None)
    near = knn.knn(df, df, 3, strategy="blocks", block_rows=8, pivots=3).collect()
    d = ((points[:, None, :] - points[None, :, :]) ** 2).sum(2)
    assert {r.id: [n.id for n in r.neighbours] for r in near} == {i: np.argsort(x, kind="stable")[:3].tolist() for i, x in enumerate(d)}
    packs = [f for f in seen if "sub" in f.columns]
    assert len(packs) == 2
    for f in packs:
        assert sum(len(r["id"]) // 8 for r in f.collect()) == 300


def test_knn_folds_send_no_large_training_side_to_the_driver(spark, monkeypatch):
    """Cross-validation with training sides of 18 MB each: only the pivots of each fold reach the driver."""
    from labelloom.operators import models

    value = lambda i: F.sin(F.col("row_id") * 7.7 + i * (1 + F.col("row_id") % 13))
    df = spark.range(900, numPartitions=4).select(
        F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 4 >= 2).cast("int").alias("fold"),
    ).withColumn("embedding", F.transform(F.sequence(F.lit(0), F.lit(4999)), value))
    sent, whole = [], type(df).toPandas

    def watched(self):
        out = whole(self)
        sent.append(len(out))
        return out

    monkeypatch.setattr(type(df), "toPandas", watched)
    got = {r["row_id"]: r["prob1"] for r in models.out_of_fold(df, models.nearest_neighbours(3), cache=False).select("row_id", "prob1").collect()}
    assert sent == [32, 32]
    i = np.arange(900)
    x = np.sin(i[:, None] * 7.7 + np.arange(5000)[None, :] * (1 + i[:, None] % 13))
    fold = i % 4 >= 2
    for at in range(0, 900, 50):
        d = np.where(fold != fold[at], ((x - x[at]) ** 2).sum(1), np.inf)
        assert got[at] == pytest.approx(np.mean(np.argsort(d, kind="stable")[:3] % 2))


def test_knn_without_enough_training_rows(spark):
    df = spark.createDataFrame([(0, [0.0], 1, 0), (1, [1.0], 0, 0)], "id long, embedding array<double>, label int, fold int")
    for strategy in ("broadcast", "blocks"):
        got = {r.id: r.neighbours for r in knn.knn(df, df, 3, fold="fold", strategy=strategy).collect()}
        assert got == {0: [], 1: []}
        assert {r.id: len(r.neighbours) for r in knn.knn(df, df, 3, strategy=strategy).collect()} == {0: 2, 1: 2}


# --- features -------------------------------------------------------------------------------------

@pytest.mark.parametrize("hot_terms", [2, 10_000])
def test_tfidf_against_python(spark, monkeypatch, hot_terms):
    monkeypatch.setattr(features, "HOT_TERMS", hot_terms)  # 2: some terms take the shuffle join
    docs = ["The cat and the dog", "cat cat bird", "dog_1 bird cat", "x yy", "", "猫 bird"] + ["cat bird"] * 5
    df = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    def terms(s):
        w = [t for t in __import__("re").findall(r"\w{2,}", s.lower()) if t not in ("the", "and")]
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    tf = [{t: terms(s).count(t) for t in terms(s)} for s in docs]
    dfreq = {t: sum(t in d for d in tf) for d in tf for t in d}
    keep = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in dfreq.items() if 2 <= n <= 0.95 * len(docs)}
    want = {}
    for i, d in enumerate(tf):
        v = {t: c * keep[t] for t, c in d.items() if t in keep}
        norm = math.sqrt(sum(x * x for x in v.values()))
        want.update({(i, t): x / norm for t, x in v.items()})
    for strategy in ("broadcast", "shuffle"):
        got = {(r.id, r.term): r.weight for r in
               features.tfidf(df, "id", "text", stop_words=("the", "and"), strategy=strategy).collect()}
        assert got == pytest.approx(want)


def test_tfidf_cuts_a_single_partition_once_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(features, "HOT_TERMS", 1)
    df = spark.createDataFrame([(i, f"word{i % 7} other{i % 5} rare{i}") for i in range(60)], "id int, text string").coalesce(1)
    found = features.tfidf(df, "id", "text", stop_words=())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "Repartition " in plan
    assert {r.term: r.df for r in found.collect() if r.term.startswith("word")}["word0"] == 9


@pytest.mark.parametrize("hot_terms", [1, 1000])
def test_tfidf_counts_hot_terms_whole(spark, monkeypatch, hot_terms):
    monkeypatch.setattr(features, "HOT_TERMS", hot_terms)  # none is hot, or all are
    df = spark.createDataFrame([(None if i % 9 == 0 else i % 50, "same words") for i in range(200)] + [(7, None), (8, "other one")],
                               "id int, text string")
    got = {(r.id, r.term, r.tf, r.df) for r in features.tfidf(df, "id", "text", max_df=1.0, stop_words=()).collect()}
    assert {x[1:] for x in got} == {(t, 1, 200) for t in ("same", "words", "same words")} and len(got) == 3 * 51


@pytest.mark.parametrize("hot_terms", [1, 3, 1000])
@pytest.mark.parametrize("keys", ["unique", "repeated"])
def test_tfidf_over_many_chunks_and_parts(spark, monkeypatch, hot_terms, keys):
    monkeypatch.setattr(features, "HOT_TERMS", hot_terms)
    monkeypatch.setattr(features, "CHUNK_ROWS", 3)
    monkeypatch.setattr(features, "PART_BYTES", 64)
    rng = np.random.default_rng(1)
    docs = [" ".join(rng.choice([f"w{j}" for j in range(12)] + ["été", "x", "猫猫"], size=int(rng.integers(0, 9)))) for _ in range(60)]
    ids = list(range(60)) if keys == "unique" else [None if i % 7 == 0 else i % 20 for i in range(60)]
    df = spark.createDataFrame(list(zip(ids, [None if i == 4 else d for i, d in enumerate(docs)])), "id int, text string").coalesce(2)
    found = features.tfidf(df, "id", "text", min_df=2, max_df=0.3, stop_words=("w0",))
    # rows of a key of its own are not brought together for their norm
    assert ("Window" in found._jdf.queryExecution().optimizedPlan().toString()) == (keys == "repeated")

    def terms(s):
        w = [t for t in __import__("re").findall(r"\w{2,}", s) if t != "w0"]
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    tf = [{t: terms(s).count(t) for t in terms(s)} if i != 4 else {} for i, s in enumerate(docs)]
    df_of = {t: sum(t in d for d in tf) for d in tf for t in d}
    want, norm = [], {}
    for i, d in zip(ids, tf):
        for t, c in d.items():
            if 2 <= df_of[t] <= 0.3 * 60:
                x = c * (math.log(61 / (1 + df_of[t])) + 1)
                norm[i] = norm.get(i, 0.0) + x * x
                want.append((i, t, c, df_of[t], x))
    def order(r):
        return str(r[0]), *r[1:]
    want = sorted([(*r[:4], r[4] / math.sqrt(norm[r[0]])) for r in want], key=order)
    got = sorted([tuple(r) for r in found.collect()], key=order)
    assert [r[:4] for r in got] == [r[:4] for r in want] and [r[4] for r in got] == pytest.approx([r[4] for r in want])


def test_embed_dedupes_and_keeps_rows(spark):
    texts = ["same"] * 30 + [f"t{i}" for i in range(30)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    enc = features.NgramHashEncoder(16)
    got = {r.id: list(r.embedding) for r in features.embed(df, "text", enc, ("{text}", "a {text}"), dim=8).collect()}
    plain = {r.id: list(r.embedding) for r in features.embed(df, "text", enc, ("{text}", "a {text}"), dim=8, dedupe=False).collect()}
    assert got == plain and len(got) == len(texts) and {len(v) for v in got.values()} == {16}
    with pytest.raises(Exception, match="exceeds vector size"):
        features.embed(df, "text", enc, dim=99).collect()


# --- joins, fan-out, pivot --------------------------------------------------------------------------

def test_lookup_and_skewed_lookup(spark):
    right = spark.createDataFrame([("1", 5, "late"), ("1", 2, "first"), ("2", 1, "two")], "k string, o int, v string")
    left = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "k int, x string")
    assert rows(joins.lookup_first(left, right, "k", "o").select("k", "x", "v")) == [("1", "a", "first"), ("1", "b", "first")]
    big = spark.range(300).select((F.when(F.col("id") < 100, 0).otherwise(F.col("id"))).alias("k"), "id")
    dim = spark.range(0, 300, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    assert joins.heavy_keys(big, "k", 0.1) == [0]
    assert rows(joins.skewed_lookup(big, dim, "k", 0.1)) == rows(big.join(dim, "k"))
    assert rows(joins.skewed_lookup(big, dim, "k", 0.1, "left").fillna(-1)) == rows(big.join(dim, "k", "left").fillna(-1))


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "k string, z double, y double")
    new = spark.createDataFrame([("b", None, 7.0), ("c", 8.0, 9.0)], "k string, z double, w double")
    out = joins.upsert(old, new, "k")
    assert out.columns == ["k", "w", "y", "z"]
    assert {r.k: (r.w, r.y, r.z) for r in out.collect()} == {
        "a": (None, 2.0, 1.0), "b": (7.0, 4.0, None), "c": (9.0, None, 8.0)}


def test_task_fanout(spark):
    base = dict(extracted_text="t", promise_status=None, evidence_status=None, verification_timeline=None,
                evidence_quality=None, evidence_string=None, promise_string=None)
    recs = [dict(base, id=1), dict(base, id=2, promise_status="Yes"),
            dict(base, id=3, promise_status="Yes", promise_string="p", evidence_status="Yes", evidence_string="e"),
            dict(base, id=4, promise_status="Yes", promise_string="p", evidence_status="Yes", evidence_quality="Clear"),
            dict(base, id=5, promise_status="No", evidence_status="Yes")]
    schema = "id int, " + ", ".join(f"{k} string" for k in base)
    df = spark.createDataFrame([[r[k] for k in ("id", *base)] for r in recs], schema)
    got = {}
    for r in tasks.six_tasks(df, "id").collect():
        got.setdefault(r.id, []).append((r.task, r.x, r.y))
    assert got[1] == [("promise_status", "t", "No")] and got[5] == [("promise_status", "t", "No")]
    assert sorted(got[2]) == [("evidence_status", "t", "No"), ("verification_timeline", "t", "No")]
    assert sorted(got[3]) == sorted([
        ("promise_status", "t", "Yes"), ("promise_status", "p", "Yes"), ("promise_string", "t", "p"),
        ("evidence_status", "t", "Yes"), ("evidence_status", "e", "Yes"), ("evidence_string", "t", "e"),
        ("evidence_quality", "t", "N/A"), ("verification_timeline", "t", "No")])
    assert ("evidence_quality", "t", "Clear") in got[4] and not [x for x in got[4] if x[0] == "evidence_status"]
    four = rows(tasks.four_tasks(df.withColumnRenamed("extracted_text", "data"), "id").filter("id = 3").select("task", "y"))
    assert four == [("evidence_quality", "N/A"), ("evidence_status", "Yes"), ("promise_status", "Yes"), ("verification_timeline", "N/A")]


def test_pivot(spark):
    df = spark.createDataFrame([(1, {"a b": 0.5}), (2, {}), (3, {"c & d": 1.0, "a b": 0.25})], "id int, scores map<string,double>")
    wide = pivot.widen_scores(df)
    assert wide.columns == ["id", "a_b_confidence", "c_and_d_confidence"]
    assert {r.id: tuple(r)[1:] for r in wide.collect()} == {1: (0.5, None), 2: (None, None), 3: (0.25, 1.0)}
    assert {r.id: r.a_b_confidence for r in pivot.widen_scores(df, as_text=True).collect()} == {1: "0.5", 2: "", 3: "0.25"}


# --- audit ----------------------------------------------------------------------------------------

def audit_frame(spark, probs):
    return spark.createDataFrame([(i, f"t{i}", "None", 0, 1 - p, p) for i, p in enumerate(probs)],
                                 "row_index long, text string, label_raw string, label int, prob0 double, prob1 double")


def test_issue_report_rules(spark):
    df = audit_frame(spark, [0.71, 0.70, 0.2, 0.95, 0.99])
    ignore = spark.createDataFrame([(3,)], "row_index long")
    flagged = lambda rep: [r.row_index for r in rep.filter("suspicious").orderBy("row_index").collect()]
    assert flagged(audit.issue_report(df)) == [0, 3, 4]
    assert flagged(audit.issue_report(df, ignore)) == [0, 4]
    assert flagged(audit.issue_report(df, top_n=1)) == [0]
    assert flagged(audit.issue_report(df, top_n=1, rank="confidence")) == [4]
    ranged = audit.issue_report(df, row_min=1, row_max=3)
    assert flagged(ranged) == [3] and ranged.count() == 3
    assert [r.row_index for r in audit.drop_suspicious(df, ranged).orderBy("row_index").collect()] == [0, 1, 2, 4]
    assert [r.row_index for r in audit.ranked_report(audit.issue_report(df)).collect()] == [4, 3, 0, 1, 2]


@pytest.mark.parametrize("n", [0, 1, 100, 101, 250])
def test_least_certain(spark, n):
    rng = random.Random(n)
    probs = [rng.choice([0.5, 0.505, 0.509, 0.51, 0.7, 0.3]) for _ in range(n)]
    df = audit_frame(spark, probs) if n else audit_frame(spark, [0.5]).limit(0)
    df = df.withColumn("prediction", (F.col("prob1") >= 0.5).cast("int"))
    conf = sorted((p if p >= 0.5 else 1 - p, i) for i, p in enumerate(probs))
    want = [i for c, i in conf[:max(1, math.ceil(0.01 * n))] if c < 0.51] if n else []
    assert [r.row_index for r in audit.least_certain(df, "row_index").orderBy("self_confidence", "row_index").collect()] == want


def test_confident_learning(spark):
    df = spark.createDataFrame([(1, 0, 0.9, 0.1), (2, 0, 0.8, 0.2), (3, 0, 0.1, 0.9), (4, 1, 0.2, 0.8), (5, 1, 0.9, 0.1)],
                               "id long, label int, prob0 double, prob1 double")
    got = {r.id: (r.suggested, r.self_confidence) for r in audit.confident_learning(df, "id").collect()}
    assert got == {3: (1, 0.1), 5: (0, 0.1)}


# --- scoring --------------------------------------------------------------------------------------

def test_score_rows_retries_and_failures(spark):
    def scorer(text, model):
        if "bad" in text or (text == "flaky" and model == "a"):
            raise RuntimeError
        return {"hate": float(len(text)), "extra": 1.0}

    df = spark.createDataFrame([(1, "ok", 9.0), (2, "", None), (3, None, None), (4, "bad", 1.0), (5, "flaky", 2.0)],
                               "id int, text string, hate double")
    out = scoring.score_rows(df, scorer, "text", ("hate", "violence"), models=("a", "b"), pause=0, threads=2)
    assert out.columns == ["id", "text", "hate", "violence"]
    assert {r.id: r.hate for r in out.collect()} == {1: 2.0, 2: None, 3: None, 4: None, 5: 5.0}


def test_complete_rows(spark):
    def completer(prompt, message):
        if "fail" in message:
            raise RuntimeError("boom")
        return {"content": "", "reasoning_content": '{"groups": ["7"]}'} if prompt == "p2" else '{"groups": ["4"]}'

    df = spark.createDataFrame([("a", "x"), ("b", "fail")], "idx string, text string")
    got = {(r.idx, r.prompt_name): (r.groups, r.error_msg) for r in
           scoring.complete_rows(df, {"basic": "p1", "optimized": "p2"}, completer, threads=2).collect()}
    assert got == {("a", "basic"): (["4"], ""), ("a", "optimized"): (["7"], ""),
                   ("b", "basic"): ([], "completion error: boom"), ("b", "optimized"): ([], "completion error: boom")}


def test_array_strategy_has_a_limit(spark):
    many = spark.range(600).selectExpr("cast(id as string) AS term")
    with pytest.raises(ValueError):
        matching.term_hit_counts(spark.createDataFrame([("1",)], "t string"), "t", many, strategy="array")


def test_every_distinct_text_is_encoded_once(spark):
    from labelloom.operators import features

    seen = spark.sparkContext.accumulator(0)
    base = features.NgramHashEncoder(8)

    def counting(texts):
        seen.add(len(texts))
        return base(texts)

    df = spark.createDataFrame([(i, "hot" if i % 2 else f"text {i}") for i in range(400)], "id int, t string")
    out = features.embed(df, "t", counting, templates=("{text}", "say {text}"))
    assert "MapInPandas" in out._jdf.queryExecution().toString()
    assert out.agg(F.count("embedding")).first()[0] == 400
    assert seen.value == 2 * 201
    made = features.embed(df.limit(5), "t", lambda: base, templates=("{text}",))  # a function that makes the encoder
    assert made.count() == 5
