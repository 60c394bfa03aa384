"""Binary, weighted, multi-label and ROC metrics; leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import labelsets as S
from ..functions.labels import label_text, normalize_label
from ..operators import metrics as M, roc
from ..operators.splits import stratified_folds
from .answers import gold_and_pred, sql_gold_and_pred
from .base import query, table

# own spelling of the nine topic names for column aliases in SQL
_SUFFIX = [f"{i}_{n}" for i, n in S.TOPICS.items()]


def _predicted(spark, d) -> DataFrame:
    return table(spark, d, "labels").select(
        "doc_id", "quality", "toxic", ((F.col("doc_id") * 7 + F.col("quality")) % 5 == 0).cast("int").alias("pred"),
        (F.col("doc_id") % 4).cast("int").alias("fold"))


_SQL_PRED = "p AS (SELECT *, ((doc_id * 7 + quality) % 5 = 0)::INT AS pred, (doc_id % 4)::INT AS fold FROM labels)"


@query("binary_metrics", f"""WITH {_SQL_PRED},
 c AS (SELECT quality, count(*) AS n, count(*) FILTER (toxic = 1 AND pred = 1) AS tp,
       count(*) FILTER (toxic = 0 AND pred = 1) AS fp, count(*) FILTER (toxic = 1 AND pred = 0) AS fn FROM p GROUP BY 1)
SELECT quality, n, round((n - fp - fn) / n::DOUBLE, 6) AS accuracy,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1,
       round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS "precision" FROM c""")
def binary_metrics(spark, d) -> DataFrame:
    out = M.binary_metrics(_predicted(spark, d), "toxic", "pred", by=["quality"])
    return out.select("quality", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "f1", "precision")])


def sql_weighted(source: str, gold: str, pred: str, by: str, round_to: int | None = 6) -> str:
    """Weighted metrics per ``by`` group, as a SELECT."""
    def out(e, name):
        return (f"round({e}, {round_to})" if round_to else e) + f' AS "{name}"'

    return f"""SELECT {by}, sum(support)::BIGINT AS n, {out('sum(tp) / sum(support)::DOUBLE', 'accuracy')},
   {out('sum(support * coalesce(tp / nullif(predicted, 0)::DOUBLE, 0)) / sum(support)', 'precision')},
   {out('sum(support * coalesce(tp / nullif(support, 0)::DOUBLE, 0)) / sum(support)', 'recall')},
   {out('sum(support * coalesce(2 * tp / nullif(support + predicted, 0)::DOUBLE, 0)) / sum(support)', 'f1')}
 FROM (SELECT {by}, cls, count(*) FILTER (side = 'g') AS support, count(*) FILTER (side = 'p') AS predicted,
         count(*) FILTER (side = 'g' AND same) AS tp
       FROM (SELECT {by}, {gold} AS cls, 'g' AS side, {gold} = {pred} AS same FROM {source}
             UNION ALL SELECT {by}, {pred}, 'p', false FROM {source}) GROUP BY {by}, cls) GROUP BY {by}"""


@query("weighted_metrics", f"WITH {_SQL_PRED} {sql_weighted('p', 'toxic', 'pred', 'fold')}")
def weighted_metrics(spark, d) -> DataFrame:
    out = M.weighted_metrics(_predicted(spark, d), "toxic", "pred", by=["fold"])
    return out.select("fold", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("fold_means", f"""WITH {_SQL_PRED}, w AS ({sql_weighted('p', 'toxic', 'pred', 'fold', None)})
SELECT round(avg(accuracy), 6) AS mean_accuracy, round(avg(f1), 6) AS mean_f1, round(avg("precision"), 6) AS mean_precision FROM w""")
def fold_means(spark, d) -> DataFrame:
    out = M.fold_means(M.weighted_metrics(_predicted(spark, d), "toxic", "pred", by=["fold"]))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_SQL_FLAGS = "f AS (SELECT *, " + ", ".join(
    f"list_contains(gold, '{i}') AS g{k}, list_contains(pred, '{i}') AS p{k}" for k, i in enumerate(S.TOPIC_IDS)
) + " FROM s)"
_SQL_LONG = " UNION ALL ".join(
    f"SELECT grp, {k}::INT AS ord, '{i}' AS label_id, count(*) AS n, count(*) FILTER (g{k} AND p{k}) AS tp, "
    f"count(*) FILTER (p{k} AND NOT g{k}) AS fp, count(*) FILTER (g{k} AND NOT p{k}) AS fn FROM f GROUP BY grp"
    for k, i in enumerate(S.TOPIC_IDS))
_SQL_PER_LABEL = """m AS (SELECT grp, ord, label_id, tp + fn AS support, (n - fp - fn) / n::DOUBLE AS accuracy,
   coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS prec, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS rec,
   coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM l)"""
_SQL_SETS = f"s AS (SELECT quality AS grp, doc_id, {sql_gold_and_pred('doc_id', 'toxic')} FROM labels)"


@query("multilabel_by_label", f"""WITH {_SQL_SETS}, {_SQL_FLAGS}, l AS ({_SQL_LONG}), {_SQL_PER_LABEL}
SELECT grp, ord, label_id, support, round(accuracy, 6) AS accuracy, round(prec, 6) AS "precision",
       round(rec, 6) AS recall, round(f1, 6) AS f1 FROM m""")
def multilabel_by_label(spark, d) -> DataFrame:
    sets = gold_and_pred(table(spark, d, "labels").withColumnRenamed("quality", "grp"), F.col("doc_id"), F.col("toxic"))
    out = M.multilabel_by_label(sets, "gold", "pred", by=["grp"])
    return out.select("grp", "ord", "label_id", "support",
                      *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


_SQL_WIDE = ", ".join(
    f'max(round({col}, 6)) FILTER (ord = {k}) AS "{name}_{s}"'
    for k, s in enumerate(_SUFFIX)
    for name, col in (("accuracy", "accuracy"), ("precision", "prec"), ("recall", "rec"), ("f1", "f1")))
_SQL_SAME = " AND ".join(f"g{k} = p{k}" for k in range(len(_SUFFIX)))


@query("multilabel_metrics", f"""WITH {_SQL_SETS}, {_SQL_FLAGS}, l AS ({_SQL_LONG}), {_SQL_PER_LABEL},
 e AS (SELECT grp, round(avg(({_SQL_SAME})::INT), 6) AS subset_accuracy FROM f GROUP BY grp)
SELECT grp, any_value(subset_accuracy) AS subset_accuracy, round(avg(f1), 6) AS macro_f1,
       round(avg(accuracy), 6) AS macro_accuracy, round(1 - avg(accuracy), 6) AS hamming_loss, {_SQL_WIDE}
FROM m JOIN e USING (grp) GROUP BY grp""")
def multilabel_metrics(spark, d) -> DataFrame:
    sets = gold_and_pred(table(spark, d, "labels").withColumnRenamed("quality", "grp"), F.col("doc_id"), F.col("toxic"))
    out = M.multilabel_metrics(sets, "gold", "pred", by=["grp"])
    return out.select("grp", *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in out.columns if c != "grp"])


@query("exact_match_scores", """
WITH p AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'Potentially' ELSE 'None' END AS gold,
     CASE doc_id % 3 WHEN 0 THEN ' potentially biased' WHEN 1 THEN 'none' END AS raw FROM labels),
 n AS (SELECT *, CASE WHEN lower(trim(coalesce(raw, 'None'))) LIKE 'potential%' THEN 'Potentially' ELSE 'None' END AS got FROM p)
SELECT doc_id, got AS pred, (lower(got) = lower(gold))::INT::DOUBLE AS score,
       'Gold: ' || lower(gold) || '. Pred: ' || got || '.' || CASE WHEN lower(got) <> lower(gold) THEN ' Check the rule.' ELSE '' END AS feedback
FROM n""")
def exact_match_scores(spark, d) -> DataFrame:
    raw = F.when(F.col("doc_id") % 3 == 0, " potentially biased").when(F.col("doc_id") % 3 == 1, "none")
    df = table(spark, d, "labels").select(
        "doc_id", label_text("toxic").alias("gold"),
        normalize_label(F.coalesce(raw, F.lit("None")), "prefix").alias("pred"))
    return df.select("doc_id", "pred", S.exact_match_score("gold", "pred").alias("score"),
                     S.exact_match_feedback("gold", "pred", "Check the rule.").alias("feedback"))


@query("row_counts", """SELECT count(*) AS "rows", count(*) FILTER (length(text) < 1024) AS kept,
  count(*) FILTER (doc_id % 7 = 0) AS flagged, count(DISTINCT lang) AS classes FROM documents""")
def row_counts(spark, d) -> DataFrame:
    return M.row_counts(table(spark, d, "documents"), F.length("text") < 1024, F.col("doc_id") % 7 == 0, "lang")


def _scores(spark, d) -> DataFrame:
    # floor makes ties; the last column is partly missing, one is not numeric, one has a single class
    v = [F.floor(F.col("embedding")[i].cast("double") * 100) / 100.0 for i in range(3)]
    return table(spark, d, "embeddings").select(
        (F.col("label") % 2).cast("int").alias("y"), v[0].alias("s1"), v[1].alias("s2"),
        F.when(F.col("vec_id") % 3 > 0, v[2].cast("string")).otherwise("n/a").alias("s3"),
        F.when(F.col("label") % 2 == 1, v[0]).alias("one_class"))


_SQL_SCORES = """e AS (SELECT vec_id, label % 2 AS y, list_transform(embedding[1:3], lambda x: floor(x::DOUBLE * 100) / 100.0::DOUBLE) AS v FROM embeddings),
 x AS (SELECT 's1' AS category, v[1] AS score, y FROM e UNION ALL SELECT 's2', v[2], y FROM e
       UNION ALL SELECT 's3', v[3], y FROM e WHERE vec_id % 3 > 0),
 k AS (SELECT category, score, sum(y) AS pos, sum(1 - y) AS neg FROM x GROUP BY 1, 2),
 c AS (SELECT category, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
         sum(pos) OVER (PARTITION BY category) AS p, sum(neg) OVER (PARTITION BY category) AS n,
         lead(pos) OVER (PARTITION BY category ORDER BY score DESC) AS npos,
         lead(neg) OVER (PARTITION BY category ORDER BY score DESC) AS nneg
       FROM k WINDOW w AS (PARTITION BY category ORDER BY score DESC))"""


@query("roc_points", f"""WITH {_SQL_SCORES}
SELECT category, score AS threshold, round(fp / n::DOUBLE, 6) AS fpr, round(tp / p::DOUBLE, 6) AS tpr FROM c
UNION ALL SELECT DISTINCT category, 'infinity'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM c""")
def roc_points(spark, d) -> DataFrame:
    df = _scores(spark, d)
    out = roc.roc_points(df, "y", roc.score_columns(df, "y"))
    return out.select("category", "threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("roc_points_thinned", f"""WITH {_SQL_SCORES}
SELECT category, score AS threshold, round(fp / n::DOUBLE, 6) AS fpr, round(tp / p::DOUBLE, 6) AS tpr FROM c
WHERE npos IS NULL OR npos <> pos OR nneg <> neg OR (tp = pos AND fp = neg)
UNION ALL SELECT DISTINCT category, 'infinity'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM c""")
def roc_points_thinned(spark, d) -> DataFrame:
    out = roc.roc_points(_scores(spark, d), "y", ["s1", "s2", "s3", "one_class"], drop_collinear=True, buckets=8)
    return out.select("category", "threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("auc_by_score", f"""WITH {_SQL_SCORES}
SELECT category, any_value(p)::BIGINT AS n_pos, any_value(n)::BIGINT AS n_neg,
       round(sum(pos * (n - fp + neg / 2.0::DOUBLE)) / any_value(p * n), 6) AS auc FROM c GROUP BY category""")
def auc_by_score(spark, d) -> DataFrame:
    return roc.auc_by_score(_scores(spark, d), "y", ["s1", "s2", "s3", "one_class"]).withColumn("auc", F.round("auc", 6))


def _sign_models(spark, d, n: int = 6) -> DataFrame:
    """Predictions of n one-component rules, long form, with stratified folds."""
    base = table(spark, d, "embeddings").select(
        "vec_id", (F.col("label") % 2).cast("int").alias("label"),
        *[(F.col("embedding")[i] >= 0).cast("int").alias(f"rule{i}") for i in range(n)])
    folded = stratified_folds(base, "vec_id", "label", 5)
    return folded.unpivot(["vec_id", "label", "fold"], [f"rule{i}" for i in range(n)], "classifier", "pred")


_SQL_FOLDS = """e AS (SELECT vec_id, label % 2 AS label, embedding FROM embeddings),
 f AS (SELECT *, ((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || vec_id), vec_id) - 1) % 5)::INT AS fold FROM e)"""
_SQL_RULES = "r AS (" + " UNION ALL ".join(
    f"SELECT 'rule{i}' AS classifier, fold, label, (embedding[{i + 1}] >= 0)::INT AS pred FROM f" for i in range(6)) + ")"


@query("leaderboard", f"""WITH {_SQL_FOLDS}, {_SQL_RULES}, w AS ({sql_weighted('r', 'label', 'pred', 'classifier, fold', None)})
SELECT classifier, round(avg(accuracy), 6) AS mean_accuracy, round(avg(f1), 6) AS mean_f1, round(avg("precision"), 6) AS mean_precision
FROM w GROUP BY 1 ORDER BY avg("precision") DESC, classifier LIMIT 3""")
def leaderboard(spark, d) -> DataFrame:
    per_fold = M.weighted_metrics(_sign_models(spark, d), "label", "pred", by=["classifier", "fold"])
    top = M.leaderboard(M.fold_means(per_fold, by=["classifier"]), "classifier", "mean_precision", 3)
    return top.select("classifier", *[F.round(c, 6).alias(c) for c in ("mean_accuracy", "mean_f1", "mean_precision")])


@query("score_table", f"""WITH {_SQL_FOLDS}, {_SQL_RULES}, w AS ({sql_weighted('r', 'label', 'pred', 'classifier, fold', None)})
SELECT fold, round(max(f1) FILTER (classifier = 'rule0'), 6) AS rule0, round(max(f1) FILTER (classifier = 'rule1'), 6) AS rule1,
       round(max(f1) FILTER (classifier = 'rule2'), 6) AS rule2, -1.0::DOUBLE AS failed FROM w GROUP BY fold""")
def score_table(spark, d) -> DataFrame:
    per_fold = M.weighted_metrics(_sign_models(spark, d), "label", "pred", by=["classifier", "fold"])
    wide = M.score_table(per_fold, "fold", "classifier", "f1", ["rule0", "rule1", "rule2", "failed"])
    return wide.select("fold", *[F.round(c, 6).alias(c) for c in ("rule0", "rule1", "rule2")],
                       F.coalesce("failed", F.lit(-1.0)).alias("failed"))
