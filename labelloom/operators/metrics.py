"""Classification metrics as conditional sums; every result is a small frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labelsets import TOPICS


def _ratio(num: Column, den: Column) -> Column:
    """num/den with 0 for an empty denominator."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2.0 * tp, 2 * tp + fp + fn)


def binary_metrics(df: DataFrame, gold: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, and F1 / precision of the positive class, from 0/1 columns."""
    g, p = F.col(gold) == 1, F.col(pred) == 1
    sums = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(g & p).alias("tp"),
        F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        *by, "n",
        _ratio(F.col("n") - fp - fn, F.col("n")).alias("accuracy"),
        _f1(tp, fp, fn).alias("f1"),
        _ratio(tp, tp + fp).alias("precision"),
    )


def weighted_metrics(df: DataFrame, gold: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy plus precision, recall and F1 averaged over classes by support."""
    by = list(by)
    cells = df.groupBy(*by, F.col(gold).alias("_g"), F.col(pred).alias("_p")).agg(F.count("*").alias("_n"))
    # one entry for the gold class and one for the predicted class of every confusion cell
    sides = F.array(
        F.struct(F.col("_g").alias("cls"), F.col("_n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("_g") == F.col("_p"), F.col("_n")).otherwise(0).alias("tp")),
        F.struct(F.col("_p").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("_n").alias("predicted"),
                 F.lit(0).cast("long").alias("tp")),
    )
    per_class = cells.select(*by, F.inline(sides)).groupBy(*by, "cls").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp")
    )
    tp, sup, prd = F.col("tp"), F.col("support"), F.col("predicted")
    total = F.sum(sup)
    return per_class.groupBy(*by).agg(
        total.alias("n"),
        (F.sum(tp) / total).alias("accuracy"),
        (F.sum(sup * _ratio(tp, prd)) / total).alias("precision"),
        (F.sum(sup * _ratio(tp, sup)) / total).alias("recall"),
        (F.sum(sup * _ratio(2.0 * tp, sup + prd)) / total).alias("f1"),
    )


def fold_means(per_fold: DataFrame, metrics: Sequence[str] = ("accuracy", "f1", "precision"),
               by: Sequence[str] = ()) -> DataFrame:
    """Mean of the fold metrics (not pooled), as ``mean_<metric>``."""
    return per_fold.groupBy(*by).agg(*[F.avg(m).alias(f"mean_{m}") for m in metrics])


def _label_sums(df: DataFrame, gold: str, pred: str, label_ids: Sequence[str], by: Sequence[str]) -> DataFrame:
    def has(c: str, i: str) -> Column:
        return F.coalesce(F.array_contains(F.col(c), i), F.lit(False))

    flags, sums, same = {}, [], F.lit(True)
    for k, i in enumerate(label_ids):
        flags[f"_g{k}"], flags[f"_p{k}"] = has(gold, i), has(pred, i)
        g, p = F.col(f"_g{k}"), F.col(f"_p{k}")
        same = same & (g == p)
        sums += [F.count_if(g & p).alias(f"tp{k}"), F.count_if(~g & p).alias(f"fp{k}"),
                 F.count_if(g & ~p).alias(f"fn{k}")]
    flat = df.select(*by, *[c.alias(n) for n, c in flags.items()])
    return flat.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(same).alias("exact"), *sums)


def multilabel_by_label(df: DataFrame, gold: str, pred: str, by: Sequence[str] = (),
                        labels: dict[str, str] = TOPICS) -> DataFrame:
    """Long form: one row per label with support, accuracy, precision, recall, F1 (zero division = 0).

    All labels are counted side by side in one aggregation; nothing is exploded per row.
    """
    sums = _label_sums(df, gold, pred, list(labels), by)
    rows = F.array(*[
        F.struct(
            F.lit(k).alias("ord"), F.lit(i).alias("label_id"), F.lit(name).alias("label_name"),
            F.col("n").alias("n"), F.col(f"tp{k}").alias("tp"), F.col(f"fp{k}").alias("fp"),
            F.col(f"fn{k}").alias("fn"),
        )
        for k, (i, name) in enumerate(labels.items())
    ])
    long = sums.select(*by, F.inline(rows))
    tp, fp, fn, n = F.col("tp"), F.col("fp"), F.col("fn"), F.col("n")
    return long.select(
        *by, "ord", "label_id", "label_name", (tp + fn).alias("support"),
        _ratio(n - fp - fn, n).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"), _f1(tp, fp, fn).alias("f1"),
    )


def multilabel_metrics(df: DataFrame, gold: str, pred: str, by: Sequence[str] = (),
                       labels: dict[str, str] = TOPICS) -> DataFrame:
    """Wide form: subset accuracy, macro F1 / accuracy, Hamming loss, then four columns per label."""
    n, cols, f1s, accs = F.col("n"), [], [], []
    for k, (i, name) in enumerate(labels.items()):
        tp, fp, fn = F.col(f"tp{k}"), F.col(f"fp{k}"), F.col(f"fn{k}")
        acc, f1 = _ratio(n - fp - fn, n), _f1(tp, fp, fn)
        suffix = f"{i}_{name}"
        accs.append(acc)
        f1s.append(f1)
        cols += [acc.alias(f"accuracy_{suffix}"), _ratio(tp, tp + fp).alias(f"precision_{suffix}"),
                 _ratio(tp, tp + fn).alias(f"recall_{suffix}"), f1.alias(f"f1_{suffix}")]
    wrong = sum((F.col(f"fp{k}") + F.col(f"fn{k}") for k in range(len(labels))), F.lit(0))
    return _label_sums(df, gold, pred, list(labels), by).select(
        *by,
        _ratio(F.col("exact"), n).alias("subset_accuracy"),
        (sum(f1s, F.lit(0.0)) / len(labels)).alias("macro_f1"),
        (sum(accs, F.lit(0.0)) / len(labels)).alias("macro_accuracy"),
        _ratio(wrong, n * len(labels)).alias("hamming_loss"),
        *cols,
    )


def mean_score(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean row score; a NULL score (parse failure) counts as 0."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.coalesce(score, F.lit(0.0))).alias("mean_score"))


def row_counts(df: DataFrame, kept: Column, flagged: Column, cls: str) -> DataFrame:
    """Rows, kept rows, flagged rows and distinct classes in one pass."""
    return df.agg(
        F.count("*").alias("rows"), F.count_if(kept).alias("kept"),
        F.count_if(flagged).alias("flagged"), F.countDistinct(cls).alias("classes"),
    )


def leaderboard(scores: DataFrame, name: str, metric: str, top_n: int = 3) -> DataFrame:
    """The top rows by one metric; NULL metrics (failed models) come last, ties by name."""
    return scores.orderBy(F.col(metric).desc_nulls_last(), name).limit(top_n)


def score_table(results: DataFrame, row: str, col: str, metric: str, columns: Sequence[str]) -> DataFrame:
    """One table row per ``row`` value, one column per listed ``col`` value; a failed model is NULL."""
    return results.groupBy(row).pivot(col, list(columns)).agg(F.first(metric))
