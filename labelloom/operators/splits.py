"""Folds, train/dev/test splits and samples, deterministic in (seed, key)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ranking import SMALL_LIMIT, hash_rank, seeded_hash, smallest_k


def stratified_folds(df: DataFrame, key: str, label: str, k: int, seed: int = 42,
                     name: str = "fold") -> DataFrame:
    """0..k-1 per row; within each class fold sizes differ by at most one."""
    ranked = hash_rank(df, key, seed, within=[label], name="_rank")
    return ranked.withColumn(name, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_rank_total")


def shuffle_split(df: DataFrame, key: str, val_ratio: float, test_ratio: float, seed: int = 0,
                  name: str = "split") -> DataFrame:
    """Shuffle, then train first, val = floor(n*v) rows, test = floor(n*t) rows."""
    ranked = hash_rank(df, key, seed, name="_rank")
    n = F.col("_rank_total").cast("double")
    n_val = F.floor(n * F.lit(float(val_ratio)))
    n_test = F.floor(n * F.lit(float(test_ratio)))
    n_train = F.col("_rank_total") - n_val - n_test
    split = (
        F.when(F.col("_rank") <= n_train, "train")
        .when(F.col("_rank") <= n_train + n_val, "val")
        .otherwise("test")
    )
    return ranked.withColumn(name, split).drop("_rank", "_rank_total")


def stratified_split(df: DataFrame, key: str, label: str, test_size: float = 0.2,
                     dev_size: float = 0.2, seed: int = 42, name: str = "split") -> DataFrame:
    """Test share per class first, then dev as ``dev/(1-test)`` of the rest, remainder train."""
    ranked = hash_rank(df, key, seed, within=[label], name="_rank")
    n = F.col("_rank_total").cast("double")
    n_test = F.round(n * F.lit(float(test_size)))
    n_dev = F.round((n - n_test) * F.lit(dev_size / (1.0 - test_size)))
    split = (
        F.when(F.col("_rank") <= n_test, "test")
        .when(F.col("_rank") <= n_test + n_dev, "dev")
        .otherwise("train")
    )
    return ranked.withColumn(name, split).drop("_rank", "_rank_total")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """min(n, rows) rows without replacement: those with the smallest 60 bits of the seeded hash, then key."""
    hashed = df.withColumn("_h", F.conv(F.substring(seeded_hash(key, seed), 1, 15), 16, 10).cast("bigint"))
    if n <= SMALL_LIMIT:
        return hashed.orderBy("_h", key).limit(n).drop("_h")
    return smallest_k(hashed, n, "_h", key).drop("_h")


def first_rows(df: DataFrame, key: str, n: int = 200) -> DataFrame:
    """The first min(n, rows) rows in key order (the validation cap of the optimiser runs)."""
    if n <= SMALL_LIMIT:
        return df.orderBy(key).limit(n)
    return smallest_k(df, n, key, key)
