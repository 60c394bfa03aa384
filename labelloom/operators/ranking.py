"""Ranks, prefix sums and k-smallest selection without a single-task global window.

A window ordered over a whole class puts that class into one task. Here rows are first put into
order-preserving buckets; a small per-bucket table carries the running totals, and the window only
runs inside a bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Up to this many rows a plain ORDER BY .. LIMIT is used: it keeps k rows per task.
SMALL_LIMIT = 10_000
_FANOUT = 1024


def seeded_hash(key: Column | str, seed: int) -> Column:
    """Order of the deterministic shuffles: md5 of ``seed:key``."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_rank(df: DataFrame, key: str, seed: int, within: Sequence[str] = (),
              name: str = "rank", digits: int = 3) -> DataFrame:
    """Exact 1..n rank by ``seeded_hash(key)``, per ``within`` group.

    The first ``digits`` hex characters of the hash are the bucket, so buckets are even whatever
    the class sizes are. Also adds ``<name>_total``, the size of the group.
    """
    within = list(within)
    hashed = df.withColumn("_h", seeded_hash(key, seed)).withColumn("_b", F.substring("_h", 1, digits))
    per_bucket = hashed.groupBy(*within, "_b").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*within).orderBy("_b") if within else Window.orderBy("_b")
    whole = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    # at most 16**digits rows per group
    offsets = per_bucket.select(
        *within, "_b",
        (F.sum("_n").over(order) - F.col("_n")).alias("_before"),
        F.sum("_n").over(whole).alias(f"{name}_total"),
    )
    inside = Window.partitionBy(*within, "_b").orderBy("_h", key)
    return (
        hashed.withColumn("_r", F.row_number().over(inside))
        .join(offsets, [*within, "_b"])
        .withColumn(name, F.col("_before") + F.col("_r"))
        .drop("_h", "_b", "_r", "_before")
    )


def quantile_bounds(df: DataFrame, col: str, by: str | None = None, buckets: int = 64) -> dict:
    """Approximate quantile boundaries of ``col`` (per ``by`` value), as plain lists.

    One scan with sketches; the result is ``buckets`` numbers per group. They only steer the
    balance of the buckets, never the result.
    """
    probs = [i / buckets for i in range(1, buckets)]
    q = F.percentile_approx(col, F.array(*[F.lit(p) for p in probs]), F.lit(10_000)).alias("_q")
    if by is None:
        row = df.agg(q).first()
        return {None: sorted(set(row["_q"] or []))}
    return {r[by]: sorted(set(r["_q"] or [])) for r in df.groupBy(by).agg(q).collect()}


def bucket_of(col: Column, bounds: Sequence[float]) -> Column:
    """Index of the first boundary >= value, by binary search unrolled into nested CASEs."""
    def search(lo: int, hi: int) -> Column:
        if lo >= hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(col <= F.lit(bounds[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(bounds))


def bucket_by_group(df: DataFrame, by: str, col: str, bounds: Mapping) -> Column:
    """``bucket_of`` with the boundary list of the row's group."""
    out = F.lit(0)
    for value, b in bounds.items():
        if b:
            out = F.when(F.col(by) == F.lit(value), bucket_of(F.col(col), b)).otherwise(out)
    return out


def _narrow(df: DataFrame, col: str, k: int) -> tuple:
    """(value, rows below it) for the k-th smallest value of ``col``, 1-based.

    Each pass is one partial aggregation into ``_FANOUT`` buckets; the range shrinks to the bucket
    that holds the k-th row until that bucket is a single value.
    """
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    below = 0
    while lo != hi:
        width = (float(hi) - float(lo)) / _FANOUT
        inside = df.filter(F.col(col).between(F.lit(lo), F.lit(hi)))
        if width > 0:
            bucket = F.floor((F.col(col).cast("double") - F.lit(float(lo))) / F.lit(width))
        else:
            bucket = F.col(col)
        rows = (
            inside.groupBy(bucket.alias("_b"))
            .agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi"))
            .collect()
        )
        for r in sorted(rows, key=lambda r: r["lo"]):
            if below + r["n"] >= k:
                if (r["lo"], r["hi"]) == (lo, hi):
                    # doubles cannot split the range further: compare the values themselves
                    vals = inside.groupBy(col).count().orderBy(col).collect()
                    for v in vals:
                        if below + v["count"] >= k:
                            return v[0], below
                        below += v["count"]
                lo, hi = r["lo"], r["hi"]
                break
            below += r["n"]
    return lo, below


def smallest_k(df: DataFrame, k: int, value: str, tie: str) -> DataFrame:
    """The k rows smallest by ``(value, tie)``; ``tie`` is a unique integer key.

    For large k the cut value is found by counting (see ``_narrow``) and the rows are then kept by
    a filter, so no task or driver ever holds k rows.
    """
    if k <= 0:
        return df.limit(0)
    df = df.filter(F.col(value).isNotNull())
    if k <= SMALL_LIMIT:
        return df.orderBy(value, tie).limit(k)
    return smallest_k_by_count(df, k, value, tie)


def smallest_k_by_count(df: DataFrame, k: int, value: str, tie: str) -> DataFrame:
    """``smallest_k`` by counting only; several passes over ``df``, each a small aggregation."""
    if df.count() <= k:
        return df
    cut, below = _narrow(df, value, k)
    ties = df.filter(F.col(value) == F.lit(cut))
    last, _ = _narrow(ties, tie, k - below)
    return df.filter(
        (F.col(value) < F.lit(cut)) | ((F.col(value) == F.lit(cut)) & (F.col(tie) <= F.lit(last)))
    )


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small frame of driver rows; by way of Arrow it becomes a local relation without a Python stage."""
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame(pd.DataFrame(rows, columns=names), schema)


def row_ordinal(df: DataFrame, name: str = "row_index") -> DataFrame:
    """0..n-1 in file order (path, then position), for a frame read straight from files.

    One counting pass gives every file (Parquet) or file split (text formats) its offset; that table
    is no longer than the driver's own file listing, so it is broadcast and the rows never move.
    Parquet rows know their position in the file. For text formats the position comes from the task's
    row counter, and a row outside its split's counted range fails the job: the splits then changed
    between the passes (pin them with ``spark.sql.files.minPartitionNum``).
    """
    spark = df.sparkSession
    meta = F.col("_metadata")
    if "row_index" in df.select("_metadata").schema[0].dataType.fieldNames():
        tagged = df.select("*", meta["file_path"].alias("_path"), meta["row_index"].alias("_pos"))
        counts = tagged.groupBy("_path").agg(F.count("*").alias("n")).orderBy("_path").collect()
        before, rows = 0, []
        for r in counts:
            rows.append((r["_path"], before))
            before += r["n"]
        offsets = F.broadcast(_local(spark, rows, "_path string, _before long"))
        return tagged.join(offsets, "_path").withColumn(name, F.col("_before") + F.col("_pos")).drop(
            "_path", "_pos", "_before"
        )
    tagged = df.select(
        "*", meta["file_path"].alias("_path"), meta["file_block_start"].alias("_start"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    counts = tagged.groupBy("_path", "_start").agg(F.min("_mid").alias("first"), F.count("*").alias("n"))
    before, rows = 0, []
    for r in counts.orderBy("_path", "_start").collect():
        rows.append((r["_path"], r["_start"], before, r["first"], r["n"]))
        before += r["n"]
    offsets = F.broadcast(_local(spark, rows, "_path string, _start long, _before long, _first long, _n long"))
    pos = F.col("_mid") - F.col("_first")
    moved = F.col("_first").isNull() | (pos < 0) | (pos >= F.col("_n"))
    return (
        tagged.join(offsets, ["_path", "_start"], "left")
        .withColumn(name, F.when(moved, F.raise_error(F.lit("file splits changed between passes")))
                    .otherwise(F.col("_before") + pos))
        .drop("_path", "_start", "_mid", "_before", "_first", "_n")
    )
