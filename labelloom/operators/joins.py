"""Key lookups, exclusions and gold-table assembly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.labelsets import TOPIC_FLAG_COLUMNS, flags_to_ids
from ..functions.text import question_with_context


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one with the smallest ``order``.

    An aggregate rather than a window, so a key with very many copies shrinks to one row per task
    before the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return picked.select(key, "_row.*")


def lookup_first(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Inner join on the text form of ``key``; of duplicate right rows only the first counts."""
    right = right.withColumn(key, F.col(key).cast("string"))
    left = left.withColumn(key, F.col(key).cast("string"))
    return left.join(first_per_key(right, key, order).drop(order), key)


def topic_gold(flags: DataFrame, texts: DataFrame, key: str = "idx", order: str = "row_index",
               question: str = "q", context: str = "c",
               flag_columns: Mapping[str, str] = TOPIC_FLAG_COLUMNS) -> DataFrame:
    """``idx, text, groups``: gold flags joined to their first text row."""
    present = {c: i for c, i in flag_columns.items() if c in flags.columns}
    gold = flags.select(key, flags_to_ids(present).alias("groups"))
    texts = texts.select(key, order, question_with_context(question, context).alias("text"))
    return lookup_first(gold, texts, key, order).select(key, "text", "groups")


#: rows of heavy keys that may be broadcast
BROADCAST_ROWS = 10_000


def heavy_keys(df: DataFrame, key: str, share: float = 0.001) -> list:
    """Keys holding more than ``share`` of the rows; at most ``1/share`` of them, never the unique ones."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    biggest = counts.filter(F.col("_n") > 1).orderBy(F.desc("_n"), key).limit(int(1 / share) + 1).collect()
    if not biggest:
        return []
    total = df.count()
    return [r[key] for r in biggest if r["_n"] > share * total and r[key] is not None]


def skewed_lookup(left: DataFrame, right: DataFrame, key: str, share: float = 0.001,
                  how: str = "inner") -> DataFrame:
    """Join to a right side with unique keys when a few left keys hold much of the data.

    The right rows of the heavy keys (at most ``1/share``) are broadcast, if they are ``BROADCAST_ROWS`` at most, and their left rows
    stay where they are; everything else takes the ordinary shuffle join.
    """
    heavy = heavy_keys(left, key, share)
    # a right side with repeated keys may have any number of rows for them
    if not heavy or len(right.filter(F.col(key).isin(*heavy)).limit(BROADCAST_ROWS + 1).select(F.lit(1)).collect()) > BROADCAST_ROWS:
        return left.join(right, key, how)
    is_heavy = F.col(key).isin(*heavy)
    cold = left.filter(~is_heavy | F.col(key).isNull()).join(right.filter(~is_heavy), key, how)
    hot = left.filter(is_heavy).join(F.broadcast(right.filter(is_heavy)), key, how)
    return cold.unionByName(hot)


def drop_listed(df: DataFrame, listed: DataFrame, key: str = "row_index") -> DataFrame:
    """Rows whose key is not listed."""
    return df.join(listed.select(key).distinct(), key, "left_anti")


def union_relabelled(frames: Sequence[DataFrame], label: str) -> DataFrame:
    """Concatenate labelled tables and fill blank labels with ``None``."""
    from ..functions.labels import normalize_label

    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.withColumn(label, normalize_label(label, "fill_none"))


def upsert(existing: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows of ``updates`` replace or extend ``existing`` by key.

    A matched row takes every column the update has (NULL included) and keeps its other columns;
    columns known to only one side become NULL elsewhere; value columns come out sorted by name.
    """
    new_cols = [c for c in updates.columns if c != key]
    old_cols = [c for c in existing.columns if c != key]
    marked = updates.select(key, F.lit(True).alias("_new"), F.struct(*new_cols).alias("_u"))
    joined = existing.select(key, F.struct(*old_cols).alias("_e")).join(marked, key, "full_outer")
    out = []
    for c in sorted({*new_cols, *old_cols}):
        if c not in new_cols:
            v = F.col(f"_e.`{c}`")
        elif c not in old_cols:
            v = F.col(f"_u.`{c}`")
        else:
            v = F.when(F.col("_new"), F.col(f"_u.`{c}`")).otherwise(F.col(f"_e.`{c}`"))
        out.append(v.alias(c))
    return joined.select(key, *out)
