"""Prefix rules on urls as a range join over sorted keys.

A host is written with its labels reversed, each followed by a dot (``net.example.blog.``): a rule for a host and all
its subdomains is then the interval of all keys that start with the rule's key. Rules and urls are cut into the same
ranges of (key, tie) and sorted; one sweep per range opens a rule at its key, closes it when a key no longer starts
with it, and so keeps a stack of the nested rules that hold for the current host. The urls' paths are compared with
the paths of the rules on that stack, innermost host first.

Range bounds are quantiles of a fixed number of keys with the smallest hashes, so a host with any share of all urls is
spread over as many ranges as it needs. A range that starts inside a rule's interval gets a copy of that rule.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: fixed number of keys for the bounds of one range, and the most that reach the driver
KEYS_PER_RANGE = 32
MAX_KEYS = 65_536

_SCHEME_END = "://"


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, _SCHEME_END) > 0, F.substr(url, F.instr(url, _SCHEME_END) + 3)).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels reversed, each followed by a dot: a host's key starts with those of the domains it belongs to."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _bounds(keys: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """``ranges - 1`` bounds at most: quantiles of the keys with the smallest hashes. A bounded number is collected."""
    n = min(MAX_KEYS, KEYS_PER_RANGE * ranges)
    some = keys.select("_key", "_tie").orderBy(F.xxhash64("_tie", "_key"), "_tie", "_key").limit(n)
    picked = sorted((r["_key"], r["_tie"]) for r in some.collect())
    return sorted({picked[i * len(picked) // ranges] for i in range(1, ranges)}) if picked else []


class _Active:
    """The stack of rules whose interval holds the current key."""

    def __init__(self) -> None:
        self.open: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []

    def close(self, key: str) -> None:
        while self.open and not key.startswith(self.open[-1][0]):
            self.open.pop()

    def add(self, key: str, path: str, rule: str, verdict: str) -> None:
        self.close(key)
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, {}, []))
        _, by_path, lengths = self.open[-1]
        # rules that are said twice: blocking wins
        if path not in by_path or verdict == "block":
            by_path[path] = (rule, verdict)
        at = bisect_left(lengths, len(path))
        if at == len(lengths) or lengths[at] != len(path):
            lengths.insert(at, len(path))

    def judge(self, key: str, path: str) -> tuple[str | None, str | None]:
        self.close(key)
        best: tuple[int, str | None, str | None] = (-1, None, None)
        for rule_key, by_path, lengths in reversed(self.open):
            for n in reversed(lengths[:bisect_right(lengths, len(path))]):
                if len(rule_key) + n <= best[0]:
                    break
                hit = by_path.get(path[:n])
                if hit:
                    best = (len(rule_key) + n, *hit)
                    break
        return best[1], best[2]


def judge_urls(urls: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url",
               default: str = "allow", ranges: int | None = None) -> DataFrame:
    """(key, url, host, path, rule, verdict), one row per row of ``urls``.

    ``rules``: host, path, verdict ('allow' or 'block'). A rule fits its host and all subdomains if the url's path starts
    with the rule's; the longest (host and path together, then host) wins. Without a fitting rule the rule is NULL and
    the verdict ``default``. NULL urls and urls without ``://`` have an empty host and path and fit no rule. Repeated
    rows and keys are judged row by row; an empty table of urls or rules is allowed.
    """
    n = ranges or max(2, int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = urls.select(F.col(key).alias("_id"), F.col(url).cast("string").alias("_url"))
    d = d.withColumn("_host", url_host(F.col("_url"))).withColumn("_path", url_path(F.col("_url")))
    d = d.withColumn("_key", host_key(F.col("_host"))).withColumn("_tie", F.xxhash64("_url", "_id"))
    bounds = _bounds(d, n)  # n - 1 at most, whatever the data

    @F.pandas_udf("int")
    def range_of(keys: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, (k, t)) for k, t in zip(keys, ties)], dtype="int32")

    @F.pandas_udf("array<int>")
    def ranges_of_rule(keys: pd.Series) -> pd.Series:
        # every range that holds a key starting with the rule's: from the first bound beyond it to the last inside it
        first = [bisect_left(bounds, (k, -1 << 63)) for k in keys]
        last = [bisect_right(bounds, (k + "\U0010ffff", 0)) for k in keys]
        return pd.Series([list(range(a, b + 1)) for a, b in zip(first, last)])

    empty = F.lit(None).cast("string")
    pages = d.select(range_of("_key", "_tie").alias("_range"), "_key", F.lit(1).alias("_kind"), "_tie",
                     F.col("_id").cast("string").alias("_text"), "_url", "_host", "_path", empty.alias("_verdict"))
    r = rules.select(F.lower(F.col("host")).alias("_host"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict"))
    r = r.withColumn("_key", host_key(F.col("_host"))).withColumn("_range", F.explode(ranges_of_rule("_key")))
    marks = r.select("_range", "_key", F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_tie"), empty.alias("_text"),
                     empty.alias("_url"), "_host", "_path", "_verdict")
    both = pages.unionByName(marks).repartition(n, "_range").sortWithinPartitions("_range", "_key", "_kind", "_tie")

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        active, current = _Active(), None
        for batch in batches:
            out = []
            for at, k, kind, ident, u, host, path, verdict in zip(
                    batch["_range"], batch["_key"], batch["_kind"], batch["_text"], batch["_url"], batch["_host"],
                    batch["_path"], batch["_verdict"]):
                if at != current:
                    active, current = _Active(), at
                if kind == 0:
                    active.add(k, path, host + path, verdict)
                else:
                    rule, said = active.judge(k, path)
                    out.append((ident, u, host, path, rule, said or default))
            yield pd.DataFrame(out, columns=["_id", "url", "host", "path", "rule", "verdict"], dtype="object")

    judged = both.mapInPandas(sweep, "_id string, url string, host string, path string, rule string, verdict string")
    return judged.select(F.col("_id").cast(dict(urls.dtypes)[key]).alias(key), "url", "host", "path", "rule", "verdict")
