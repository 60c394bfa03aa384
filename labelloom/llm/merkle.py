"""A Merkle manifest of a table: every row gets a proof that it belongs to the dataset's root.

Rows are leaves. Those of a group (say, a language) are ranked by their key, and the rank's digits in base ``arity`` are
columns. Inside a block of ``arity ** DIGITS`` leaves the lowest digit is grouped away first, then the next one: each step
nests the child structs of one run into an array and hashes the run, until a block is one row. The blocks' hashes are
the leaves of the next storey, which has blocks of its own; so no row ever holds more than one block, whatever the size of a group.
Going back down, a transform over a block's nested structs appends the siblings of every level, and an explode gives one row per
leaf with its proof; no level is ever joined with another.

A group's tree has as many levels as its size asks for, and the groups' roots are the leaves of one more tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import PLACE_BITS, in_order, staged

ARITY = 2
#: digits of the rank that are grouped away in one block: 1,024 leaves of a binary tree
DIGITS = 10

_PROOF = "array<struct<position:int, siblings:array<string>>>"


def field(value: Column) -> Column:
    """A value of a leaf: '-' if NULL, else its number of UTF-8 bytes, ':' and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's hash and its proof lead to."""
    def up(h: Column, step: Column) -> Column:
        others, at = step["siblings"], step["position"]
        run = F.concat(F.slice(others, F.lit(1), at), F.array(h), F.slice(others, at + 1, F.size(others)))
        return F.sha2(F.array_join(run, ""), 256)

    return F.aggregate(proof, leaf, up)


def siblings(proof: Column) -> Column:
    """All hashes of a proof in its order."""
    return F.flatten(F.transform(proof, lambda s: s["siblings"]))


def _ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` (_g, ...) with _rank (0 is first) inside _g, and _size, the rows of _g."""
    placed = in_order(rows, "_g", *order).withColumn("_part", F.shiftright("_place", PLACE_BITS))
    # one row for each partition that holds rows of a group
    parts = placed.groupBy("_g", "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    of = Window.partitionBy("_g")
    parts = parts.withColumn("_before", F.sum("_n").over(of.orderBy("_part")) - F.col("_n")).withColumn("_size", F.sum("_n").over(of))
    rank = F.col("_place") - F.col("_first") + F.col("_before")
    return placed.join(parts, ["_g", "_part"]).withColumn("_rank", rank).drop("_part", "_place", "_first", "_before", "_n")


def _levels(size: Column, arity: int) -> Column:
    """The least number of levels whose tree has room for ``size`` leaves."""
    powers = [arity ** i for i in range(64) if arity ** i < 1 << 63]
    return F.size(F.filter(F.array(*(F.lit(p).cast("bigint") for p in powers)), lambda p: p < size))


def _storey(nodes: DataFrame, arity: int, digits: int) -> DataFrame:
    """One row per block: _g, _block, _levels (of the group, from the block's leaves on), h and the nested ``kids``.

    ``nodes``: _g, _rank, _levels, h, item.
    """
    def digit(i: int) -> Column:
        return F.pmod(F.floor(F.col("_rank") / F.lit(arity ** i)), F.lit(arity)).cast("int")

    t = nodes.select("_g", F.floor(F.col("_rank") / F.lit(arity ** digits)).alias("_block"), "_levels", "h", "item",
                     *(digit(i).alias(f"_d{i}") for i in range(digits)))
    # all steps group inside a block, so rows move once
    t = t.repartition("_g", "_block")
    content = "item"
    for i in range(digits):
        keys = ["_g", "_block", *(f"_d{j}" for j in range(digits - 1, i, -1))]
        kid = F.struct(F.col(f"_d{i}").alias("digit"), "h", content)
        t = t.groupBy(*keys).agg(F.first("_levels").alias("_levels"), F.array_sort(F.collect_list(kid)).alias("kids"))
        run = F.array_join(F.transform("kids", lambda k: k["h"]), "")
        # above a group's own levels every node has one child, which it passes on
        t = t.withColumn("h", F.when(F.col("_levels") > i, F.sha2(run, 256)).otherwise(F.col("kids")[0]["h"]))
        content = "kids"
    return t.select("_g", "_block", "_levels", "h", "kids")


def _walk(kids: Column, level: int, levels: Column, above: Column) -> Column:
    """array<struct<item, h, proof>> of the leaves below; ``above`` is the proof from here to the root."""
    def of(kid: Column) -> Column:
        others = F.transform(F.filter(kids, lambda k: k["digit"] != kid["digit"]), lambda k: k["h"])
        step = F.array(F.struct(kid["digit"].alias("position"), others.alias("siblings")))
        proof = F.concat(F.when(levels > level, step).otherwise(F.array().cast(_PROOF)), above)
        if level == 0:
            return F.struct(kid["item"].alias("item"), kid["h"].alias("h"), proof.alias("proof"))
        return _walk(kid["kids"], level - 1, levels, proof)

    out = F.transform(kids, of)
    return out if level == 0 else F.flatten(out)


def _storeys(nodes: DataFrame, arity: int, digits: int) -> list[tuple[DataFrame, int]]:
    """Staged storeys from the leaves up, with their digits; the last one has one block per group."""
    left = nodes.agg(F.max("_levels")).first()[0] or 0
    out = []
    while left > 0 or not out:
        n = max(min(left, digits), 1)
        t = staged(_storey(nodes, arity, n))
        out.append((t, n))
        left -= n
        nodes = t.select("_g", F.col("_block").alias("_rank"), F.greatest(F.col("_levels") - n, F.lit(0)).alias("_levels"), "h",
                         F.col("_block").alias("item"))
    return out


def _unfolded(storey: DataFrame, above: DataFrame, digits: int) -> DataFrame:
    """One row per leaf of the storey: _g, item, h, subroot, root, proof. ``above``: _g, _block, subroot, root, proof.

    A block meets what is above it in one group of two rows.
    """
    tree = F.struct("_levels", "kids")
    up = F.struct("subroot", "root", "proof")
    both = storey.select("_g", "_block", tree.alias("_tree")).unionByName(
        above.select("_g", "_block", up.alias("_up")), allowMissingColumns=True)
    b = both.groupBy("_g", "_block").agg(F.first("_tree", True).alias("_tree"), F.first("_up", True).alias("_up"))
    leaves = _walk(F.col("_tree")["kids"], digits - 1, F.col("_tree")["_levels"], F.col("_up")["proof"])
    return b.select("_g", F.col("_up")["subroot"].alias("subroot"), F.col("_up")["root"].alias("root"), F.explode(leaves).alias("_leaf")).select(
        "_g", "subroot", "root", "_leaf.*")


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id",
             group: str = "lang", carry: dict[str, Column] | None = None, arity: int = ARITY, digits: int = DIGITS) -> DataFrame:
    """One row per row of ``docs``: key, group, leaf, subroot, root (hexadecimal SHA-256) and proof, plus the columns of ``carry``.

    ``fields`` are hashed in their order into the leaf. Leaves of a group ascend by key; NULL keys come last, equal keys are
    ordered by leaf, and equal leaves are interchangeable. Every ``arity`` consecutive nodes become the hash of their digests until one
    is left; a last, shorter run is hashed too, and a lone leaf is its own subroot. Subroots ascend by group, NULL first,
    and make the root in the same way. ``proof`` lists from the leaf up the position in the run and the run's other hashes. NULL
    and very long values are hashed like any other; other columns and their names don't matter; an empty table
    gives an empty result. ``carry``: small expressions over ``docs`` that travel with the leaf.
    """
    names = list(carry or {})
    of_group = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    leaves = staged(docs.select(of_group.alias("_g"), F.col(key).alias("_key"), F.col(group).alias("_group"),
                                leaf_hash(*(F.col(f) for f in fields)).alias("h"), *(v.alias(f"_c_{n}") for n, v in (carry or {}).items())))
    rows = _ranked(leaves, F.col("_key").asc_nulls_last(), "h")
    item = F.struct("_key", "_group", *(f"_c_{n}" for n in names))
    nodes = rows.select("_g", "_rank", _levels(F.col("_size"), arity).alias("_levels"), "h", item.alias("item"))
    storeys = _storeys(staged(nodes), arity, digits)

    subroots = storeys[-1][0].select(F.lit("").alias("_g"), F.col("_g").alias("item"), "h")
    tops = _ranked(subroots, "item").select("_g", "_rank", _levels(F.col("_size"), arity).alias("_levels"), "h", "item")
    top_storeys = _storeys(staged(tops), arity, digits)
    root = F.col("h")
    above = top_storeys[-1][0].select("_g", "_block", F.lit(None).cast("string").alias("subroot"), root.alias("root"),
                                   F.array().cast(_PROOF).alias("proof"))
    for storey, n in reversed(top_storeys):
        above = _unfolded(storey, above, n).withColumnRenamed("item", "_block")
    # the leaves of the upper tree are the roots of the lower ones
    above = above.select(F.col("_block").alias("_g"), F.lit(0).cast("bigint").alias("_block"), F.col("h").alias("subroot"), "root", "proof")
    for storey, n in reversed(storeys):
        above = staged(_unfolded(storey, above, n).withColumnRenamed("item", "_block"))
    it = F.col("_block")
    return above.select(it["_key"].alias(key), it["_group"].alias(group), F.col("h").alias("leaf"), "subroot", "root", "proof",
                        *(it[f"_c_{n}"].alias(n) for n in names))
