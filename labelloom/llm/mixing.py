"""Interleave sources by target weights: proportionate-fair scheduling with DataFrame functions only.

Each source is cut into blocks of equal size. Its target weight a / Q gives block i a release time floor(i Q / a) and a
deadline ceil((i + 1) Q / a); at every slot the released block with the earliest deadline goes next. Each block then
runs inside its window, so at any time every source is less than one block away from its share. Weights are whole
numbers of slots of a cycle of Q, at whose end all sources are exactly on target; the schedule therefore repeats and is
worked out for one cycle only, whatever the amount of data. Where a block lies in its source comes from prefix sums over
hash buckets, so a source with most of the rows is spread over as many tasks as its size asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import text_of

CYCLE = 1024
BLOCK_CHARS = 16_384
#: share of a source's characters to this power is its weight, if no weights are given
TEMPERATURE_ROOT = 2  # square root
#: a hash bucket of a source holds about so many rows
BUCKET_ROWS = 20_000
SEED = 7


def cycle_slots(weights: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """(source, slots): ``weight`` as whole slots of the cycle, at least one each, by largest remainders.

    Weights are whole numbers; NULL and less than 1 count as 1. There is one row per source, a parameter of the mixture
    and not of the data's size; more sources than slots are an error.
    """
    one = Window.partitionBy(F.lit(0))
    w = weights.select("source", F.greatest(F.coalesce(F.col("weight"), F.lit(1)), F.lit(1)).cast("bigint").alias("w"))
    # in decimal numbers, as slots times a weight may leave the range of 64 bits
    exact = (F.col("w").cast("decimal(38,0)") * cycle)
    w = w.withColumn("_all", F.sum("w").over(one).cast("decimal(38,0)"))
    w = w.withColumn("_base", F.greatest(F.floor(exact / F.col("_all")), F.lit(1)).cast("bigint"))
    w = w.withColumn("_rest", exact - F.col("_base") * F.col("_all")).withColumn(
        "_left", F.lit(cycle) - F.sum("_base").over(one))
    w = w.withColumn("_rank", F.row_number().over(one.orderBy(F.desc("_rest"), "source"))).withColumn(
        "_size", F.row_number().over(one.orderBy(F.desc("_base"), "source")))
    more = F.when((F.col("_left") > 0) & (F.col("_rank") <= F.col("_left")), 1).when(
        (F.col("_left") < 0) & (F.col("_size") == 1), F.col("_left")).otherwise(0)
    slots = (F.col("_base") + more).cast("bigint")
    checked = F.when(slots >= 1, slots).otherwise(F.raise_error(F.lit("more sources than the cycle has slots for")))
    return w.select("source", checked.alias("slots"))


def earliest_deadline_first(slots: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """(source, nth, slot): the slot of every source's nth block of a cycle. One row per slot."""
    sources = slots.agg(F.array_sort(F.collect_list(F.struct("source", "slots"))).alias("_s"))
    a = F.col("_s")
    start = F.struct(F.transform(a, lambda x: F.lit(0).cast("bigint")).alias("done"),
                     F.array().cast("array<int>").alias("order"))

    def step(state: Column, t: Column) -> Column:
        def window(x: Column, i: Column) -> Column:
            n, share = F.get(state["done"], i), x["slots"]
            released = (n < share) & (F.floor(n * cycle / share) <= t)
            return F.when(released, F.struct(F.ceil((n + 1) * cycle / share).alias("deadline"), i.alias("i")))

        next_one = F.array_min(F.transform(a, window))["i"]
        return F.struct(F.transform(state["done"], lambda n, i: F.when(i == next_one, n + 1).otherwise(n)).alias("done"),
                        F.concat(state["order"], F.array(next_one)).alias("order"))

    order = F.aggregate(F.sequence(F.lit(0), F.lit(cycle - 1)), start, step, lambda s: s["order"])
    turns = sources.filter(F.size(a) > 0).select(a, F.posexplode(order).alias("slot", "_i")).select(
        F.get(a, F.col("_i"))["source"].alias("source"), F.col("slot").cast("bigint").alias("slot"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1
    return turns.select("source", nth.cast("bigint").alias("nth"), "slot")


def mix(docs: DataFrame, weights: DataFrame | None = None, key: str = "doc_id", text: str = "text",
        source: str = "source", cycle: int = CYCLE, block_chars: int = BLOCK_CHARS, seed: int = SEED) -> DataFrame:
    """All rows and columns of ``docs`` plus block, release, deadline, slot and start (all bigint).

    Reading by (slot, start) gives the mixture. Inside a source documents are shuffled by ``md5(seed:key)``; ``start`` is the
    document's first character in its source, ``block`` the block that holds it. ``weights``: (source, weight); by default
    the square root of a source's characters. A source missing there gets weight 1. Once a source has run out its slots
    stay empty and the others keep their proportions; no row is dropped or repeated. A NULL source counts as '' and a
    NULL text as empty; rows without a key are shuffled by their text; repeated keys are placed one after another; an
    empty table gives an empty result. Columns of these names that exist already are replaced.
    """
    d = docs.withColumn("__source", F.coalesce(F.col(source).cast("string"), F.lit("")))
    d = d.withColumn("__chars", F.length(text_of(text)).cast("bigint"))
    ident = F.coalesce(F.col(key).cast("string"), F.md5(text_of(text)))
    d = d.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), ident)))
    rows = docs.count()
    digits = 1
    while rows > BUCKET_ROWS * 16 ** digits:
        digits += 1
    d = d.withColumn("__b", F.substring("__h", 1, digits))

    per_bucket = d.groupBy("__source", "__b").agg(F.sum("__chars").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__source").orderBy("__b")) - F.col("__n")
    offsets = per_bucket.select("__source", "__b", before.alias("__before"))
    totals = per_bucket.groupBy("__source").agg(F.sum("__n").alias("__total"))
    if weights is None:
        weight = F.floor(F.sqrt(F.col("__total").cast("double")))
        weights = totals.select(F.col("__source").alias("source"), weight.alias("weight"))
    else:
        given = weights.select(F.coalesce(F.col("source"), F.lit("")).alias("__source"), "weight")
        weights = totals.join(given, "__source", "left").select(F.col("__source").alias("source"), "weight")
    slots = cycle_slots(weights, cycle)
    turns = earliest_deadline_first(slots, cycle).join(slots, "source").withColumnRenamed("source", "__source")

    inside = Window.partitionBy("__source", "__b").orderBy("__h", "__chars", key).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__inside", F.sum("__chars").over(inside) - F.col("__chars")).join(offsets, ["__source", "__b"])
    d = d.withColumn("start", F.col("__before") + F.col("__inside"))
    d = d.withColumn("block", F.floor(F.col("start") / block_chars).cast("bigint"))
    # one row per slot of the cycle at most: small by construction
    d = d.join(F.broadcast(slots.select(F.col("source").alias("__source"), F.col("slots").alias("__slots"))), "__source")
    d = d.withColumn("__nth", F.col("block") % F.col("__slots")).withColumn("__round", F.floor(F.col("block") / F.col("__slots")))
    d = d.join(F.broadcast(turns.select("__source", F.col("nth").alias("__nth"), F.col("slot").alias("__slot"))), ["__source", "__nth"])
    at = F.col("__round") * cycle
    return d.select(
        *(F.col(f"`{c}`") for c in docs.columns if c not in ("block", "release", "deadline", "slot", "start")), "block",
        (at + F.floor(F.col("__nth") * cycle / F.col("__slots"))).cast("bigint").alias("release"),
        (at + F.ceil((F.col("__nth") + 1) * cycle / F.col("__slots"))).cast("bigint").alias("deadline"),
        (at + F.col("__slot")).cast("bigint").alias("slot"), F.col("start").cast("bigint").alias("start"))
