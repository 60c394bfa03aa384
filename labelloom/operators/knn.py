"""Exact k nearest neighbours by Euclidean distance, ties by id.

* Identical training vectors are first reduced to their k smallest ids (per fold), which cannot
  change any answer and keeps hot copies small.
* A training side under ``BROADCAST_BYTES`` is broadcast and every query batch is answered in one
  map step.
* Beyond that, both sides are cut into pivot cells and bounded blocks, which are shuffled and staged once. Every
  part of the queries' blocks meets every part of the training blocks in a task that reads both from there and keeps
  only the k best per query. Cell pairs that the triangle inequality rules out are left out. So distances are as many
  as pairs, but what is shuffled and written grows with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..session import discard, staged

#: passes through the driver, once per call
BROADCAST_BYTES = 16 << 20
BLOCK_ROWS = 4096
#: vectors that are packed in one task, about
TASK_BYTES = 8 << 20
_NEIGHBOURS = "array<struct<id:bigint,distance:double,label:int>>"
_NO_FOLD = -1
#: stands for a training row without a key
_LAST = np.iinfo(np.int64).max


def _best(q: np.ndarray, qfold: np.ndarray, t: np.ndarray, tid: np.ndarray, tfold: np.ndarray, k: int):
    """(query position, train position, squared distance) of the k best per query, best first.

    A matrix product gives approximate distances; everything within its rounding error of the k-th
    is recomputed exactly before the cut, so the order is that of the exact distances.
    """
    out = []
    tn = (t * t).sum(1)
    step = max(1, (4 << 20) // max(len(t), 1))
    for at in range(0, len(q), step):
        qs, fs = q[at:at + step], qfold[at:at + step]
        qn = (qs * qs).sum(1)
        d2 = qn[:, None] + tn[None, :] - 2.0 * (qs @ t.T)
        d2[(fs[:, None] == tfold[None, :]) & (fs[:, None] != _NO_FOLD)] = np.inf
        kk = min(k, len(t))
        kth = np.partition(d2, kk - 1, axis=1)[:, kk - 1]
        slack = 1e-9 * (qn + (tn.max() if len(tn) else 0.0)) + 1e-12
        rows, cols = np.nonzero((d2 <= (kth + slack)[:, None]) & np.isfinite(d2))
        exact = np.empty(len(rows))
        part = max(1, (8 << 20) // max(t.shape[1], 1))
        for i in range(0, len(rows), part):
            diff = qs[rows[i:i + part]] - t[cols[i:i + part]]
            exact[i:i + part] = (diff * diff).sum(1)
        order = np.lexsort((tid[cols], exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        starts = np.searchsorted(rows, np.arange(len(qs)))
        keep = np.arange(len(rows)) - starts[rows] < k
        out.append((rows[keep] + at, cols[keep], exact[keep]))
    return tuple(np.concatenate(p) for p in zip(*out)) if out else (np.empty(0, int),) * 3


def _matrix(col: pd.Series) -> np.ndarray:
    return np.asarray(col.tolist(), dtype=np.float64) if len(col) else np.empty((0, 1))


def _distinct_train(train: DataFrame, k: int) -> DataFrame:
    """At most k rows (smallest ids) per identical vector and fold."""
    w = Window.partitionBy("vec", "fold").orderBy("id")
    return train.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def knn(query: DataFrame, train: DataFrame, k: int = 10, key: str = "id", vector: str = "embedding",
        label: str = "label", fold: str | None = None, strategy: str = "auto",
        block_rows: int = BLOCK_ROWS, pivots: int = 32) -> DataFrame:
    """``key, neighbours``: the k nearest training rows as an array of (id, distance, label), nearest first.

    With ``fold`` a query only sees training rows of other folds (out-of-fold neighbours).
    """
    def shape(df: DataFrame, with_label: bool) -> DataFrame:
        f = F.col(fold).cast("int") if fold else F.lit(_NO_FOLD)
        cols = [F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"), f.alias("fold")]
        return df.select(*cols, *([F.col(label).cast("int").alias("label")] if with_label else []))

    def size(df: DataFrame) -> int:
        return df.agg(F.coalesce(F.sum(F.size("vec") * 8 + 24), F.lit(0))).first()[0]

    q, t, kept = shape(query, False), shape(train, True), None
    if strategy == "auto" and size(t) <= BROADCAST_BYTES:
        strategy = "broadcast"
    t = _distinct_train(t, k)
    if strategy in ("auto", "blocks"):
        t = kept = staged(t)  # read several times
    if strategy == "auto":
        strategy = "broadcast" if size(t) <= BROADCAST_BYTES else "blocks"
    if strategy == "broadcast":
        found = _knn_broadcast(q, t, k)
    elif strategy == "blocks":
        found = _knn_blocks(q, t, k, block_rows, pivots)
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    if kept is not None:
        discard(kept)
    return found.withColumnRenamed("id", key)


def _knn_broadcast(q: DataFrame, t: DataFrame, k: int) -> DataFrame:
    side = t.toPandas()
    shared = q.sparkSession.sparkContext.broadcast(
        (_matrix(side["vec"]), side["id"].to_numpy(), side["fold"].to_numpy(), side["label"].to_numpy())
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tv, tid, tfold, tlab = shared.value
        for pdf in batches:
            found: list[list] = [[] for _ in range(len(pdf))]
            if len(pdf) and len(tid):
                rows, cols, d2 = _best(_matrix(pdf["vec"]), pdf["fold"].to_numpy(), tv, tid, tfold, k)
                for r, c, d in zip(rows, cols, np.sqrt(d2)):
                    found[r].append({"id": int(tid[c]), "distance": float(d), "label": int(tlab[c])})
            yield pd.DataFrame({"id": pdf["id"], "neighbours": found})

    return q.mapInPandas(run, f"id long, neighbours {_NEIGHBOURS}")


def _with_cell(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """Nearest pivot and the distance to it."""
    shared = df.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType(df.schema.fields + [T.StructField("cell", T.IntegerType()), T.StructField("reach", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for pdf in batches:
            v = _matrix(pdf["vec"])
            d2 = (v * v).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * v @ c.T if len(pdf) else np.empty((0, len(c)))
            cell = d2.argmin(1) if len(pdf) else np.empty(0, int)
            pdf["cell"] = cell.astype("int32")
            pdf["reach"] = np.sqrt(((v - c[cell]) ** 2).sum(1)) if len(pdf) else np.empty(0)
            yield pdf

    return df.mapInPandas(run, schema)


def _plan_cells(centres: np.ndarray, qstat: list, tstat: list, k: int) -> list[tuple[int, int]]:
    """Cell pairs that may hold a k-nearest neighbour.

    ``qstat``: (cell, radius); ``tstat``: (cell, radius, rows outside its largest fold).
    """
    pairs = []
    for qc, qr in qstat:
        gap = {tc: float(np.linalg.norm(centres[qc] - centres[tc])) for tc, _, _ in tstat}
        have, reach = 0, math.inf
        for upper, n in sorted((gap[tc] + qr + tr, n) for tc, tr, n in tstat):
            have += n
            if have >= k:
                reach = upper
                break
        for tc, tr, _ in tstat:
            if gap[tc] - qr - tr <= reach * (1 + 1e-9) + 1e-9:
                pairs.append((qc, tc))
    return pairs


class _Nearest:
    """The k best training rows seen so far of each row of a query block."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.d2 = np.full((n, k), np.inf)
        self.id = np.full((n, k), _LAST)
        self.label = np.full((n, k), np.nan)

    def see(self, q: np.ndarray, qfold: np.ndarray, t: np.ndarray, tid: np.ndarray, tfold: np.ndarray, tlabel: np.ndarray,
            places: np.ndarray | None = None) -> None:
        """Distances by a matrix product; all that may beat a row's k-th best so far, rounding included, are computed exactly.

        ``places``: the block's rows that q has, if not all.
        """
        places = np.arange(len(q)) if places is None else places
        tn = (t * t).sum(1)
        step, k = max(1, (2 << 20) // len(t)), self.k
        part = max(1, (4 << 20) // max(t.shape[1], 1))
        side = np.vstack([-2.0 * t.T, tn])
        for at in range(0, len(q), step):
            qs, fs = q[at:at + step], qfold[at:at + step]
            qn = (qs * qs).sum(1)
            d2 = np.column_stack([qs, np.ones(len(qs))]) @ side  # without qn
            bound = self.d2[places[at:at + step], -1] - qn
            if len(t) >= k and not np.isfinite(bound).all():
                d2[(fs[:, None] == tfold[None, :]) & (fs[:, None] != _NO_FOLD)] = np.inf
                bound = np.minimum(bound, np.partition(d2, k - 1, axis=1)[:, k - 1])
            limit = np.minimum(bound + 1e-9 * (qn + tn.max()) + 1e-12, np.finfo(float).max)
            rows, cols = np.divmod(np.flatnonzero(d2 <= limit[:, None]), len(t))
            other = (fs[rows] != tfold[cols]) | (fs[rows] == _NO_FOLD)
            rows, cols = rows[other], cols[other]
            exact = np.empty(len(rows))
            for i in range(0, len(rows), part):
                diff = qs[rows[i:i + part]] - t[cols[i:i + part]]
                exact[i:i + part] = (diff * diff).sum(1)
            self._merge(places[rows + at], exact, tid[cols], tlabel[cols])

    def _merge(self, rows: np.ndarray, d2: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        old = np.unique(rows)
        rows = np.concatenate([np.repeat(old, self.k), rows])
        d2, ids, labels = (np.concatenate([x[old].ravel(), y]) for x, y in ((self.d2, d2), (self.id, ids), (self.label, labels)))
        order = np.lexsort((ids, d2, rows))
        # every row has its k old places, so at least k entries
        first = np.searchsorted(rows[order], old)
        best = order[first[:, None] + np.arange(self.k)]
        self.d2[old], self.id[old], self.label[old] = d2[best], ids[best], labels[best]


def _packed(df: DataFrame, blocks: dict[int, int], tasks: int) -> DataFrame:
    """Blocks of rows of one cell, staged, each as one row of binary columns; a row's block follows from its hash."""
    n = df.sparkSession.createDataFrame(list(blocks.items()), "cell int, _n int")
    of = df.join(F.broadcast(n), "cell").withColumn("sub", F.pmod(F.xxhash64("id", "vec"), "_n").cast("int")).drop("_n", "reach")
    names = [c for c in ("id", "vec", "fold", "label") if c in df.columns]

    def pack(table: pa.Table) -> pa.Table:
        out = {"cell": table["cell"][:1].combine_chunks(), "sub": table["sub"][:1].combine_chunks()}
        for name in names:
            c = table[name].combine_chunks()
            if name == "vec":
                values = c.flatten().to_numpy(zero_copy_only=False)
            elif name == "id":
                values = c.fill_null(_LAST).to_numpy(zero_copy_only=False)
            else:
                values = c.cast(pa.float64()).to_numpy(zero_copy_only=False)  # NULL is NaN
            out[name] = pa.array([values.tobytes()], pa.binary())
        return pa.table(out)

    schema = ", ".join(["cell int", "sub int", *(f"{c} binary" for c in names)])
    return staged(of.repartition(tasks, "cell", "sub").groupBy("cell", "sub").applyInArrow(pack, schema))


def tasks_of(spark: SparkSession, blocks: int, rows: int, dim: int) -> int:
    """Tasks that pack so many rows into blocks."""
    return max(1, min(blocks, max(2 * spark.sparkContext.defaultParallelism, rows * dim * 8 // TASK_BYTES)))


def parts_of(qrows: int, trows: int, dim: int, k: int) -> int:
    """Every part of the training side gives k rows per query: so few parts that these are no more bytes than both sides."""
    return max(1, (qrows + trows) * dim // (3 * k * max(qrows, 1)))


def _knn_blocks(q: DataFrame, t: DataFrame, k: int, block_rows: int, pivots: int) -> DataFrame:
    spark = q.sparkSession
    seeds = t.select("id", "vec").withColumn("_h", F.xxhash64("id")).orderBy("_h", "id").limit(pivots)
    centres = _matrix(seeds.toPandas()["vec"])
    if not len(centres):
        return q.select("id", F.array().cast(_NEIGHBOURS).alias("neighbours"))
    ids = q.select("id")
    q, t = _with_cell(q, centres), _with_cell(t, centres)
    # all statistics below have at most pivots (x folds) rows
    qstat = q.groupBy("cell").agg(F.max("reach").alias("r"), F.count("*").alias("n")).collect()
    tfold = t.groupBy("cell", "fold").agg(F.max("reach").alias("r"), F.count("*").alias("n"))
    tstat = tfold.groupBy("cell").agg(
        F.max("r").alias("r"), F.sum("n").alias("n"),
        F.max(F.when(F.col("fold") != _NO_FOLD, F.col("n")).otherwise(0)).alias("own"),
    ).collect()
    pairs = _plan_cells(
        centres, [(r["cell"], r["r"]) for r in qstat],
        [(r["cell"], r["r"], r["n"] - r["own"]) for r in tstat], k,
    )
    near: dict[int, list[int]] = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
    if not near:
        return ids.select("id", F.array().cast(_NEIGHBOURS).alias("neighbours"))

    def blocks(n: int) -> int:
        return max(1, math.ceil(n / block_rows))

    dim = centres.shape[1]
    qrows, trows = sum(r["n"] for r in qstat), sum(r["n"] for r in tstat)

    def packed(df: DataFrame, stat: list, rows: int) -> DataFrame:
        sizes = {r["cell"]: blocks(r["n"]) for r in stat}
        return _packed(df, sizes, tasks_of(spark, sum(sizes.values()), rows, dim))

    # queries without a key can't be told apart by it and keep an empty list, as those without an eligible neighbour
    qpack, tpack = packed(q.filter("id IS NOT NULL"), qstat, qrows), packed(t, tstat, trows)
    parts = parts_of(qrows, trows, dim, k)
    allowed = F.broadcast(spark.createDataFrame(list(near.items()), "cell int, near array<int>"))
    left = tpack.coalesce(parts).select(*[F.col(c).alias(f"t{c}") for c in ("cell", "id", "vec", "fold", "label")])
    right = qpack.join(allowed, "cell").select("near", *[F.col(c).alias(f"q{c}") for c in ("cell", "sub", "id", "vec", "fold")])
    # a task keeps its part of the queries and reads its part of the training side once, block by block; nothing is shuffled
    met = left.join(right.hint("shuffle_replicate_nl"), F.array_contains("near", F.col("tcell")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], tuple[np.ndarray, _Nearest]] = {}
        for batch in batches:
            for cell, sub, *row in zip(*(c.to_pylist() if i < 2 else c for i, c in enumerate(batch.columns))):
                qid, qvec, qfold, tid, tvec, tfold, tlabel = (
                    np.frombuffer(x.as_buffer(), dtype=np.int64 if i in (0, 3) else np.float64) for i, x in enumerate(row))
                if (cell, sub) not in found:
                    found[cell, sub] = qid.copy(), _Nearest(len(qid), k)
                found[cell, sub][1].see(qvec.reshape(len(qid), -1), qfold, tvec.reshape(len(tid), -1), tid, tfold, tlabel)
        for ids, best in found.values():
            rows, cols = np.nonzero(np.isfinite(best.d2))
            nid, label = best.id[rows, cols], best.label[rows, cols]
            yield pa.record_batch([
                pa.array(ids[rows]), pa.array(nid, mask=nid == _LAST), pa.array(best.d2[rows, cols]),
                pa.array(np.nan_to_num(label).astype(np.int32), mask=np.isnan(label))], names=["id", "nid", "d2", "label"])

    cand = met.select("qcell", "qsub", "qid", "qvec", "qfold", "tid", "tvec", "tfold", "tlabel").mapInArrow(
        search, "id bigint, nid bigint, d2 double, label int")
    w = Window.partitionBy("id").orderBy("d2", "nid")
    top = cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    merged = top.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("_r", "nid", "d2", "label"))).alias("_a"))
    found = staged(merged.select("id", F.transform("_a", lambda a: F.struct(
        a["nid"].alias("id"), F.sqrt(a["d2"]).alias("distance"), a["label"].alias("label"))).alias("neighbours")))
    discard(qpack, tpack)
    # queries without any eligible neighbour keep an empty list
    return ids.join(found, "id", "left").select(
        "id", F.coalesce("neighbours", F.array().cast(_NEIGHBOURS)).alias("neighbours")
    )


def knn_probability(neighbours: DataFrame, name: str = "prob1") -> DataFrame:
    """Class-1 share among the neighbours as ``prob1`` (and ``prob0``); NULL without neighbours."""
    ones = F.aggregate("neighbours", F.lit(0), lambda a, x: a + x["label"])
    p = F.when(F.size("neighbours") > 0, ones / F.size("neighbours").cast("double"))
    return neighbours.withColumn(name, p).withColumn("prob0", 1.0 - F.col(name)).drop("neighbours")
