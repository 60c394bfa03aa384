"""Approximate k nearest neighbours: inverted lists around centres, distances computed exactly inside the lists that are probed.

* Centres come from k-means on at most ``SAMPLE_ROWS`` rows (those with the least hashes of their key); every row is then listed
  under its nearest centre, so the index covers all rows.
* How many lists a query has to probe is measured, not guessed: ``SAMPLE_QUERIES`` rows are searched exactly against all rows, and the
  least number of lists that holds the wanted share of their true neighbours is taken. Where lists rule nothing out, that number grows
  and the recall stays.
* A list of any size is cut into blocks of rows, and queries near each other are put into blocks of queries. Both are shuffled and
  staged once; every part of the queries' blocks meets every part of the lists' blocks in a task that reads both from there, looks a
  query up in the lists it probes and keeps its k best. So distances are as many as rows in probed lists, but what is shuffled and
  written grows with the rows, however many lists are probed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import discard, staged
from .knn import _LAST, _NO_FOLD, _best, _Nearest, _packed, parts_of, tasks_of

SAMPLE_ROWS, SAMPLE_QUERIES = 20_000, 200
MOST_LISTS = 4096
BLOCK_ROWS, BLOCK_QUERIES = 4096, 4096
#: share of the true neighbours that the probed lists have to hold in the measurement
TARGET = 0.95


def _sample(df: DataFrame, key: str, vector: str, n: int, seed: str, total: int) -> tuple[list, np.ndarray]:
    """The n rows with the least hashes of their key, of ``total`` rows."""
    h = F.xxhash64(F.lit(seed), key)

    def least(of: DataFrame) -> list:
        return of.select(key, vector).orderBy(h, key).limit(n).collect()

    share = (1.1 * n + 100) / max(total, 1)
    # every task sends its n least rows, so rows that can hardly be among the n least of all go first
    rows = least(df.filter(h <= F.lit(int(share * 2.0**64) - 2**63))) if share < 1 else []
    if len(rows) < n:
        rows = least(df)
    return [r[0] for r in rows], _square(np.array([r[1] for r in rows], dtype=np.float64), len(rows))


def _square(values: np.ndarray, rows: int) -> np.ndarray:
    return values.reshape(rows, -1 if rows else 0)


def centres_of(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spaced rows; an empty cluster keeps its centre."""
    c = x[np.linspace(0, len(x) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        at = nearest(x, c, 1)[:, 0]
        counts = np.bincount(at, minlength=n)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, nearest first."""
    out = [np.empty((0, n), np.int64)]
    for at in range(0, len(x), 1024):
        d = (c * c).sum(1) - 2.0 * (x[at:at + 1024] @ c.T)
        out.append(np.argsort(d, axis=1, kind="stable")[:, :n])
    return np.concatenate(out)


class Index:
    """Lists over ``train`` (key: bigint, vector: array of numbers of one length). Rows without a vector are left out."""

    def __init__(self, train: DataFrame, k: int = 10, key: str = "id", vector: str = "embedding", lists: int | None = None,
                 target: float = TARGET, seed: str = "ann"):
        self.k = k
        self.train = train.filter(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("vec"))
        n = self.train.count()
        _, x = _sample(self.train, "id", "vec", SAMPLE_ROWS, seed, n)
        lists = max(1, min(lists or int(np.sqrt(n)), MOST_LISTS, len(x)))
        self.centres = centres_of(x, lists) if len(x) else np.empty((0, 0))
        self.probes = self._measured(target, seed, n) if len(x) else 1

    def _measured(self, target: float, seed: str, n: int) -> int:
        ids, q = _sample(self.train, "id", "vec", SAMPLE_QUERIES, f"{seed}:queries", n)
        k, centres = self.k, self.centres

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                t = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                none = np.full(len(q), -1), np.full(len(t), -1)
                ids = b.column(0).fill_null(_LAST).to_numpy()
                i, j, d = _best(q, none[0], t, ids, none[1], k)
                yield pa.record_batch([pa.array(i), pa.array(ids[j]), pa.array(d), pa.array(nearest(t, centres, 1)[j, 0])],
                                      names=["q", "id", "d", "cell"])

        w = Window.partitionBy("q").orderBy("d", "id")
        best = self.train.mapInArrow(local, "q bigint, id bigint, d double, cell bigint").withColumn("_r", F.row_number().over(w))
        order = nearest(q, centres, len(centres))
        rank = np.argsort(order, axis=1)
        # at most SAMPLE_QUERIES * k rows
        places = np.sort([rank[r["q"], r["cell"]] for r in best.filter(F.col("_r") <= k).select("q", "cell").collect()])
        return int(places[min(int(np.ceil(target * len(places))), len(places)) - 1]) + 1

    def _listed(self, df: DataFrame) -> DataFrame:
        """The nearest centre of each row."""
        centres = df.sparkSession.sparkContext.broadcast(self.centres)

        @F.arrow_udf("int")
        def cell(column: pa.Array) -> pa.Array:
            x = _square(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), len(column))
            return pa.array(nearest(x, centres.value, 1)[:, 0].astype(np.int32))

        return df.withColumn("cell", cell("vec"))

    def _query_blocks(self, q: DataFrame, stat: dict[int, int], probes: int, tasks: int) -> DataFrame:
        """Blocks of queries, staged, each as one row; neighbouring lists' queries share a block. ``probed`` has a bit per query
        and list, ``near`` the lists that any of the block's queries probes."""
        spark = q.sparkSession
        centres = spark.sparkContext.broadcast(self.centres)
        n = min(len(self.centres), -(-sum(stat.values()) // BLOCK_QUERIES))
        group = nearest(self.centres, centres_of(self.centres, n), 1)[:, 0].tolist()
        sizes = dict.fromkeys(group, 0)
        for cell, rows in stat.items():
            sizes[group[cell]] += rows
        # a row per list
        of = spark.createDataFrame([(c, g, max(1, -(-sizes[g] // BLOCK_QUERIES))) for c, g in enumerate(group)], "cell int, at int, _n int")
        q = q.join(F.broadcast(of), "cell").withColumn("sub", F.pmod(F.xxhash64("__q", "vec"), "_n").cast("int")).drop("cell", "_n")

        def pack(table: pa.Table) -> pa.Table:
            keys, vec = table["__q"].combine_chunks(), table["vec"].combine_chunks()
            x = _square(vec.flatten().to_numpy(zero_copy_only=False), len(vec))
            chosen = nearest(x, centres.value, probes)
            probed = np.zeros((len(x), len(centres.value)), bool)
            np.put_along_axis(probed, chosen, True, axis=1)
            return pa.table({
                "at": table["at"][:1].combine_chunks(), "sub": table["sub"][:1].combine_chunks(),
                "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), "vec": pa.array([x.tobytes()], pa.binary()),
                "probed": pa.array([np.packbits(probed, axis=1).tobytes()], pa.binary()),
                "near": pa.array([np.unique(chosen).astype(np.int32)], pa.list_(pa.int32()))})

        schema = f"at int, sub int, keys array<{q.schema['__q'].dataType.simpleString()}>, vec binary, probed binary, near array<int>"
        return staged(q.repartition(tasks, "at", "sub").groupBy("at", "sub").applyInArrow(pack, schema))

    def search(self, queries: DataFrame, key: str = "id", vector: str = "embedding", probes: int | None = None) -> DataFrame:
        """key, rank (from 1), id, distance: the k nearest rows of the probed lists, ties by id. A query that is itself a row finds
        itself. Queries without a vector and an empty index give no rows."""
        k, vec = self.k, F.col("vec").cast("array<double>").alias("vec")
        q = queries.filter(F.col(vector).isNotNull()).select(F.col(key).alias("__q"), F.col(vector).alias("vec"))
        schema = f"__q {q.schema['__q'].dataType.simpleString()}, id bigint, d double"

        def named(top: DataFrame) -> DataFrame:
            return top.select(F.col("__q").alias(key), "rank", F.col("id").alias("id" if key != "id" else "neighbour"), F.sqrt("d").alias("distance"))

        def stat(df: DataFrame) -> dict[int, int]:
            return {r["cell"]: r["count"] for r in df.groupBy("cell").count().collect()}  # a row per list

        asked, rows = {}, {}
        if len(self.centres):
            q, t = self._listed(q.select("__q", vec)), self._listed(self.train.select("id", vec))
            asked, rows = stat(q), stat(t)
        if not asked:
            return named(queries.sparkSession.createDataFrame([], f"{schema}, rank int"))
        n, m, dim = sum(rows.values()), sum(asked.values()), self.centres.shape[1]
        sizes = {cell: -(-c // BLOCK_ROWS) for cell, c in rows.items()}
        lists = _packed(t, sizes, tasks_of(q.sparkSession, sum(sizes.values()), n, dim))
        blocks = self._query_blocks(q, asked, min(probes or self.probes, len(self.centres)), tasks_of(q.sparkSession, m, m, dim))
        left = lists.coalesce(parts_of(m, n, dim, k)).select(*[F.col(c).alias(f"t{c}") for c in ("cell", "id", "vec")])
        # a task keeps its part of the queries and reads its part of the lists once, block by block; nothing is shuffled
        met = left.join(blocks.hint("shuffle_replicate_nl"), F.array_contains("near", F.col("tcell")))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[int, int], tuple[pa.Array, _Nearest]] = {}
            for b in batches:
                kind = b.schema.field("keys").type.value_type
                for at, sub, cell, keys, *row in zip(b["at"].to_pylist(), b["sub"].to_pylist(), b["tcell"].to_pylist(), b["keys"],
                                                     b["vec"], b["probed"], b["tid"], b["tvec"]):
                    x, probed, ids, y = (np.frombuffer(v.as_buffer(), dtype=d) for v, d in zip(row, (np.float64, np.uint8, np.int64, np.float64)))
                    if (at, sub) not in found:
                        found[at, sub] = pa.array(keys.as_py(), kind), _Nearest(len(keys), k)
                    places = np.flatnonzero(probed.reshape(len(keys), -1)[:, cell >> 3] & (128 >> (cell & 7)))
                    if len(places):
                        found[at, sub][1].see(x.reshape(len(keys), -1)[places], np.full(len(places), _NO_FOLD), y.reshape(len(ids), -1),
                                              ids, np.full(len(ids), _NO_FOLD), np.zeros(len(ids)), places)
            for keys, near in found.values():
                i, j = np.nonzero(np.isfinite(near.d2))
                ids = near.id[i, j]
                yield pa.record_batch([keys.take(pa.array(i)), pa.array(ids, mask=ids == _LAST), pa.array(near.d2[i, j])], names=["__q", "id", "d"])

        found = met.select("at", "sub", "keys", "vec", "probed", "tcell", "tid", "tvec").mapInArrow(best, schema)
        w = Window.partitionBy("__q").orderBy("d", "id")
        top = staged(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))
        discard(lists, blocks)
        return named(top)
