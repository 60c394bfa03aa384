"""Logistic regressions on TF-IDF features of any number of terms: no dictionary and no coefficients on the driver, all folds in one pass per step.

The counts are cut by terms: a part of the dictionary holds its terms' rows, parts are dealt to ``BLOCKS`` blocks. A coefficient vector of an
optimiser that starts at zero is a sum of gradients, and each gradient is X'v for one number v per row. So nothing of the dictionary's size is
kept: a step sends v to the blocks, each returns its share of XX'v, and the shares of a row are added. What the optimiser needs is the
products of these vectors with each other; the driver sees those (a few numbers per step and fold) and coordinates in an orthonormal base of
the vectors, in which ``linear.lbfgs`` takes the same steps as with all coefficients at hand.

While it is fitted, a model is only asked about its training rows, so a row's own fold is left out of all that travels; the rows left out get
their margins from one more pass with the sum of v that the model is made of. What a step found about a row stays with the row's chunk
(cached, dealt by chunk), so a step moves as much as the first one.

Terms are told apart by their 64-bit hash. A fold's document frequencies are those of its training rows, as if it were fitted on its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ..session import discard, staged
from .linear import LOSSES, lbfgs

#: rows of a chunk are below this power of two: a place in a chunk is an unsigned 16-bit number
CHUNK_BITS = 16
#: bytes of text behind one part of the dictionary, about: a part is built in one task
PART_BYTES = 16 << 20
#: groups of parts that a step works on, one in a task, at most; v goes to each of them. No more than tasks run at once, unless one were
#: made of more text than BLOCK_BYTES
BLOCKS = 24
BLOCK_BYTES = 512 << 20
#: a vector that adds less than this share of its square to the base lies in it
_NOTHING = 1e-12

#: part -1: the folds of a chunk's rows; chunk -1: a part's idf
_POSTINGS = "block int, part int, chunk bigint, term binary, pos binary, tf binary, idf binary, fold binary"
_UNSIGNED = {1: np.uint8, 2: np.uint16, 4: np.uint32}


def _binary(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _small(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest asks for."""
    most = int(x.max(initial=0))
    return _binary(x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32))


def _numbers(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, _UNSIGNED[len(x) // n]) if n else np.empty(0, np.uint8)


def _bits(x: np.ndarray, planes: int) -> bytes:
    """Whole numbers below 2^planes, one bit after another."""
    return b"".join(np.packbits((x >> p) & 1).tobytes() for p in range(planes))


def _of_bits(x: bytes, n: int, planes: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(x, np.uint8).reshape(planes, -1), axis=1, count=n) if n else np.empty((planes, 0), np.uint8)
    return (bits.astype(np.int64) << np.arange(planes)[:, None]).sum(axis=0)


def _table(rows: list[dict], ddl: str) -> pa.Table:
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return pa.Table.from_pylist(rows, pa.schema([(n, types[t]) for n, t in (c.split(" ") for c in ddl.split(", "))]))


def _cut(terms: DataFrame, parts: int, folds: Sequence[int]) -> DataFrame:
    """Each term of each row once, by part and chunk: the terms in order (h), the rows of each (n), and place, fold and count of these.

    ``terms``: _place, fold, h (array<bigint>)."""
    planes = max(1, (len(folds) - 1).bit_length())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, of_row, lists = (batch.column(i) for i in range(3))
            h = lists.flatten().to_numpy(zero_copy_only=False)
            if not len(h):
                continue
            row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))))
            tf = np.diff(np.append(new, len(h)))
            h, row = h[new], row[new]
            place = place.to_numpy()[row]
            fold = np.searchsorted(folds, of_row.to_numpy()).astype(np.uint16)[row]
            chunks, chunk = np.unique(place >> CHUNK_BITS, return_inverse=True)
            group = chunk * parts + (h.view(np.uint64) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            group, h, fold, tf = group[order], h[order], fold[order], tf[order]
            pos = (place[order] & ((1 << CHUNK_BITS) - 1)).astype(np.uint16)
            cuts = np.append(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), len(group)).tolist()
            out = []
            for a, z in zip(cuts, cuts[1:]):
                first = np.flatnonzero(np.concatenate(([True], h[a + 1:z] != h[a:z - 1])))
                out.append((int(group[a] % parts), int(chunks[group[a] // parts]), _binary(h[a:z][first]),
                            _small(np.diff(np.append(first, z - a))), _binary(pos[a:z]), _bits(fold[a:z], planes), _small(tf[a:z])))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), *[pa.binary()] * 5))],
                                  names=["part", "chunk", "h", "n", "pos", "fold", "tf"])

    return terms.mapInArrow(cut, "part int, chunk bigint, h binary, n binary, pos binary, fold binary, tf binary")


def _dictionary(cut: DataFrame, sizes: np.ndarray, min_df: float, max_df: float, blocks: int) -> DataFrame:
    """The postings of the terms that some fold uses, by part and chunk, and (chunk -1) each part's idf by term and fold (0: not used)."""
    k = len(sizes)
    planes = max(1, (k - 1).bit_length())
    least, most = (m if m >= 1 else m * sizes for m in (min_df, max_df))

    def build(t: pa.Table) -> pa.Table:
        part, chunk = t.column("part")[0].as_py(), t.column("chunk").to_numpy()
        parts = {c: t.column(c).to_pylist() for c in ("h", "n", "pos", "fold", "tf")}
        n = [len(x) // 2 for x in parts["pos"]]
        pos = np.frombuffer(b"".join(parts["pos"]), np.uint16)
        h = np.concatenate([np.repeat(np.frombuffer(x, np.int64), _numbers(y, len(x) // 8)) for x, y in zip(parts["h"], parts["n"])])
        fold = np.concatenate([_of_bits(x, i, planes) for x, i in zip(parts["fold"], n)])
        tf = np.concatenate([_numbers(x, i).astype(np.uint32) for x, i in zip(parts["tf"], n)])
        terms, term = np.unique(h, return_inverse=True)
        held = np.bincount(term * k + fold, minlength=len(terms) * k).reshape(-1, k)
        df = held.sum(1, keepdims=True) - held
        idf = np.where((df >= least) & (df <= most), np.log((1.0 + sizes) / (1.0 + df)) + 1.0, 0.0)
        used = idf.any(axis=1)
        keep = used[term]
        at = np.repeat(chunk, n)[keep]
        term, pos, tf = (np.cumsum(used) - 1)[term[keep]], pos[keep], tf[keep]
        own = {"block": part % blocks, "part": part}
        rows = [{**own, "chunk": -1, "idf": _binary(idf[used])}] if used.any() else []
        order = np.lexsort((term, at))
        at, term, pos, tf = at[order], term[order], pos[order], tf[order]
        cuts = np.append(np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))), len(at)).tolist() if len(at) else [0]
        rows += [{**own, "chunk": int(at[a]), "term": _small(np.diff(term[a:z], prepend=0)), "pos": _binary(pos[a:z]), "tf": _small(tf[a:z])}
                 for a, z in zip(cuts, cuts[1:])]
        return _table(rows, _POSTINGS)

    return cut.groupBy("part").applyInArrow(build, _POSTINGS)


def _training(fold: np.ndarray, k: int) -> np.ndarray:
    """rows x folds: is the row one that the fold's model is trained on?"""
    return fold[:, None] != np.arange(k)


def _products(postings: DataFrame, v: DataFrame | None, k: int, blocks: int, held: bool = False) -> DataFrame:
    """(chunk, z, v, square), staged: z = XX'v for features that are not divided by their row's norm, square = |X'v|^2 in all of a chunk's rows
    together. ``v``: (chunk, v), row by row the numbers of the models that are trained on the row (float, or double if ``held``); z has the same
    places, or with ``held`` one per row, by the model that is not trained on it. Without ``v``, z is the square of the norm by row and fold."""
    ddl = "chunk bigint, z binary, v binary, square binary"
    kind, squares = np.float64 if held else np.float32, v is None

    def share(counts: pa.Table, given: pa.Table) -> pa.Table:
        at = counts.column("part").to_numpy()
        chunks = counts.column("chunk").to_pylist()
        columns = {c: counts.column(c) for c in ("term", "pos", "tf", "idf", "fold")}
        training = {chunks[i]: _training(np.frombuffer(columns["fold"][i].as_buffer(), np.uint16), k) for i in np.flatnonzero(at == -1).tolist()}
        sent = {}
        for c, x in zip(given.column("chunk").to_pylist(), given.column("v")):
            sent[c] = np.zeros(training[c].shape)
            sent[c][training[c]] = np.frombuffer(x.as_buffer(), kind)
        z = {c: np.zeros(x.shape) for c, x in training.items()}
        square = np.zeros(k)
        by_part: dict[int, list[int]] = {}
        for i, p in enumerate(at.tolist()):
            if p != -1:
                by_part.setdefault(p, []).append(i)

        def arrays(i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            pos = np.frombuffer(columns["pos"][i].as_buffer(), np.uint16).astype(np.int64)
            return (np.cumsum(_numbers(columns["term"][i].as_buffer(), len(pos)), dtype=np.int64), pos,
                    _numbers(columns["tf"][i].as_buffer(), len(pos)).astype(np.float64))

        for some in by_part.values():
            first, = (i for i in some if chunks[i] == -1)
            idf = np.frombuffer(columns["idf"][first].as_buffer(), np.float64).reshape(-1, k)
            some = [i for i in some if i != first]
            u = idf
            if not squares:
                u = np.zeros(idf.shape)
                for i in some:
                    term, pos, tf = arrays(i)
                    for j in range(k):
                        u[:, j] += np.bincount(term, tf * sent[chunks[i]][:, j][pos], len(u))
                u *= idf
                square += (u * u).sum(axis=0)
            u = u * idf
            for i in some:
                term, pos, tf = arrays(i)
                tf = tf * tf if squares else tf
                for j in range(k):
                    z[chunks[i]][:, j] += np.bincount(pos, tf * u[:, j][term], len(z[chunks[i]]))
        out = {c: x if squares else x[~training[c] if held else training[c]] for c, x in z.items()}
        return _table([{"chunk": c, "z": _binary(x), "square": _binary(square if i == 0 else np.zeros(k))} for i, (c, x) in enumerate(out.items())],
                      "chunk bigint, z binary, square binary")

    def add(t: pa.Table, given: pa.Table) -> pa.Table:
        z, square = (reduce(np.add, (np.frombuffer(x) for x in t.column(c).to_pylist())) for c in ("z", "square"))
        own = given.column("v")[0].as_py() if len(given) else None
        return _table([{"chunk": t.column("chunk")[0].as_py(), "z": _binary(z), "v": own, "square": _binary(square)}], ddl)

    given = postings.sparkSession.createDataFrame([], "chunk bigint, v binary") if squares else v.select("chunk", "v")
    sent = given.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "chunk", "v").repartition(blocks, "block")
    shares = postings.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(share, "chunk bigint, z binary, square binary")
    return staged(shares.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(add, ddl))


class _Base:
    """An orthonormal base of one fold's vectors; ``of[m]`` says how its mth vector is made of the vectors added so far."""

    def __init__(self, most: int):
        self.of = np.zeros((0, 0))
        self.most = most

    def add(self, products: np.ndarray, square: float) -> np.ndarray:
        """Coordinates of a vector with these products with the vectors added before; the base grows if it lies outside."""
        c = self.of @ products
        left = square - c @ c
        grown = np.hstack([self.of, np.zeros((len(self.of), 1))])
        if left > _NOTHING * square:
            new = np.append(-(c @ self.of), 1.0) / np.sqrt(left)
            grown, c = np.vstack([grown, new]), np.append(c, np.sqrt(left))
        self.of = grown
        return np.append(c, np.zeros(self.most - len(c)))

    def weights(self, at: np.ndarray) -> np.ndarray:
        """The point with these coordinates as a sum of the vectors added so far."""
        return at[:len(self.of)] @ self.of


def fold_scores(rows: DataFrame, terms: Column, folds: Sequence[int], text_bytes: int, dense: Column | None = None, max_iter: int = 100,
                tol: float = 1e-6, min_df: float = 2, max_df: float = 0.95, blocks: int = BLOCKS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(_place, raw): the margin of every row by the logistic regression of the rows of all other folds.

    ``rows``: staged, with ``_place`` (``monotonically_increasing_id`` of the rows as staged), label (0 or 1) and fold. ``terms``: hashes of the
    row's terms, array<bigint>. ``dense``: array<float>, features beside the TF-IDF ones. The mean loss of a fold's n rows plus |w|^2 / 2n is
    minimised; the intercept is free. ``blocks``: at most so many groups of parts.
    """
    k = len(folds)
    counts = rows.groupBy("fold", "label").count().collect()
    if any(r["label"] not in (0, 1) for r in counts):
        raise ValueError("labels must be 0 or 1")
    sizes = np.array([sum(r["count"] for r in counts if r["fold"] != i) for i in folds], dtype=np.float64)
    n_dense = 0
    if dense is not None:
        n_dense = rows.select(F.size(dense).alias("d")).first()["d"]
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    blocks = min(blocks, max(tasks, -(-text_bytes // BLOCK_BYTES)))

    def pack(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("pos").to_numpy())
        x = t.column("dense").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(order), -1)[order] if n_dense else np.empty(0)
        fold = np.searchsorted(folds, t.column("fold").to_numpy()[order])
        return _table([{"chunk": t.column("chunk")[0].as_py(), "fold": _binary(fold.astype(np.uint16)),
                        "label": _binary(t.column("label").to_numpy()[order].astype(np.uint8)), "dense": _binary(x.astype(np.float32))}],
                      "chunk bigint, fold binary, label binary, dense binary")

    none = F.lit(None).cast("array<float>") if dense is None else dense.cast("array<float>")
    packed = staged(rows.select(
        F.shiftright("_place", CHUNK_BITS).alias("chunk"), F.col("_place").bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)).alias("pos"),
        F.col("fold").cast("bigint").alias("fold"), F.col("label").cast("bigint").alias("label"), none.alias("dense")).groupBy("chunk").applyInArrow(
            pack, "chunk bigint, fold binary, label binary, dense binary"))
    cut = _cut(rows.select("_place", F.col("fold").cast("bigint"), terms.alias("h")), blocks * max(1, -(-text_bytes // (part_bytes * blocks))), folds)
    own_folds = packed.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(-1).alias("part"), "chunk", "fold")
    postings = _dictionary(cut, sizes, min_df, max_df, blocks).unionByName(own_folds, allowMissingColumns=True)
    postings = postings.repartition(blocks, "block").sortWithinPartitions("block").persist(StorageLevel.MEMORY_AND_DISK)

    def by_chunk(df: DataFrame) -> DataFrame:
        """Cached where all of a chunk's rows are dealt to; at once, as plans only trust the partitions of what is there."""
        df = df.repartition(tasks, "chunk").sortWithinPartitions("chunk").persist(StorageLevel.MEMORY_AND_DISK)
        df.count()
        return df

    norms = _products(postings, None, k, blocks)
    base = by_chunk(packed.join(norms.select("chunk", F.col("z").alias("norm")), "chunk"))

    most = max_iter * 10 + 2
    bases = [_Base(most) for _ in folds]
    runs = [lbfgs(np.zeros(most + n_dense + 1), max_iter, tol) for _ in folds]
    points = np.array([next(r) for r in runs])
    found: list[DataFrame] = []  # by step
    written: list[DataFrame] = []
    nothing = by_chunk(norms.select(F.lit(0).alias("j"), "chunk", "z", "v").limit(0))

    def training(own: pa.Table) -> np.ndarray:
        return _training(np.frombuffer(own.column("fold")[0].as_py(), np.uint16), k)

    def numbers(seen: pa.Table, column: str, kind: type) -> Iterator[np.ndarray]:
        """What each step found about the chunk's rows, step by step."""
        for i in np.argsort(seen.column("j").to_numpy()).tolist():
            yield np.frombuffer(seen.column(column)[i].as_buffer(), kind)

    def dense_of(own: pa.Table, rows: int) -> np.ndarray:
        return np.frombuffer(own.column("dense")[0].as_py(), np.float32).reshape(rows, -1).astype(np.float64)

    def scale_of(own: pa.Table) -> np.ndarray:
        norm = np.sqrt(np.frombuffer(own.column("norm")[0].as_py())).reshape(-1, k)
        return np.divide(1.0, norm, out=np.zeros(norm.shape), where=norm > 0)

    def apply(work, ddl: str) -> DataFrame:
        # all of these are dealt alike, so nothing is shuffled
        seen = reduce(DataFrame.unionByName, found or [nothing])
        return base.groupBy("chunk").cogroup(seen.groupBy("chunk")).applyInArrow(work, ddl)

    def here() -> tuple[np.ndarray, np.ndarray]:
        d = np.array([b.weights(p[:most]) for b, p in zip(bases, points)]).reshape(k, len(found))
        return d, points[:, most:].copy()

    active = list(range(k))
    while active:
        (d, w), some = here(), np.isin(np.arange(k), active)

        def step(own: pa.Table, seen: pa.Table) -> pa.Table:
            rate, scale = training(own), scale_of(own)
            of = np.nonzero(rate)[1]
            x = dense_of(own, len(rate))
            m = np.zeros(rate.shape)
            m[rate] = sum((d[of, j] * z for j, z in enumerate(numbers(seen, "z", np.float64))), np.zeros(len(of)))
            m = m * scale + x @ w[:, :-1].T + w[:, -1]
            y = np.frombuffer(own.column("label")[0].as_py(), np.uint8).astype(np.float64)
            value, slope = LOSSES["logistic"](m, (2.0 * y - 1.0)[:, None])
            now = rate & some
            slope = slope * now
            v = (slope * scale)[rate].astype(np.float32)
            sums = np.column_stack([(value * now).sum(axis=0), slope.T @ x, slope.sum(axis=0)]
                                   + [np.bincount(of, z * v, k) for z in numbers(seen, "z", np.float64)])
            return _table([{"chunk": own.column("chunk")[0].as_py(), "sums": _binary(sums), "v": _binary(v)}], "chunk bigint, sums binary, v binary")

        sent = staged(apply(step, "chunk bigint, sums binary, v binary"))
        sums = reduce(np.add, (np.frombuffer(r["sums"]) for r in sent.select("sums").toLocalIterator())).reshape(k, -1)
        written.append(_products(postings, sent, k, blocks))
        square = reduce(np.add, (np.frombuffer(r["square"]) for r in written[-1].select("square").toLocalIterator()))
        found.append(by_chunk(written[-1].select(F.lit(len(found)).alias("j"), "chunk", "z", "v")))
        discard(sent)
        left = []
        for i in range(k):
            u = bases[i].add(sums[i, n_dense + 2:], square[i])
            if i not in active:
                continue
            at = points[i]
            g = np.append(u, sums[i, 1:n_dense + 2]) / sizes[i]
            g[:-1] += at[:-1] / sizes[i]
            try:
                points[i] = runs[i].send((float(sums[i, 0] / sizes[i] + 0.5 * (at[:-1] @ at[:-1]) / sizes[i]), g))
                left.append(i)
            except StopIteration as stop:
                points[i] = stop.value
        active = left
    d, w = here()

    def whole(own: pa.Table, seen: pa.Table) -> pa.Table:
        of = np.nonzero(training(own))[1]
        v = sum((d[of, j] * x for j, x in enumerate(numbers(seen, "v", np.float32))), np.zeros(len(of)))
        return _table([{"chunk": own.column("chunk")[0].as_py(), "v": _binary(v)}], "chunk bigint, v binary")

    sent = staged(apply(whole, "chunk bigint, v binary"))
    last = _products(postings, sent, k, blocks, held=True)

    def final(own: pa.Table, seen: pa.Table) -> pa.Table:
        left_out = ~training(own)
        fold, x = np.nonzero(left_out)[1], dense_of(own, len(left_out))
        m = np.frombuffer(seen.column("z")[0].as_buffer()) * scale_of(own)[left_out] + np.einsum("rd,rd->r", x, w[fold, :-1]) + w[fold, -1]
        place = (own.column("chunk")[0].as_py() << CHUNK_BITS) + np.arange(len(m))
        return pa.table({"_place": place, "raw": m})

    out = staged(base.groupBy("chunk").cogroup(last.groupBy("chunk")).applyInArrow(final, "_place bigint, raw double"))
    for df in (base, postings, nothing, *found):
        df.unpersist()
    discard(packed, norms, sent, last, *written)
    return out
