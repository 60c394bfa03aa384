"""Near-duplicates by SimHash with deletion-variant signatures.

A fingerprint has 64 bits. Two of them differ in at most d bits only if, cut into d // 2 + 1 segments, some segment
differs in at most one bit. So every fingerprint is indexed once for each bit of each segment, with that bit left out:
two segments that differ in at most one bit share such a variant. An equality grouping on the variants brings the
candidates together, which are verified on all 64 bits. Equal fingerprints are one entry, so groups of copies of any
size are one row before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
import xxhash

from .base import staged, text_of
from .components import components

BITS = 64
SEED = 42
SHINGLE = 4
MAX_BITS = 4
#: shingles whose bits are counted at once; bounds memory on very long texts
_STEP = 65_536
#: runs up to this length are compared pair by pair, longer ones by growing a spanning forest
_SHORT_RUN = 48
#: links remembered in a task, to leave out those that say nothing new
_MEMORY = 200_000


def _hashes(text: str, shingle: int) -> Iterator[bytes]:
    """XXH64 digests of the text's word shingles, ``_STEP`` at a time; nothing for a text without words.

    A-Z are lower-cased, words are separated by ASCII white space, a text with fewer words is one shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_digest
    for at in range(0, n, _STEP):
        some = starts[at:at + min(_STEP, n - at)]
        ends = starts[at + shingle:at + shingle + len(some)] if len(words) >= shingle else starts[-1:]
        yield b"".join([digest(joined[a:z - 1], SEED) for a, z in zip(some, ends)])


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of the text's word shingles as a signed 64-bit number; 0 for a text without words.

    Repeated shingles count. A bit is set if more than half of the shingles' XXH64 hashes have it.
    """
    n, counts = 0, np.zeros(BITS, dtype=np.int64)
    for hashes in _hashes(text, shingle):
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(bits)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles."""
    return np.unique(np.frombuffer(b"".join(_hashes(text, shingle)), dtype=np.uint64))


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    @F.arrow_udf("bigint")
    def prints(column: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t or "", shingle) for t in column.to_pylist()], type=pa.int64())

    return docs.withColumn(name, prints(text_of(text)))


def masks(max_bits: int) -> list[int]:
    """A mask for each bit of each segment: the segment without that bit. Signed, as Spark's integers are."""
    segments = max_bits // 2 + 1
    cuts = [i * BITS // segments for i in range(segments + 1)]
    out = []
    for a, z in zip(cuts, cuts[1:]):
        whole = (1 << z) - (1 << a)
        out += [whole & ~(1 << bit) for bit in range(a, z)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in out]


class _Links:
    """Verified links of the runs of equal keys in one task, without those that earlier links imply."""

    def __init__(self, max_bits: int):
        self.max_bits = max_bits
        self.parent: dict[int, int] = {}

    def _root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def fresh(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        if len(self.parent) > _MEMORY:
            self.parent.clear()
        out = []
        for x, y in zip(a.tolist(), b.tolist()):
            rx, ry = self._root(x), self._root(y)
            if rx != ry:
                self.parent[ry] = rx
                out.append((x, y))
        return out

    def of_runs(self, keys: np.ndarray, prints: np.ndarray) -> list[tuple[int, int]]:
        """``keys`` sorted; whole runs only."""
        if len(keys) < 2:
            return []
        firsts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(firsts, len(keys)))
        size_of_row = np.repeat(sizes, sizes)
        found = []
        rows = np.flatnonzero((size_of_row > 1) & (size_of_row <= _SHORT_RUN))
        step = 1
        while len(rows):
            rows = rows[rows + step < len(keys)]
            rows = rows[keys[rows] == keys[rows + step]]
            near = rows[np.bitwise_count(prints[rows] ^ prints[rows + step]) <= self.max_bits]
            found += self.fresh(prints[near].view(np.int64), prints[near + step].view(np.int64))
            step += 1
        for at, n in zip(firsts[sizes > _SHORT_RUN].tolist(), sizes[sizes > _SHORT_RUN].tolist()):
            found += self._forest(np.unique(prints[at:at + n]))
        return found

    def _forest(self, left: np.ndarray) -> list[tuple[int, int]]:
        """A spanning forest of the links in one long run: whoever is reached is not compared again."""
        out: list[tuple[int, int]] = []
        while len(left):
            border, left = [left[0]], left[1:]
            while border and len(left):
                at = border.pop()
                near = np.bitwise_count(left ^ at) <= self.max_bits
                if near.any():
                    reached = left[near]
                    out += self.fresh(np.full(len(reached), at).view(np.int64), reached.view(np.int64))
                    border += list(reached)
                    left = left[~near]
        return out


def links(prints: DataFrame, max_bits: int = MAX_BITS, name: str = "fingerprint") -> DataFrame:
    """(a, b): links between distinct fingerprints at ``max_bits`` or fewer differing bits.

    Not all links, but enough for the same components: a link that others found in the same task imply is left out, so
    a large group of near copies gives a tree and not all its pairs. ``prints`` must hold distinct fingerprints.
    """
    variant = F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks(max_bits)])).alias("mask")
    keyed = prints.select(F.col(name).alias("fp"), variant).select(
        F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp")
    # hashes of equal variants are equal; others that happen to be are ruled out by the verification
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Links(max_bits)
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the last key so far

        def done(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            pairs = state.of_runs(keys, fps)
            if pairs:
                a, b = zip(*pairs)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

        for batch in batches:
            keys = batch.column("key").to_numpy()
            fps = batch.column("fp").to_numpy().view(np.uint64)
            if not len(keys):
                continue
            if held and keys[-1] == held[0][0][0]:
                held.append((keys, fps))
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            whole = [*held, (keys[:last], fps[:last])]
            held = [(keys[last:], fps[last:])]
            yield from done(np.concatenate([k for k, _ in whole]), np.concatenate([f for _, f in whole]))
        if held:
            yield from done(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))

    return dealt.mapInArrow(verify, "a bigint, b bigint")


def with_root(prints: DataFrame, max_bits: int = MAX_BITS, name: str = "fingerprint") -> DataFrame:
    """``prints`` (distinct fingerprints, staged) with ``_root``: one fingerprint of all those that are reachable over links."""
    stars = components(links(prints, max_bits, name))
    return prints.join(stars.withColumnRenamed("a", name), name, "left").withColumn("_root", F.coalesce("b", name)).drop("b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(key, digest, fingerprint, component_id), one row per row of ``docs``.

    ``component_id`` is the smallest key reachable over links, the row's own included; NULL keys are never the smallest,
    and a component of NULL keys alone has a NULL id. NULL and empty texts have fingerprint 0, which links like any
    other. ``digest`` tells texts with the same key apart. Repeated rows stay repeated; an empty table gives none.
    """
    rows = staged(with_fingerprint(docs.select(F.col(key), F.col(text)), text, "fingerprint", shingle)
                  .select(key, F.xxhash64(text_of(text)).alias("digest"), "fingerprint"))
    prints = staged(rows.groupBy("fingerprint").agg(F.min(key).alias("_first")))
    rooted = with_root(prints, max_bits)
    smallest = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = rooted.join(smallest, "_root").select("fingerprint", "component_id")
    # many rows may carry one fingerprint: adaptive execution splits that side of the join
    return rows.join(named, "fingerprint").select(key, "digest", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", find: Callable[..., DataFrame] = near_duplicates,
                **options) -> DataFrame:
    """``docs`` with one row of every group of near copies: the one with the smallest key (of equal keys, one row).

    Rows with a NULL key stay only where no keyed row is in their group, one of each distinct text. ``find`` gives the
    groups as ``near_duplicates`` does.
    """
    found = find(docs, key, text, **options)
    kept = found.filter(F.col("component_id").isNull() | (F.col(key) == F.col("component_id")))
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__digest") == F.col("__other"))
    kept = kept.select(F.col(key).alias("__key"), F.col("digest").alias("__other")).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return (docs.withColumn("__digest", F.xxhash64(text_of(text))).join(kept, same, "left_semi")
            .dropDuplicates([key, "__digest"]).select(*columns))
