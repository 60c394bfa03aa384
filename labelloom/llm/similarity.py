"""Groups of texts whose word shingles have a least Jaccard similarity.

Every text is reduced once to keys such that similar texts share one:

* ``bands`` (the default): the least values of ``ROWS`` hash functions over its shingles make a band's key. Two sets of similarity
  s share a band with probability 1 - (1 - s^ROWS)^BANDS: 0.9994 at 0.8, and more above.
* ``prefixes``: two sets reach similarity t only if, in any fixed order of all shingles, the first |x| - ceil(t |x|) + 1 of
  each hold a common one. No pair is lost, at about twenty times the keys. The order is by frequency, rare ones first.

With ``bits`` texts also meet whose SimHash fingerprints (``simhash``: deletion variants, verified, chained) differ in at most
that many bits: their group is one more key.

What meets under a key is only a candidate: links are pairs whose exact similarity has been computed, on arrays of shingle hashes that
only candidates have. All sets of a key are compared with one of them; where that leaves others of the key apart, these
are compared among each other, so no similar pair that shares a key is missed, and a group of near copies costs its
size, not its square. Equal sets are one entry, whatever number of texts has them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
import xxhash

from .base import discard, pieces, staged, text_of
from .components import components
from .simhash import SHINGLE, with_fingerprint, with_root
from .superkmers import Known, mixed

PERCENT = 80
ROWS, BANDS = 4, 14
#: counters of the frequency table, and the pieces that it is added up in
COUNTERS = 1 << 21
_PIECES = 64
#: shingles of a block of candidates that are compared in one task, with one other block (one text may be longer)
GROUP_SHINGLES = 1_000_000
#: shingles whose hash functions are computed at once
_STEP = 8192

_U = np.uint64
_SEED = 42
#: odd multipliers of the hash functions
_FUNCTIONS = mixed(np.arange(1, ROWS * BANDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's word shingles.

    A-Z are lower-cased, words are separated by ASCII white space, a text with fewer words is one shingle, one without
    words has none.
    """
    digest = xxhash.xxh3_64_intdigest
    words = [np.fromiter(map(digest, p.split()), _U) for p in pieces(text.encode("utf-8", "surrogatepass").lower())]
    w = np.concatenate(words) if words else np.empty(0, _U)
    if not len(w):
        return w
    k = min(shingle, len(w))
    x = np.full(len(w) - k + 1, k, dtype=_U)
    for i in range(k):
        x = mixed(x * _U(0xD1342543DE82EF95) + w[i:len(w) - k + 1 + i])
    return np.unique(x)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band; none for an empty set."""
    if not len(hashes):
        return hashes
    least = np.full(len(_FUNCTIONS), ~_U(0))
    for at in range(0, len(hashes), _STEP):
        np.minimum(least, mixed(hashes[at:at + _STEP] * _FUNCTIONS[:, None]).min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=_U)
    for column in least.reshape(BANDS, ROWS).T:
        key = mixed(key * _U(0xD1342543DE82EF95) + column)
    return key


def frequency_levels(docs: DataFrame, text: str, shingle: int) -> np.ndarray:
    """For each counter the logarithm of its shingles' number, in steps of 9 %: one byte each. Shingles are hashed into
    the counters; they only order, so collisions cost time but no result."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                table[shingle_set(t, shingle) % COUNTERS] += 1
        if table.any():
            yield pa.record_batch([pa.array(range(_PIECES), pa.int32()),
                                   pa.array([x.tobytes() for x in np.split(table, _PIECES)], pa.binary())], names=["piece", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype=np.int64) for x in table.column("counts").to_pylist())
        level = np.minimum(8 * np.log2(total + 1.0), 255).astype(np.uint8)
        return pa.table({"piece": pa.array([table.column("piece")[0].as_py()], pa.int32()), "level": pa.array([level.tobytes()], pa.binary())})

    parts = docs.select(text_of(text)).mapInArrow(count, "piece int, counts binary")
    rows = parts.groupBy("piece").applyInArrow(add, "piece int, level binary").collect()
    return np.frombuffer(b"".join(r["level"] for r in sorted(rows)) or bytes(COUNTERS), dtype=np.uint8)


def prefix(hashes: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of which a set of that similarity has to share one; all sets order theirs alike."""
    n = len(hashes)
    order = np.lexsort((hashes, levels[hashes % COUNTERS]))
    return hashes[order[:n + (percent * n) // -100 + 1]]


def similar(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Places (i, j) of a spanning forest of the pairs of sets with at least that similarity in a hundred."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    left, out = np.argsort(-sizes, kind="stable"), []
    while len(left):
        border, left = [int(left[0])], left[1:]
        while border and len(left):
            at = border.pop()
            n = sizes[left]
            # sets of too different sizes can't be similar
            likely = left[100 * np.minimum(n, sizes[at]) >= percent * np.maximum(n, sizes[at])]
            near = [i for i in likely.tolist() if reaches(sets[at], sets[i], percent)]
            out += [(at, i) for i in near]
            border += near
            left = left[~np.isin(left, near)]
    return out


def reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b):
        return len(a) == len(b)
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    common = np.count_nonzero(a[at] == b)
    return 100 * common >= percent * (len(a) + len(b) - common)


def _lists(column: pa.Array) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(zero_copy_only=False).view(_U), column.offsets.to_numpy()
    return [values[a:z] for a, z in zip(ends, ends[1:])]


def _keyed(docs: DataFrame, key: str, text: str, shingle: int, keys: Callable, bits: int | None) -> DataFrame:
    """key, digest, set (a hash of all shingles), n (their number), the keys and, with ``bits``, the fingerprint of every row."""
    @F.arrow_udf("struct<set:bigint, n:bigint, keys:array<bigint>>")
    def cut(column: pa.Array) -> pa.Array:
        sets, sizes, found = [], [], []
        for t in column.to_pylist():
            s = shingle_set(t, shingle)
            sets.append(xxhash.xxh3_64_intdigest(s.tobytes(), _SEED))
            sizes.append(len(s))
            found.append(keys(s).view(np.int64))
        return pa.StructArray.from_arrays(
            [pa.array(np.array(sets, _U).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
            names=["set", "n", "keys"])

    whole = text_of(text)
    rows = docs.select(F.col(key).alias("key"), whole.alias("_t"))
    names = ["key", F.xxhash64("_t").alias("digest")]
    if bits is not None:
        rows, names = with_fingerprint(rows, "_t", "fingerprint", shingle), [*names, "fingerprint"]
    return rows.select(*names, cut("_t").alias("_c")).select("*", "_c.*").drop("_c")


def _fingerprint_keys(rows: DataFrame, bits: int) -> DataFrame:
    """set, n, h: the sets of each group of linked fingerprints that has several; h stands for the group."""
    sets = staged(rows.select("fingerprint", "set", "n").distinct())
    prints = staged(sets.select("fingerprint").distinct())
    grouped = sets.join(with_root(prints, bits), "fingerprint")
    out = staged(grouped.select("set", "n", F.xxhash64(F.lit("fingerprint"), "_root").alias("h")).distinct())
    discard(sets, prints)
    return out


def _arrays(docs: DataFrame, wanted: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """set, hashes: the shingles of the sets of ``wanted`` (set, key, digest), from one text each.

    Other texts are passed over by a bitmap of bounded size, before they reach Python.
    """
    known = Known(wanted.select(F.xxhash64("key", "digest").alias("h")))

    @F.arrow_udf("boolean")
    def is_known(h: pa.Array) -> pa.Array:
        return pa.array(known(h.to_numpy()))

    @F.arrow_udf("struct<set:bigint, hashes:array<bigint>>")
    def cut(column: pa.Array) -> pa.Array:
        sets = [shingle_set(t, shingle) for t in column.to_pylist()]
        names = np.array([xxhash.xxh3_64_intdigest(s.tobytes(), _SEED) for s in sets], _U)
        return pa.StructArray.from_arrays([pa.array(names.view(np.int64)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                                          names=["set", "hashes"])

    whole = text_of(text)
    one = docs.select(F.xxhash64(F.col(key), F.xxhash64(whole)).alias("_h"), whole.alias("_t")).filter(is_known("_h"))
    # a row may be there several times
    out = staged(one.select(cut("_t").alias("_c")).select("_c.*").dropDuplicates(["set"]))
    known.shared.destroy()
    return out


def _links(docs: DataFrame, rows: DataFrame, key: str, text: str, shingle: int, percent: int, bits: int | None) -> DataFrame:
    """(a, b): links between sets, enough for the components of all similar pairs that share a key."""
    sets = staged(rows.groupBy("set").agg(F.min(F.struct("key", "digest", "n", "keys")).alias("_o")).select(
        "set", "_o.key", "_o.digest", "_o.n", "_o.keys"))
    met = sets.select("set", "n", F.explode("keys").alias("h"))
    prints = [] if bits is None else [_fingerprint_keys(rows, bits)]
    for more in prints:
        met = met.unionByName(more)
    heads = met.groupBy("h").agg(F.min(F.struct("set", "n")).alias("_b"), F.count("*").alias("_k")).filter("_k > 1")
    heads = staged(heads.select("h", F.col("_b")["set"].alias("b"), F.col("_b")["n"].alias("_m"), F.col("_k")))
    shared = staged(met.join(heads, "h").filter("set != b"))
    fits = 100 * F.least("n", "_m") >= percent * F.greatest("n", "_m")
    pairs = staged(shared.filter(fits).select(F.col("set").alias("a"), "b").distinct())
    wanted = shared.select("set").unionByName(heads.select(F.col("b").alias("set"))).distinct()
    arrays = _arrays(docs, staged(sets.join(wanted, "set").select("set", "key", "digest")), key, text, shingle)

    @F.arrow_udf("boolean")
    def near(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([reaches(x, y, percent) for x, y in zip(_lists(a), _lists(b))], pa.bool_())

    of = [arrays.select(F.col("set").alias(c), F.col("hashes").alias(f"_{c}")) for c in "ab"]
    direct = staged(pairs.join(of[0], "a").join(of[1], "b").filter(near("_a", "_b")).select("a", "b"))
    roots = components(direct).select(F.col("a").alias("set"), F.col("b").alias("_root"))

    # keys whose other sets are not all in one group: these may be similar to each other
    rooted = shared.filter("_k > 2").join(roots, "set", "left").select("h", "set", "n", F.coalesce("_root", "set").alias("_root"))
    apart = rooted.groupBy("h").agg(
        F.min("_root").alias("_x"), F.max("_root").alias("_y"), F.sum("n").alias("_n"), F.count("*").alias("_c"),
        F.bit_xor(F.xxhash64("set")).alias("_same")).filter("_x < _y")
    # keys with the same sets are one group
    apart = apart.groupBy("_same", "_c", "_n").agg(F.min("h").alias("h"))
    blocks = F.ceil(F.greatest(F.col("_n"), F.lit(1)) / GROUP_SHINGLES).cast("int").alias("_m")
    members = rooted.select("h", "set").join(apart.select("h", blocks), "h").withColumn("_i", F.pmod(F.xxhash64("set"), "_m").cast("int"))
    members = members.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    found = members.join(arrays, "set").select("h", F.least("_i", "_j").alias("_x"), F.greatest("_i", "_j").alias("_y"), "set", "hashes")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = [x for c in table.column("hashes").chunks for x in _lists(c)]
        seen = dict(zip(table.column("set").to_pylist(), lists))
        names = sorted(seen)
        near = similar([seen[x] for x in names], percent)
        return pa.table({"a": pa.array([names[i] for i, _ in near], pa.int64()), "b": pa.array([names[j] for _, j in near], pa.int64())})

    more = found.groupBy("h", "_x", "_y").applyInArrow(compare, "a bigint, b bigint")
    out = staged(direct.unionByName(more))
    discard(sets, heads, shared, pairs, arrays, direct, *prints)
    return out


def similar_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                  percent: int = PERCENT, exact: bool = False, bits: int | None = None) -> DataFrame:
    """(key, digest, component_id), one row per row of ``docs``.

    Texts are linked if the Jaccard similarity of their distinct word shingles (by 64-bit hashes) is at least ``percent`` in a
    hundred; ``component_id`` is the smallest key reachable over links, the row's own included. ``exact`` finds candidates by
    prefixes, without it by bands; with ``bits`` also by SimHash fingerprints. NULL keys are never the smallest, and a component of NULL keys alone has a NULL id. Texts
    without words are similar to each other only. ``digest`` tells texts with the same key apart. Repeated rows stay
    repeated; an empty table gives none.
    """
    keys = bands
    if exact:
        levels = frequency_levels(docs, text, shingle)
        keys = lambda s: prefix(s, levels, percent)
    rows = staged(_keyed(docs, key, text, shingle, keys, bits))
    links = _links(docs, rows, key, text, shingle, percent, bits)
    stars = components(links)
    discard(links)
    sets = rows.groupBy("set").agg(F.min("key").alias("_first"))
    rooted = sets.join(stars.withColumnRenamed("a", "set"), "set", "left").withColumn("_root", F.coalesce("b", "set"))
    smallest = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = staged(rooted.join(smallest, "_root").select("set", "component_id"))
    # many rows may have one set: adaptive execution splits that side of the join
    return rows.join(named, "set").select(F.col("key").alias(key), "digest", "component_id")
