"""Windows of a text that occur earlier in the corpus, by super-k-mer partitioning.

A window is k consecutive units (words or bytes). Its minimiser is the smallest hash of the m-unit pieces inside it:
equal windows have equal minimisers, and consecutive windows mostly share one. A maximal run of windows with one
minimiser, a super-k-mer, travels as one packed string to the place where all strings of that minimiser meet.

1. Count the minimisers of all documents. A window can only be repeated if its minimiser is; the repeated ones are set
   in a bitmap of bounded size. A full bitmap lets more strings travel and changes no result.
2. List the strings with such minimisers by a 128-bit digest and place, without their content. Equal strings are one
   entry (copies of a document of any number are one), with the place where they occur first.
3. Minimisers with one distinct string need no comparison. For the others the content is cut out of the texts, at most
   once a task for each string, and dealt to buckets of bounded size to be compared there. Minimisers with very many
   distinct strings (a frequent passage between changing neighbours) are settled window by window with partial
   aggregation instead, so no bucket grows with one passage.
4. What was found returns to all occurrences of a string, and from there to the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
import xxhash

from .base import LAST_ID, discard, staged, text_of

#: positions inside a document are below this
_PLACE = 1 << 40
#: bits of the bitmap per repeated minimiser, and its bits at most (64 MB)
_BITS_EACH = 16
_MIN_BITS, _MAX_BITS = 1 << 20, 1 << 29
_BITMAP_BITS = 8 * 4096  # of one row of Spark's bitmap aggregate
#: bytes of a bitmap that come to the driver at once, about
_PIECE = 4 << 20

_U = np.uint64


@dataclass(frozen=True)
class Runs:
    """Super-k-mers of some documents: row of the document, first window, number of windows, minimiser, and whether the
    minimiser occurs in the string more than once (only then may the string repeat one of its own windows)."""

    row: np.ndarray
    start: np.ndarray
    n: np.ndarray
    value: np.ndarray
    twice: np.ndarray


@dataclass(frozen=True)
class Units:
    """How texts are cut. ``chunks`` turns an array of texts into (first row, units per row, hashes of all m-unit pieces,
    function that packs (flat start, flat end) of units), a bounded amount of text at a time."""

    k: int
    m: int
    bucket_strings: int  # strings of a bucket, about
    chunks: Callable[[pa.Array], Iterator[tuple]]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers so that their order says nothing."""
    x = x ^ (x >> _U(31))
    x = x * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def runs_of(sizes: np.ndarray, pieces: np.ndarray, k: int, m: int, within: bool) -> Runs:
    """``pieces``: hash of the m units at each flat position of the concatenated texts. ``twice`` is left out (False)
    unless ``within``."""
    windows = np.maximum(sizes - k + 1, 0)
    total = int(windows.sum())
    none = np.empty(0, np.int64)
    if not total:
        return Runs(none, none, none, none.view(_U), none.astype(bool))
    least = sliding_min(pieces, k - m + 1)
    row = np.repeat(np.arange(len(sizes)), windows)
    before = np.cumsum(windows) - windows
    in_row = np.arange(total) - np.repeat(before, windows)
    flat = in_row + np.repeat(np.cumsum(sizes) - sizes, windows)
    value = least[flat]
    new = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (row[1:] != row[:-1]))))
    n = np.diff(np.append(new, total))
    twice = np.zeros(len(new), dtype=bool)
    if within:
        # places of the minimiser: those that start one of the run's windows but the last, then those in the last window
        leads = np.cumsum(np.concatenate(([0], pieces[flat] == value)))
        end = new + n - 1
        inside = np.lib.stride_tricks.sliding_window_view(pieces, k - m + 1)[flat[end]] == value[end][:, None]
        twice = leads[end] - leads[new] + np.count_nonzero(inside, axis=1) > 1
    return Runs(row[new], in_row[new], n, value[new], twice)


def sorted_windows(ids: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts equal windows side by side, and where a new window begins. Exact: hashes only pre-sort."""
    x, span = mixed((ids.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)), 1
    parts, offset = [], 0
    while True:  # binary parts of k, from doubled spans
        if k & span:
            parts.append((offset, x))
            offset += span
        if 2 * span > k:
            break
        x = mixed(x[:-span] * _U(0xD1342543DE82EF95) + x[span:])
        span *= 2
    code = np.zeros(len(at), dtype=_U)
    for shift, values in parts:
        code = mixed(code * _U(0x9E3779B97F4A7C15) + values[at + shift])
    order = np.argsort(code, kind="stable")
    same_code = code[order][1:] == code[order][:-1]
    a, b = at[order][:-1][same_code], at[order][1:][same_code]
    if all((ids[a + j] == ids[b + j]).all() for j in range(k)):
        return order, np.concatenate(([True], ~same_code))
    order = np.lexsort([ids[at + j] for j in range(k - 1, -1, -1)])
    a, b = at[order][:-1], at[order][1:]
    same = np.ones(len(a), dtype=bool)
    for j in range(k):
        same &= ids[a + j] == ids[b + j]
    return order, np.concatenate(([True], ~same))


def _repeated(texts: DataFrame, units: Units, within: bool) -> DataFrame:
    """(h): minimisers of at least two documents, or (``within``) of two places."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sizes, pieces, _ in units.chunks(batch.column(0)):
                r = runs_of(sizes, pieces, units.k, units.m, within)
                if within:
                    h, times = r.value, 1 + r.twice
                else:
                    order = np.lexsort((r.row, r.value))
                    h, row = r.value[order], r.row[order]
                    once = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else slice(0)
                    h, times = h[once], None
                h, at = np.unique(h, return_inverse=True)
                n = np.bincount(at, weights=times, minlength=len(h)) if len(h) else np.empty(0)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    counted = texts.select("_bytes").mapInArrow(count, "h bigint, n bigint")
    return counted.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")


def _bitmap(values: DataFrame) -> np.ndarray:
    """The values as a bitmap (bytes, lowest bit first) of a size that follows their number up to ``_MAX_BITS``."""
    bits = _MIN_BITS
    n = values.count()
    while bits < _MAX_BITS and bits < n * _BITS_EACH:
        bits *= 2
    place = F.col("h").bitwiseAND(F.lit(bits - 1)) + 1
    parts = values.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    each = _BITMAP_BITS // 8
    made = parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map"))
    # an iterator holds one partition, which adaptive execution would make of all of them
    for r in made.repartition(max(1, len(out) // _PIECE), "part").toLocalIterator():
        out[(r["part"] - 1) * each:r["part"] * each] = np.frombuffer(r["map"], dtype=np.uint8)
    return out


class Known:
    """Values whose bit is set; the bitmap is shared with the tasks once."""

    def __init__(self, values: DataFrame):
        bitmap = _bitmap(values)
        self.shared = values.sparkSession.sparkContext.broadcast(bitmap)
        self.last = _U(len(bitmap) * 8 - 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = (h.view(_U) & self.last).astype(np.int64)
        return ((self.shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)

    def free(self) -> None:
        """Executors keep no copy; the driver's goes with the last plan that names it. A task that still asks gets the values again."""
        self.shared.unpersist()


def _digests(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, packed)), dtype=np.int64).reshape(-1, 2)


def _places(texts: DataFrame, units: Units, known: Known, within: bool) -> DataFrame:
    """Every super-k-mer whose minimiser is known: where it is, and the digest of its content."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tags = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for first, sizes, pieces, pack in units.chunks(batch.column(0)):
                r = runs_of(sizes, pieces, units.k, units.m, within)
                keep = np.flatnonzero(known(r.value))
                if not len(keep):
                    continue
                row, start, n = r.row[keep], r.start[keep], r.n[keep]
                flat = start + (np.cumsum(sizes) - sizes)[row]
                d = _digests([pack(a, z) for a, z in zip(flat.tolist(), (flat + n + units.k - 1).tolist())])
                yield pa.record_batch(
                    [r.value[keep].view(np.int64), d[:, 0], d[:, 1], docs[first + row], tags[first + row], start, n, r.twice[keep]],
                    names=["h", "d1", "d2", "doc", "tag", "start", "n", "twice"])

    ddl = "h bigint, d1 bigint, d2 bigint, doc bigint, tag bigint, start bigint, n bigint, twice boolean"
    return texts.select("_bytes", "doc", "tag").mapInArrow(cut, ddl)


def _strings(texts: DataFrame, units: Units, several: Known, frequent: Known) -> DataFrame:
    """The content of the super-k-mers that need comparing, each distinct one at most once a task."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            for _, sizes, pieces, pack in units.chunks(batch.column(0)):
                r = runs_of(sizes, pieces, units.k, units.m, False)
                keep = np.flatnonzero(several(r.value))
                if not len(keep):
                    continue
                flat = r.start[keep] + (np.cumsum(sizes) - sizes)[r.row[keep]]
                packed = [pack(a, z) for a, z in zip(flat.tolist(), (flat + r.n[keep] + units.k - 1).tolist())]
                d = _digests(packed)
                fresh = []
                for i, x in enumerate(map(tuple, d.tolist())):
                    if x not in sent:
                        sent.add(x)
                        fresh.append(i)
                h = r.value[keep][fresh]
                yield pa.record_batch(
                    [pa.array(h.view(np.int64)), pa.array(d[fresh, 0]), pa.array(d[fresh, 1]), pa.array(frequent(h)),
                     pa.array([packed[i] for i in fresh], pa.binary())], names=["h", "d1", "d2", "frequent", "packed"])

    return texts.select("_bytes").mapInArrow(cut, "h bigint, d1 bigint, d2 bigint, frequent boolean, packed binary")


def _place() -> Column:
    """(doc, start) as one number, which partial aggregation can take the least of."""
    return (F.col("doc").cast("decimal(38,0)") * F.lit(_PLACE).cast("decimal(20,0)") + F.col("start")).cast("decimal(38,0)")


_SPANS = "array<struct<a:bigint, z:bigint>>"
_SETTLED = f"h bigint, d1 bigint, d2 bigint, spans {_SPANS}"
_SPANS_TYPE = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))


def spans_of(flags: np.ndarray) -> list[dict]:
    """Maximal runs of set flags, end exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [{"a": a, "z": z} for a, z in edges.reshape(-1, 2).tolist()]


def covered_windows(docs: DataFrame, units: Units, settle: Callable, one_window: Callable[[Column, Column], Column],
                    within: bool, most_strings: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, tag, spans): for each document with repeated windows, the ranges [a, z) of windows that also start earlier.

    Earlier: in a document with a smaller key or, if ``within``, at an earlier place of the same document. ``doc`` is the
    key (``LAST_ID`` if NULL), ``tag`` the xxhash64 of the text. ``settle`` maps one bucket's (minimiser, doc, start, number
    of windows, ``twice``, packed string) to the flags of the windows found in earlier strings; ``one_window`` is the Column of the
    ith window of a packed string, for minimisers with more than ``most_strings`` distinct strings.
    """
    texts = docs.select(text_of(text).cast("binary").alias("_bytes"),
                        F.coalesce(F.col(key).cast("bigint"), F.lit(LAST_ID)).alias("doc"),
                        F.xxhash64(text_of(text)).alias("tag"))
    repeated = staged(_repeated(texts, units, within))
    known = Known(repeated)
    discard(repeated)
    places = staged(_places(texts, units, known, within))
    known.free()
    of_string = ["h", "d1", "d2"]
    order = _place() if within else F.col("doc")
    distinct = places.withColumn("_order", order).groupBy(*of_string, "n", "twice").agg(
        F.min("_order").alias("first"), F.count("*").alias("copies"))
    one = F.lit(_PLACE).cast("decimal(20,0)")
    doc = F.floor(F.col("first") / one).cast("bigint") if within else F.col("first")
    start = (F.col("first") - doc.cast("decimal(38,0)") * one).cast("bigint") if within else F.lit(0).cast("bigint")
    distinct = staged(distinct.select(*of_string, "n", "twice", "copies", doc.alias("doc"), start.alias("start")))
    counts = distinct.groupBy("h").agg(F.count("*").alias("_k"), F.bool_or("twice").alias("_self"))
    counts = staged(counts.filter("_k > 1 or _self"))
    several, frequent = Known(counts.select("h")), Known(counts.filter(F.col("_k") > most_strings).select("h"))

    @F.arrow_udf("boolean")
    def is_frequent(h: pa.Array) -> pa.Array:
        return pa.array(frequent(h.to_numpy()))

    strings = staged(_strings(texts, units, several, frequent))
    # merged: what a file holds in few bytes would be much larger when the driver made a broadcast table of it
    facts = distinct.join(counts.select("h").hint("merge"), "h").withColumn("_frequent", is_frequent("h"))
    buckets = max(1, -(-(counts.agg(F.sum("_k")).first()[0] or 0) // units.bucket_strings))
    to_bucket = F.pmod(F.xxhash64("h"), F.lit(buckets)).alias("_bucket")

    def bucket(facts: pa.Table, strings: pa.Table) -> pa.Table:
        at = {x: i for i, x in enumerate(zip(strings.column("d1").to_pylist(), strings.column("d2").to_pylist()))}
        of = [at[x] for x in zip(facts.column("d1").to_pylist(), facts.column("d2").to_pylist())]
        packed = strings.column("packed").take(pa.array(of, pa.int64())).to_pylist()
        flags = settle(*(facts.column(c).to_numpy() for c in ("h", "doc", "start", "n", "twice")), packed) if packed else []
        hit = [i for i, f in enumerate(flags) if f is not None and f.any()]
        some = facts.take(pa.array(hit, pa.int64()))
        return pa.table({"h": some.column("h"), "d1": some.column("d1"), "d2": some.column("d2"),
                         "spans": pa.array([spans_of(flags[i]) for i in hit], _SPANS_TYPE)})

    few = facts.filter("not _frequent").select(to_bucket, *of_string, "doc", "start", "n", "twice")
    settled = few.groupBy("_bucket").cogroup(
        strings.filter("not frequent").select(to_bucket, *of_string, "packed").groupBy("_bucket")).applyInArrow(bucket, _SETTLED)
    many = staged(facts.filter("_frequent").select(*of_string, "doc", "start", "n").join(
        strings.filter("frequent").groupBy(*of_string).agg(F.first("packed").alias("packed")).hint("merge"), of_string))
    settled = staged(settled.unionByName(_settle_windows(many, one_window, within)))
    several.free()
    frequent.free()
    discard(counts, strings, many)

    firsts = distinct.select(*of_string, "copies", F.col("doc").alias("_doc"), F.col("start").alias("_start"))
    firsts = firsts.join(settled.hint("merge"), of_string, "left").filter("copies > 1 or spans is not null")
    later = F.col("doc") > F.col("_doc")
    if within:
        later = later | ((F.col("doc") == F.col("_doc")) & (F.col("start") > F.col("_start")))
    all_of_it = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("z")))
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("start")).alias("a"), (s["z"] + F.col("start")).alias("z")))
    found = places.select(*of_string, "doc", "tag", "start", "n").join(firsts.hint("merge"), of_string)
    found = found.withColumn("_spans", F.when(later, all_of_it).otherwise(moved)).filter("_spans is not null")
    return found.groupBy("doc", "tag").agg(F.array_sort(F.flatten(F.collect_list("_spans"))).alias("spans"))


def _settle_windows(strings: DataFrame, one_window: Callable[[Column, Column], Column], within: bool) -> DataFrame:
    """The same for strings of frequent minimisers: each window with the least place it starts at, by aggregation."""
    w = strings.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    w = w.withColumn("_w", one_window(F.col("packed"), F.col("i"))).withColumn("start", F.col("start") + F.col("i"))
    w = w.withColumn("_at", _place() if within else F.col("doc")).select("h", "d1", "d2", "i", "_w", "_at")
    least = w.groupBy("h", "_w").agg(F.min("_at").alias("_least"))
    late = w.join(least.hint("merge"), ["h", "_w"]).filter("_least < _at")
    span = F.struct(F.col("i").alias("a"), (F.col("i") + 1).alias("z"))
    # an array of at most the windows of one string
    return late.groupBy("h", "d1", "d2").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def with_spans(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", name: str = "__spans") -> DataFrame:
    """``docs`` with the spans of each row; NULL where there are none."""
    d = docs.withColumn("__doc", F.coalesce(F.col(key).cast("bigint"), F.lit(LAST_ID))).withColumn(
        "__tag", F.xxhash64(text_of(text)))
    f = found.select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), F.col("spans").alias(name))
    return d.join(f.hint("merge"), ["__doc", "__tag"], "left").drop("__doc", "__tag")


def unit_spans(spans: list[dict] | None, k: int) -> list[tuple[int, int]]:
    """Maximal runs of units inside the given windows. Window ranges are sorted by start."""
    out: list[tuple[int, int]] = []
    for s in spans or ():
        a, z = s["a"], s["z"] + k - 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out
