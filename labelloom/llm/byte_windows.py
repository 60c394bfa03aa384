"""Repeated substrings of the whole corpus, by super-k-mers of bytes and a run-length index in each bucket.

A bucket holds the distinct strings of some minimisers, in order of their first places. They are halved again and again:
the earlier half is indexed, the later half's matching statistics are streamed over it, and windows with a match of full
length occur earlier. Different minimisers share no window, so all of a bucket's halvings of one turn share an index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .base import text_of
from .run_length_index import RunLengthIndex
from .superkmers import Units, covered_windows, mixed, sorted_windows, unit_spans, with_spans

WINDOW = 100
PIECE = 32
#: bytes of the texts that are looked at together (one text may be longer); their hashes stay in a core's cache
_CHUNK_BYTES = 1 << 17
#: distinct strings of one minimiser that are indexed in a bucket; with more, their windows are sorted there
MOST_INDEXED = 16
#: distinct strings of one minimiser that meet in a bucket; with more, windows are aggregated by Spark
MOST_STRINGS = 16_000
#: strings of a bucket, about: enough to advance together
BUCKET_STRINGS = 16_000
#: windows of a stream at most; longer strings are streamed in overlapping parts
_STREAM_WINDOWS = 512

_U = np.uint64


def _pieces(data: np.ndarray, m: int) -> np.ndarray:
    """Hash of the m bytes at each position; m is a power of two."""
    x = mixed((np.arange(256, dtype=_U) + _U(1)) * _U(0x9E3779B97F4A7C15))[data]
    span = 1
    while span < m and len(x) > span:
        x = x[:-span] * _U(0xD1342543DE82EF95 + 2 * span) + x[span:]
        span *= 2
    return mixed(x) if span == m else x[:0]


def _units(k: int, m: int) -> Units:
    def chunks(texts: pa.Array) -> Iterator[tuple]:
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32 if pa.types.is_binary(texts.type) else np.int64)
        offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        held = texts.buffers()[2]
        data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.empty(0, np.uint8)
        first = 0
        while first < len(texts):
            end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _CHUNK_BYTES, side="right")) - 1)
            part = data[offsets[first]:offsets[end]]
            yield first, np.diff(offsets[first:end + 1]), _pieces(part, m), lambda a, z, part=part: part[a:z].tobytes()
            first = end

    return Units(k, m, BUCKET_STRINGS, chunks)


def _halvings(n: int) -> list[tuple[int, int, int]]:
    """(from, middle, to): every pair of n ordered strings is on different sides of exactly one of them."""
    out, todo = [], [(0, n)]
    while todo:
        a, z = todo.pop()
        if z - a > 1:
            middle = (a + z) // 2
            out.append((a, middle, z))
            todo += [(a, middle), (middle, z)]
    return out


def _settle(k: int):
    def settle(h: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, twice: np.ndarray,
               packed: list[bytes]) -> list[np.ndarray | None]:
        flags: list[np.ndarray | None] = [None] * len(packed)
        order = np.lexsort((start, doc, h))
        cuts = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
        groups = [g.tolist() for g in np.split(order, cuts[1:])]
        plans = [(g, _halvings(len(g))) for g in groups if 1 < len(g) <= MOST_INDEXED]
        large = [i for g in groups if len(g) > MOST_INDEXED for i in g]
        for i, own in zip(large, _sort_all([packed[i] for i in large], n[large], k) if large else ()):
            flags[i] = own
        turn = 0
        while plans:
            earlier, later = [], []
            for g, halves in plans:
                a, middle, z = halves[turn]
                earlier += g[a:middle]
                later += g[middle:z]
            index = RunLengthIndex([packed[i] for i in earlier])
            parts = [(i, at) for i in later for at in range(0, int(n[i]), _STREAM_WINDOWS)]
            found = index.longest_matches([packed[i][at:at + _STREAM_WINDOWS + k - 1] for i, at in parts], k)
            for (i, at), lengths in zip(parts, found):
                hit = lengths[:len(lengths) - k + 1] >= k
                if hit.any():
                    if flags[i] is None:
                        flags[i] = np.zeros(int(n[i]), dtype=bool)
                    flags[i][at:at + len(hit)] |= hit
            turn += 1
            plans = [p for p in plans if turn < len(p[1])]
        for i in np.flatnonzero(twice).tolist():  # only these can repeat themselves
            own = _repeats_within(packed[i], k)
            flags[i] = own if flags[i] is None else flags[i] | own
        return flags

    return settle


def _sort_all(texts: list[bytes], n: np.ndarray, k: int) -> list[np.ndarray]:
    """Flags of the windows that equal an earlier one; the texts are in order of their places."""
    symbols = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64)
    size = n + k - 1
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(size) - size, n) + offset
    order, new = sorted_windows(symbols, at, k)
    least = np.minimum.reduceat(at[order], np.flatnonzero(new))
    flags = np.empty(len(at), dtype=bool)
    flags[order] = least[np.cumsum(new) - 1] < at[order]
    return np.split(flags, np.cumsum(n)[:-1])


def _repeats_within(text: bytes, k: int) -> np.ndarray:
    seen: set[bytes] = set()
    out = np.zeros(len(text) - k + 1, dtype=bool)
    for i in range(len(out)):
        w = text[i:i + k]
        out[i] = w in seen
        seen.add(w)
    return out


def _one_window(k: int):
    def window(packed: Column, i: Column) -> Column:
        return packed.substr((i + 1).cast("int"), F.lit(k))

    return window


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, piece: int = PIECE,
                   most_strings: int = MOST_STRINGS) -> DataFrame:
    """All rows and columns of ``docs`` plus a struct ``_repeats`` (n_bytes, n_removed, spans, kept).

    A byte of the UTF-8 text goes if a string of ``window`` bytes that covers it also starts earlier: in a document with
    a smaller key, or earlier in the same document; overlaps count. Strings are judged on the input. ``spans`` are the
    maximal removed ranges of bytes, ``kept`` (binary) the bytes left. NULL and empty texts have no bytes. A NULL key is
    larger than every other; rows with one key are laid over each other, position decides. Keys are whole numbers.
    """
    found = covered_windows(docs, _units(window, piece), _settle(window), _one_window(window), True, most_strings, key, text)

    @F.arrow_udf("struct<n_bytes:bigint, n_removed:bigint, spans:array<struct<a:bigint, z:bigint>>, kept:binary>")
    def apply(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for t, s in zip(texts.to_pylist(), spans.to_pylist()):
            gone = unit_spans(s, window)
            kept, at = [], 0
            for a, z in gone:
                kept.append(t[at:a])
                at = z
            left = b"".join([*kept, t[at:]])
            rows.append({"n_bytes": len(t), "n_removed": len(t) - len(left), "spans": [{"a": a, "z": z} for a, z in gone], "kept": left})
        span = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))
        return pa.array(rows, type=pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.binary())]))

    marked = with_spans(docs, found, key, text)
    return marked.withColumn("_repeats", apply(text_of(text).cast("binary"), F.col("__spans"))).drop("__spans")
