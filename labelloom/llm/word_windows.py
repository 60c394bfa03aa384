"""Repeated passages of whole words across documents, by super-k-mers of words."""

from __future__ import annotations

from collections.abc import Iterator
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .base import text_of
from .superkmers import Units, covered_windows, mixed, sorted_windows, unit_spans, with_spans

WINDOW = 50
PIECE = 8
#: words of the texts that are looked at together (one text may be longer)
_CHUNK_WORDS = 200_000
#: distinct strings of one minimiser that are compared in a bucket; with more, windows are aggregated
MOST_STRINGS = 1_000
#: strings of a bucket, about
BUCKET_STRINGS = 4_000

_U = np.uint64


def _pieces(words: list[bytes], m: int) -> np.ndarray:
    """Hash of the m words at each position (short texts at the end give none)."""
    h = mixed(np.fromiter(map(zlib.crc32, words), dtype=_U, count=len(words)) * _U(0x9E3779B97F4A7C15))
    n = max(len(words) - m + 1, 0)
    out = np.zeros(n, dtype=_U)
    for j in range(m):
        out = out * _U(0xD1342543DE82EF95) + h[j:j + n]
    return mixed(out)


def _units(k: int, m: int) -> Units:
    def chunks(texts: pa.Array) -> Iterator[tuple]:
        first, sizes, flat = 0, [], []

        def chunk() -> tuple:
            held = flat
            return first, np.array(sizes, dtype=np.int64), _pieces(held, m), lambda a, z: b" ".join(held[a:z])

        for row, t in enumerate(texts):
            words = t.as_py().split()
            sizes.append(len(words))
            flat += words
            if len(flat) >= _CHUNK_WORDS:
                yield chunk()
                first, sizes, flat = row + 1, [], []
        if flat:
            yield chunk()

    return Units(k, m, BUCKET_STRINGS, chunks)


def _settle(k: int):
    """Flags of the windows that start in a string of a smaller document, by sorting all windows of a bucket."""
    def settle(h: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, twice: np.ndarray,
               packed: list[bytes]) -> list[np.ndarray]:
        words = [p.split(b" ") for p in packed]
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), dtype=np.int64)
        size = np.array([len(w) for w in words])
        at = np.repeat(np.cumsum(size) - size, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owner = np.repeat(doc, n)
        order, new = sorted_windows(ids, at, k)
        least = np.minimum.reduceat(owner[order], np.flatnonzero(new))
        flags = np.empty(len(at), dtype=bool)
        flags[order] = least[np.cumsum(new) - 1] < owner[order]
        return np.split(flags, np.cumsum(n)[:-1])

    return settle


def _one_window(k: int):
    def window(packed: Column, i: Column) -> Column:
        return F.array_join(F.slice(F.split(packed.cast("string"), " "), (i + 1).cast("int"), k), " ")

    return window


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, piece: int = PIECE,
                   most_strings: int = MOST_STRINGS) -> DataFrame:
    """All rows and columns of ``docs`` plus a struct ``_repeats`` (n_words, n_removed, spans, kept).

    A word goes if a window of ``window`` consecutive words that covers it also starts in a document with a smaller key.
    Windows are judged on the input. Words are separated by ASCII white space and otherwise unchanged; ``kept`` joins those
    left by one space, ``spans`` are the removed ranges of words. NULL and empty texts have no words. A NULL key is larger
    than every other; rows that share a key never remove from each other. Keys are whole numbers.
    """
    found = covered_windows(docs, _units(window, piece), _settle(window), _one_window(window), False, most_strings, key, text)

    @F.arrow_udf("struct<n_words:bigint, n_removed:bigint, spans:array<struct<a:bigint, z:bigint>>, kept:string>")
    def apply(texts: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for t, s in zip(texts.to_pylist(), spans.to_pylist()):
            words = t.encode("utf-8", "surrogatepass").split()
            gone = unit_spans(s, window)
            kept, at = [], 0
            for a, z in gone:
                kept += words[at:a]
                at = z
            kept += words[at:]
            rows.append({"n_words": len(words), "n_removed": len(words) - len(kept), "spans": [{"a": a, "z": z} for a, z in gone],
                         "kept": b" ".join(kept).decode("utf-8", "surrogatepass")})
        span = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))
        return pa.array(rows, type=pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.string())]))

    marked = with_spans(docs, found, key, text)
    return marked.withColumn("_repeats", apply(text_of(text), F.col("__spans"))).drop("__spans")
