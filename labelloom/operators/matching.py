"""Literal substring matching of many terms in many texts.

Three exact strategies behind one call, chosen by the measured size of the term list:

* ``array``      few terms: a literal array and ``contains`` inside codegen, no Python
* ``automaton``  up to ``AUTOMATON_NODES`` characters of terms: one Aho-Corasick pass per text in an Arrow
                 function, independent of the number of terms; built once in each worker process
* ``join``       any size: each term is indexed by its rarest gram; texts look for these anchors, verify the windows around
                 them by bitmaps of bounded size, and what is left is equi-joined with the terms

None of them pairs every term with every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

ARRAY_TERMS = 24
#: terms of the ``array`` strategy at most: each is a node of the plan
MOST_ARRAY_TERMS = 500
#: an automaton has at most one node for each character of its terms, of about 40 bytes in each worker process
AUTOMATON_NODES = 2_000_000
MAX_BITMAP_BITS = 29  # 64 MB
#: sizes of anchors: a term's is the largest that it has room for
GRAMS = (1, 2, 3, 4, 6, 8)
#: counters of the grams' frequencies, and the pieces they are added up in
COUNTERS = 1 << 20
_PIECES = 32
#: bytes of texts that are looked at together (one text may be longer)
TEXT_BYTES = 1 << 20
#: pairs of a slot and a way that anchors have in it, at most
WAYS = 4_000_000


class TermList:
    """A deduplicated term column with its measured size."""

    def __init__(self, terms: DataFrame, col: str = "term"):
        self.frame = terms.select(F.col(col).alias("term")).filter(F.col("term") != "").distinct()
        size = self.frame.agg(
            F.count("*").alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("c")
        ).first()
        self.count, self.characters = size["n"], size["c"]

    def strategy(self) -> str:
        if self.count <= ARRAY_TERMS:
            return "array"
        return "automaton" if self.characters <= AUTOMATON_NODES else "join"

    def collect(self) -> list[str]:
        """The terms on the driver; only for lists that passed the size check."""
        if self.characters > AUTOMATON_NODES:
            raise ValueError(f"term list of {self.characters} characters is over the broadcast limit")
        return sorted(r["term"] for r in self.frame.collect())


    def literals(self) -> list[str]:
        """The terms for the ``array`` strategy."""
        if self.count > MOST_ARRAY_TERMS:
            raise ValueError(f"{self.count} terms are too many for the array strategy ({MOST_ARRAY_TERMS})")
        return self.collect()


def _automaton(shared):
    """The automaton of a broadcast term list, kept with it: later tasks of the same worker process find it there."""
    held = shared.value
    if held.get("automaton") is None:
        auto = ahocorasick.Automaton()
        for t in held["terms"]:
            auto.add_word(t, t)
        auto.make_automaton()
        held["automaton"] = auto
    return held["automaton"]


def _finder(spark, terms: list[str], first_only: bool):
    """Arrow function text -> distinct terms found (or just whether one was found)."""
    shared = spark.sparkContext.broadcast({"terms": terms, "automaton": None})

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        auto = _automaton(shared)
        for texts in batches:
            yield texts.map(
                lambda s: sorted({hit for _, hit in auto.iter(s)}) if isinstance(s, str) else []
            )

    def any_found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        auto = _automaton(shared)
        for texts in batches:
            yield texts.map(
                lambda s: isinstance(s, str) and next(auto.iter(s), None) is not None
            ).astype(bool)

    if first_only:
        return F.pandas_udf(any_found, T.BooleanType())
    return F.pandas_udf(found, T.ArrayType(T.StringType()))


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Hashed:
    """Hashes of any windows of a text, each in a few vector operations.

    With G[i] = sum of code[j] * B^j over j < i (modulo 2^64), a window's hash is (G[i+n] - G[i]) * B^-i, mixed with its
    length: the same wherever the window stands.
    """

    _BASE = 0x9E3779B97F4A7C15
    _up = _down = np.ones(1, dtype=np.uint64)

    def __init__(self, text: str):
        codes = _codes(text)
        self.n = len(codes)
        if len(Hashed._up) <= self.n:
            m = 2 * self.n + 1
            Hashed._up, Hashed._down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(m, x, dtype=np.uint64))])
                                        for x in (self._BASE, pow(self._BASE, -1, 1 << 64)))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * Hashed._up[:self.n], dtype=np.uint64)])

    def windows(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        h = (self.sums[start + size] - self.sums[start]) * Hashed._down[start] + np.asarray(size, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def grams(self, q: int) -> np.ndarray:
        """Of every place, in order."""
        return self.windows(np.arange(max(self.n - q + 1, 0)), q)


def _is_set(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    pos = h >> np.uint64(65 - (len(bitmap) * 8).bit_length())
    return ((bitmap[pos >> np.uint64(3)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _bitmap(values: DataFrame, n: int) -> np.ndarray:
    """The column ``h`` as a bitmap of 256 bits per value, ``MAX_BITMAP_BITS`` at most; then it only gets less selective."""
    bits = min(MAX_BITMAP_BITS, max(20, (256 * max(n, 1)).bit_length()))
    at = F.shiftrightunsigned("h", 64 - bits) + 1  # the bitmap functions count from 1
    pages = values.select(at.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bytes"))
    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for r in pages.toLocalIterator():
        page = np.frombuffer(r["bytes"], dtype=np.uint8)
        out[(r["page"] - 1) * len(page):r["page"] * len(page)] |= page
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts (the first column) have about ``TEXT_BYTES`` together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum(sizes) // TEXT_BYTES
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    for a, z in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
        yield batch.slice(a, z - a)


def _gram_counts(texts: DataFrame, col: str) -> np.ndarray:
    """How often grams occur, by ``COUNTERS`` counters that they are hashed into; collisions only make a gram seem frequent."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, dtype=np.int64)
        for batch in (some for whole in batches for some in _slices(whole)):
            # short texts go together: grams across their borders only seem a little more frequent
            h = Hashed("\n".join(s for s in batch.column(0).to_pylist() if s))
            for q in GRAMS:
                table += np.bincount((h.grams(q) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        pieces = np.split(table, _PIECES)
        yield pa.record_batch([pa.array(range(_PIECES), pa.int32()), pa.array([x.tobytes() for x in pieces], pa.binary())], names=["piece", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype=np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"piece": pa.array([table.column("piece")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = texts.select(F.col(col)).mapInArrow(count, "piece int, counts binary")
    rows = parts.groupBy("piece").applyInArrow(add, "piece int, counts binary").collect()
    return np.frombuffer(b"".join(r["counts"] for r in sorted(rows)) or bytes(8 * COUNTERS), dtype=np.int64)


class Anchors:
    """Where in a text a term may stand: each term is indexed by its rarest gram, its anchor.

    Rare means few occurrences in texts times few in terms. The index is of bounded size, whatever the number of terms: a
    bitmap of anchors; for each of at most 2^20 slots that anchors are hashed into the ways (place of the anchor in the
    term, term's size) that occur; and a bitmap of whole terms. A text looks for anchors first, then verifies the windows around
    them. A gram that every text has stays in the tasks that read the texts, so no group grows with it.
    """

    def __init__(self, terms: TermList, texts: DataFrame, text: str):
        spark = texts.sparkSession
        rarity = spark.sparkContext.broadcast(np.log1p(_gram_counts(texts, text)) + np.log1p(_gram_counts(terms.frame, "term")))

        @F.arrow_udf("struct<h:bigint, at:int, whole:bigint>")
        def anchor(column: pa.Array) -> pa.Array:
            hs, places, whole = [], [], []
            for t in column.to_pylist():
                x = Hashed(t)
                grams = x.grams(max(q for q in GRAMS if q <= x.n))
                i = int(np.argmin(rarity.value[(grams % np.uint64(COUNTERS)).astype(np.int64)]))
                hs.append(grams[i])
                places.append(i)
                whole.append(x.windows(np.zeros(1, np.int64), x.n)[0])
            return pa.StructArray.from_arrays([pa.array(np.array(hs, np.uint64).view(np.int64)), pa.array(places, pa.int32()),
                                               pa.array(np.array(whole, np.uint64).view(np.int64))], names=["h", "at", "whole"])

        # few bytes, but work for many tasks: adaptive execution would put them into one
        dealt = terms.frame.repartition(min(-(-max(terms.count, 1) // 1000), 1000))
        sized = dealt.select(anchor("term").alias("_a"), F.length("term").alias("size")).select("_a.*", "size").persist()
        ways = sorted(tuple(r) for r in sized.select("at", "size").distinct().collect())
        slots = 20
        while slots > 8 and len(ways) << slots > WAYS < terms.count:
            slots -= 1
        number = spark.createDataFrame([(a, n, i) for i, (a, n) in enumerate(ways)], "at int, size int, way int")
        pairs = sized.join(F.broadcast(number), ["at", "size"]).select(
            F.shiftrightunsigned("h", 64 - slots).cast("int").alias("slot"), "way").distinct().collect()
        pairs = np.array(sorted(tuple(r) for r in pairs), dtype=np.int64).reshape(-1, 2)
        start = np.searchsorted(pairs[:, 0], np.arange((1 << slots) + 1))
        self.index = (_bitmap(sized, terms.count), _bitmap(sized.select(F.col("whole").alias("h")), terms.count), slots, start,
                      pairs[:, 1], np.array(ways, dtype=np.int64).reshape(-1, 2),
                      sorted({max(q for q in GRAMS if q <= n) for _, n in ways}))
        sized.unpersist()

    @staticmethod
    def windows(index: tuple, s: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and size of the text's distinct windows that may be terms."""
        grams, terms, slots, start, way, ways, sizes = index
        x, h, at = Hashed(s), [], []
        for q in sizes:
            g = x.grams(q)
            hit = np.flatnonzero(_is_set(grams, g))
            h.append(g[hit])
            at.append(hit)
        h, at = np.concatenate(h or [np.empty(0, np.uint64)]), np.concatenate(at or [np.empty(0, np.int64)])
        slot = (h >> np.uint64(64 - slots)).astype(np.int64)
        n = start[slot + 1] - start[slot]
        which = way[np.repeat(start[slot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        first, size = np.repeat(at, n) - ways[which, 0], ways[which, 1]
        fits = np.flatnonzero((first >= 0) & (first + size <= x.n))
        first, size = first[fits], size[fits]
        w = x.windows(first, size)
        known = np.flatnonzero(_is_set(terms, w))
        w, one = np.unique(w[known], return_index=True)
        return w, first[known][one], size[known][one]

    def hits(self, texts: DataFrame, text: str) -> DataFrame:
        """``texts`` without the text, plus ``term``: one row per row and distinct substring that may be a term."""
        shared = texts.sparkSession.sparkContext.broadcast(self.index)

        @F.arrow_udf("array<string>")
        def found(column: pa.Array) -> pa.Array:
            out = []
            for s in column.to_pylist():
                _, first, size = self_windows(shared.value, s or "")
                out.append([s[a:z] for a, z in zip(first.tolist(), (first + size).tolist())])
            return pa.array(out, pa.list_(pa.string()))

        self_windows = Anchors.windows
        return texts.select(*(c for c in texts.columns if c != text), F.explode(found(F.col(text))).alias("term"))

    def counts(self, texts: DataFrame, text: str, by: list[str]) -> DataFrame:
        """``term, *by, hits`` of substrings that may be terms, added up inside each run of texts; a term may have several rows.

        A task holds the windows of ``TEXT_BYTES`` of texts, whatever the size of its batches; equal terms of its runs meet in the
        partial aggregate behind it, before anything is shuffled.
        """
        shared = texts.sparkSession.sparkContext.broadcast(self.index)
        windows = Anchors.windows
        schema = T.StructType([T.StructField("term", T.StringType()), *(texts.schema[c] for c in by), T.StructField("hits", T.LongType())])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (some for whole in batches for some in _slices(whole)):
                groups: dict[tuple, list[int]] = {}
                for i, k in enumerate(zip(*(batch.column(j).to_pylist() for j in range(1, 1 + len(by)))) if by else [()] * batch.num_rows):
                    groups.setdefault(k, []).append(i)
                texts = batch.column(0).to_pylist()
                for rows in groups.values():
                    parts = [windows(shared.value, texts[i] or "") for i in rows]
                    owner = np.repeat(rows, [len(p[0]) for p in parts])
                    w, first, size = (np.concatenate([p[j] for p in parts]) for j in range(3))
                    _, one, n = np.unique(w, return_index=True, return_counts=True)
                    terms = [texts[o][a:z] for o, a, z in zip(owner[one].tolist(), first[one].tolist(), (first + size)[one].tolist())]
                    same = [batch.column(j).take(pa.array([rows[0]] * len(one), pa.int64())) for j in range(1, 1 + len(by))]
                    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *same, pa.array(n)], names=["term", *by, "hits"])

        return texts.select(F.col(text), *by).mapInArrow(count, schema)


def matched_terms(texts: DataFrame, text: str, terms: DataFrame | TermList, term: str = "term",
                  strategy: str = "auto", key: list[str] | None = None) -> DataFrame:
    """One row per (text row, distinct term found in it): columns ``key`` plus ``term``.

    ``key`` defaults to every column but the text, so texts are not carried along with the pairs.
    """
    terms = terms if isinstance(terms, TermList) else TermList(terms, term)
    strategy = terms.strategy() if strategy == "auto" else strategy
    key = [c for c in texts.columns if c != text] if key is None else key
    texts = texts.select(*key, F.col(text).alias("_text"))
    if strategy == "array":
        literal = F.array(*[F.lit(t) for t in terms.literals()]).cast("array<string>")
        hits = F.filter(literal, lambda t: F.contains(F.col("_text"), t))
        return texts.select(*key, F.explode(hits).alias("term"))
    if strategy == "automaton":
        found = _finder(texts.sparkSession, terms.collect(), first_only=False)
        return texts.select(*key, F.explode(found("_text")).alias("term"))
    if strategy == "join":
        return Anchors(terms, texts, "_text").hits(texts, "_text").join(terms.frame, "term").select(*key, "term")
    raise ValueError(f"unknown strategy: {strategy}")


def flag_any_term(texts: DataFrame, text: str, terms: DataFrame | TermList, row_key: str,
                  term: str = "term", strategy: str = "auto", name: str = "hit") -> DataFrame:
    """Add a 0/1 column: does the text contain at least one term?

    ``row_key`` identifies a row; only the ``join`` strategy uses it.
    """
    terms = terms if isinstance(terms, TermList) else TermList(terms, term)
    strategy = terms.strategy() if strategy == "auto" else strategy
    if strategy == "array":
        hit = F.lit(False)
        for t in terms.literals():
            hit = hit | F.contains(F.col(text), F.lit(t))
        return texts.withColumn(name, F.coalesce(hit, F.lit(False)).cast("int"))
    if strategy == "automaton":
        found = _finder(texts.sparkSession, terms.collect(), first_only=True)
        return texts.withColumn(name, found(F.col(text)).cast("int"))
    hits = matched_terms(texts, text, terms, strategy="join", key=[row_key]).select(row_key).distinct()
    return texts.join(hits.withColumn("_hit", F.lit(1)), row_key, "left").withColumn(
        name, F.coalesce("_hit", F.lit(0))
    ).drop("_hit")


def term_hit_counts(texts: DataFrame, text: str, terms: DataFrame | TermList, term: str = "term",
                    by: list[str] | None = None, strategy: str = "auto") -> DataFrame:
    """``term, *by, hits``: number of text rows containing each term (terms without hits are absent).

    In the ``join`` strategy hits are counted inside each run of texts, so a term that occurs in a third of all texts is one
    row per run by then.
    """
    terms = terms if isinstance(terms, TermList) else TermList(terms, term)
    strategy = terms.strategy() if strategy == "auto" else strategy
    by = by or []
    if strategy == "join":
        counted = Anchors(terms, texts, text).counts(texts, text, by).groupBy("term", *by).agg(F.sum("hits").alias("hits"))
        return counted.join(terms.frame, "term").select("term", *by, "hits")
    pairs = matched_terms(texts.select(*by, text), text, terms, strategy=strategy, key=by)
    return pairs.groupBy("term", *by).agg(F.count("*").alias("hits"))
