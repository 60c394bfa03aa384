"""Benchmark passages in training texts by a positional inverted index.

The index is cut by documents: every scan task turns its documents into segments of a bounded number of tokens, and a
segment stores, for each benchmark term, the sorted list of its token positions. Segments are written to the shared
folder, so the search may be repeated with other settings, and a lost task rebuilds its own segments only. A search
takes the benchmark's windows to every segment: lists are intersected from the window's rarest term on, each shifted by
the term's offset in the window, and a window whose rarest term does not occur costs one look-up. Positions leave a gap
between documents, so no match crosses one. What is sent around is the benchmark, in blocks of a stated size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .base import staged, text_of

WINDOW = 10
#: a proximity match needs all distinct terms of a window within so many tokens
NEAR_SPAN = 2 * WINDOW
#: tokens and documents of a segment together (one document may be longer)
SEGMENT_TOKENS = 2_000_000
#: bytes of benchmark text that are sent to the tasks at once; a larger benchmark is searched in blocks
BLOCK_BYTES = 1 << 20

# Fixed rule: words are runs of digits, letters and characters beyond ASCII; A-Z are lower-cased.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_INDEX = ("segment string, doc_ids array<bigint>, digests array<bigint>, first_positions array<bigint>, n_words array<bigint>, terms array<string>, "
          "list_ends array<bigint>, positions array<bigint>")
_INDEX_TYPE = pa.schema([("segment", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("digests", pa.list_(pa.int64())),
                         ("first_positions", pa.list_(pa.int64())),
                         ("n_words", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())),
                         ("list_ends", pa.list_(pa.int64())), ("positions", pa.list_(pa.int64()))])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def _index(docs: DataFrame, key: str, text: str, vocabulary: Sequence[bytes]) -> DataFrame:
    """One row per segment: its documents, and for each benchmark term that occurs its positions, term after term."""
    number = {w: i for i, w in enumerate(vocabulary)}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids: list = []
        digests: list[int] = []
        sizes: list[int] = []
        numbers: list[np.ndarray] = []
        tokens = 0

        def segment() -> pa.RecordBatch:
            nonlocal made, tokens
            n = np.array(sizes, dtype=np.int64)
            first = np.concatenate(([0], np.cumsum(n + 1)[:-1])) if len(n) else n
            flat = np.concatenate(numbers) if numbers else np.empty(0, np.int32)
            at = np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)  # one unused position after each document
            known = np.flatnonzero(flat >= 0)
            order = known[np.argsort(flat[known], kind="stable")]
            which, counts = np.unique(flat[order], return_counts=True)
            row = [f"{task}-{made}", ids.copy(), digests.copy(), first.tolist(), sizes.copy(), [vocabulary[i].decode() for i in which.tolist()],
                   np.cumsum(counts).tolist(), at[order]]
            made += 1
            tokens = 0
            ids.clear(), digests.clear(), sizes.clear(), numbers.clear()
            return pa.record_batch([pa.array([x], type=f.type) for x, f in zip(row, _INDEX_TYPE)], schema=_INDEX_TYPE)

        for batch in batches:
            for ident, t, digest in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(t)
                ids.append(ident)
                digests.append(digest)
                sizes.append(len(words))
                numbers.append(np.fromiter(map(number.get, words, repeat(-1)), dtype=np.int32, count=len(words)))
                tokens += len(words)
                if tokens + len(ids) >= SEGMENT_TOKENS:
                    yield segment()
        if ids:
            yield segment()

    return docs.select(F.col(key).cast("bigint"), text_of(text), F.xxhash64(text_of(text))).mapInArrow(build, _INDEX)


class _Windows:
    """The benchmark's windows as rows of term numbers, shared by equal windows of several items."""

    def __init__(self, items: Sequence[tuple], window: int):
        self.items_of: dict[tuple[bytes, ...], set] = {}
        for item, text in items:
            words = words_of(text)
            size = min(window, len(words))
            for i in range(len(words) - size + 1) if words else ():
                self.items_of.setdefault(tuple(words[i:i + size]), set()).add(item)
        self.vocabulary = sorted({w for words in self.items_of for w in words})

    def search(self, lists: dict[bytes, np.ndarray], near_span: int, first: np.ndarray) -> tuple[list, list]:
        """(window, its start positions) of exact matches; (window, (start, end)) of proximity matches."""
        exact, near = [], []
        none = np.empty(0, np.int64)
        for words in self.items_of:
            by_rarity = sorted(range(len(words)), key=lambda i: len(lists.get(words[i], none)))
            rarest = lists.get(words[by_rarity[0]])
            if rarest is None:
                continue
            starts = rarest - by_rarity[0]
            for i in by_rarity[1:]:
                if not len(starts):
                    break
                starts = _present(starts, lists[words[i]] - i)
            if len(starts):
                exact.append((words, starts))
            if near_span:
                near += [(words, span) for span in _close_together(words, by_rarity, lists, near_span, first)]
        return exact, near


def _present(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Those of the sorted ``values`` that the sorted ``among`` holds."""
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return values[among[at] == values]


def _close_together(words: tuple[bytes, ...], by_rarity: list[int], lists: dict, span: int, first: np.ndarray) -> list[tuple[int, int]]:
    """Around each occurrence of a document's rarest term: the smallest span of the document that holds every term, if within ``span``.

    ``first``: the documents' first positions. Of equally rare terms the window's first counts, of equal spans the first:
    what a document gives depends on no other.
    """
    terms = list(dict.fromkeys(words))
    if any(t not in lists for t in terms):
        return []
    finish = np.append(first[1:], np.iinfo(np.int64).max)
    docs = np.unique(np.searchsorted(first, lists[words[by_rarity[0]]], "right") - 1)
    inside = [(np.searchsorted(lists[t], first[docs]), np.searchsorted(lists[t], finish[docs])) for t in terms]
    counts = np.stack([z - a for a, z in inside])
    rarest = np.where((counts > 0).all(axis=0), counts.argmin(axis=0), -1)
    out: dict[tuple[int, int], None] = {}
    for r in np.unique(rarest[rarest >= 0]).tolist():
        of = np.flatnonzero(rarest == r)
        hits = np.concatenate([lists[terms[r]][a:z] for a, z in zip(inside[r][0][of].tolist(), inside[r][1][of].tolist())])
        document = np.repeat(docs[of], counts[r][of])
        low, high = np.maximum(first[document], hits - span + 1), np.minimum(finish[document], hits + span)
        around = {n: (np.searchsorted(lists[t], low), np.searchsorted(lists[t], high)) for n, t in enumerate(terms) if n != r}
        whole = np.ones(len(hits), bool)
        for a, z in around.values():
            whole &= z > a
        for i in np.flatnonzero(whole).tolist():
            near = [(int(hits[i]), r)] + [(x, n) for n, (a, z) in around.items() for x in lists[terms[n]][a[i]:z[i]].tolist()]
            best = _smallest(sorted(near), len(terms))
            if best and best[1] - best[0] < span:
                out[best[0], best[1] + 1] = None
    return list(out)


def _smallest(positions: list[tuple[int, int]], n_terms: int) -> tuple[int, int] | None:
    """First and last position of the smallest span that holds all terms; (position, term) sorted."""
    best, held, missing, left = None, [0] * n_terms, n_terms, 0
    for x, n in positions:
        missing -= not held[n]
        held[n] += 1
        while not missing:
            a, m = positions[left]
            if best is None or x - a < best[1] - best[0]:
                best = (a, x)
            held[m] -= 1
            missing += not held[m]
            left += 1
    return best


def _union_length(spans: np.ndarray, document: np.ndarray, n_documents: int) -> np.ndarray:
    """Tokens inside at least one of the (start, end) spans, per document. Spans are sorted by start."""
    start, end = spans[:, 0], spans[:, 1]
    covered = np.maximum.accumulate(end)
    fresh = np.maximum(end - np.maximum(start, np.concatenate(([start[0]], covered[:-1]))), 0)
    return np.bincount(document, weights=fresh, minlength=n_documents).astype(np.int64)


_MATCH = "struct<item_id:bigint, kind:string, start:bigint, end:bigint>"
_FOUND = f"row string, doc_id bigint, digest bigint, n_words bigint, n_hit bigint, items array<bigint>, matches array<{_MATCH}>"
_FOUND_TYPE = pa.schema([
    ("row", pa.string()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())),
    ("matches", pa.list_(pa.struct([("item_id", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])


def _search(index: DataFrame, windows: _Windows, near_span: int) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = [c.slice(i, 1).flatten() for c in batch.columns[1:]]
                ids, digests, first, n_words, terms, ends, positions = (
                    p.to_pylist() if j in (0, 4) else p.to_numpy(zero_copy_only=False) for j, p in enumerate(part))
                begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
                lists = {t.encode(): positions[a:z] for t, a, z in zip(terms, begins.tolist(), ends.tolist())}
                exact, near = windows.search(lists, near_span, first)
                matches: list[list] = [[] for _ in ids]
                items: list[set] = [set() for _ in ids]
                spans: list[np.ndarray] = []
                for words, starts in exact:
                    spans.append(np.stack([starts, starts + len(words)], axis=1))
                    for d, s in zip((np.searchsorted(first, starts, "right") - 1).tolist(), starts.tolist()):
                        items[d] |= windows.items_of[words]
                        s -= int(first[d])
                        matches[d] += [(x, "phrase", s, s + len(words)) for x in windows.items_of[words]]
                for words, (a, z) in near:
                    d = int(np.searchsorted(first, a, "right")) - 1
                    a, z = a - int(first[d]), z - int(first[d])
                    matches[d] += [(x, "proximity", a, z) for x in windows.items_of[words]]
                hit = np.zeros(len(ids), np.int64)
                if spans:
                    flat = np.concatenate(spans)
                    flat = flat[np.lexsort((flat[:, 1], flat[:, 0]))]
                    hit = _union_length(flat, np.searchsorted(first, flat[:, 0], "right") - 1, len(ids))
                kinds = [[dict(zip(("item_id", "kind", "start", "end"), m)) for m in sorted(set(ms))] for ms in matches]
                names = [f"{batch.column('segment')[i]}:{d}" for d in range(len(ids))]
                yield pa.record_batch([pa.array(names, pa.string()), pa.array(ids, pa.int64()), pa.array(digests, pa.int64()), pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()),
                                       pa.array([sorted(x) for x in items], _FOUND_TYPE.field(5).type),
                                       pa.array(kinds, _FOUND_TYPE.field(6).type)], schema=_FOUND_TYPE)

    return index.mapInArrow(search, _FOUND)


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple]]:
    """The benchmark's items, at most ``BLOCK_BYTES`` of text at a time on the driver (one item may be longer)."""
    rows = benchmark.select(F.col(item).cast("bigint"), text_of(text)).filter(F.col(item).isNotNull())
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1].encode("utf-8", "surrogatepass"))
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, near_span: int = NEAR_SPAN) -> DataFrame:
    """(doc_id, digest, n_words, n_hit, items, matches), one row per row of ``docs``; ``digest`` is xxhash64 of the text.

    A window is ``window`` consecutive item words; an item of fewer words, but not none, is one window. ``n_hit`` counts the
    words inside any exact occurrence, ``items`` are the items with an occurring window, ``matches`` lists phrase and
    proximity matches as (item_id, kind, start, end) in words, end exclusive. NULL and empty texts have no words; items
    without an id or words are never found; an empty benchmark finds nothing; equal documents get equal results. Ids are
    whole numbers. A benchmark beyond ``BLOCK_BYTES`` is searched block by block and the blocks' findings are merged.
    """
    results = []
    for block in _blocks(benchmark, item, item_text):
        windows = _Windows(block, window)
        index = staged(_index(docs, key, text, windows.vocabulary))
        results.append(_search(index, windows, near_span))
    found = results[0] if len(results) == 1 else _merged(results)
    return found.drop("row")


def _merged(results: list[DataFrame]) -> DataFrame:
    """Findings of several blocks: segments depend on the documents alone, so a row has one name in all blocks."""
    every = results[0]
    for r in results[1:]:
        every = every.unionByName(r)
    spans = F.array_sort(F.transform(F.filter(F.flatten(F.collect_list("matches")), lambda m: m["kind"] == "phrase"),
                                     lambda m: F.struct(m["start"].alias("a"), m["end"].alias("z"))))
    at = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("until"))
    covered = F.aggregate(spans, at, lambda s, x: F.struct(
        (s["n"] + F.greatest(x["z"] - F.greatest(x["a"], s["until"]), F.lit(0))).alias("n"),
        F.greatest(s["until"], x["z"]).alias("until")), lambda s: s["n"])
    return every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("digest").alias("digest"), F.first("n_words").alias("n_words"), covered.alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without an exact benchmark passage, with the columns they came with."""
    found = contamination(docs, benchmark, key, text, **options).filter("n_hit > 0")
    found = found.select(F.col("doc_id").alias("__key"), F.col("digest").alias("__other")).distinct()
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__digest") == F.col("__other"))
    return (docs.withColumn("__digest", F.xxhash64(text_of(text))).join(found, same, "left_anti")
            .select(*(F.col(f"`{c}`") for c in docs.columns)))
