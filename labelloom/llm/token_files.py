"""Token ids in files that many tasks can decode at once.

``write_tokens`` encodes texts, counts all ids for one frequency table, orders the documents by key over the whole table and has
every partition write one file of independently coded blocks (``rans``). ``read_tokens`` decodes units of consecutive documents, in any
number of tasks, each from the checkpoint at or before its first id; checksums of all coded segments are compared.

A dataset is a folder with ``table`` (the frequencies), ``data/*.rans`` and ``manifest`` (Parquet, one row per unit). Only
files that the manifest names belong to it: what lost or repeated tasks have left is never read.

A file: ``MAGIC``; blocks, each its checkpoints' states (uint64), their places in the stream (int64) and the stream
(uint32); the index: keys (int64), whether they are NULL (uint8), ids per document (int64), then offset, ids and words per block
(int64) and the CRC-32 of the ids between checkpoints (uint32); last the sizes of all that. Numbers are little-endian.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
import re
import string
import struct
import sys
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc, fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import rans
from .base import pieces, shared_folder, staged, text_of

MAGIC = b"LLTOKEN1"
#: ids of a file, about, and of a unit of decoding
SHARD_IDS = 1 << 24
UNIT_IDS = 1 << 22
#: bytes of text that are cut into words at once, and (twice) of the words that a worker remembers
CHUNK = 1 << 23
REMEMBERED = 130_000_000
_END = "<QQQQQI8s"  # start of the index, documents, blocks, segments, ids, CRC-32 of the index


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", path) if re.match(r"[a-z][a-z0-9+.-]+:", path) else f"file://{path}")


def _write(path: str, content: Callable | bytes) -> None:
    """A file appears whole under its name or not at all."""
    store, name = _open(path)
    if isinstance(store, fs.LocalFileSystem):
        store.create_dir(name.rpartition("/")[0])
    with store.open_output_stream(f"{name}.part") as f:
        content(f) if callable(content) else f.write(content)
    store.move(f"{name}.part", name)


@dataclass(frozen=True)
class Words:
    """What is known of a tokenizer that drops ASCII white space and never joins what it parts: its words can be encoded on
    their own, and remembered. ``plain``: (a pattern) lower-case words that it takes as one piece, unchanged but for upper
    case; ``points``: characters of which any number make one piece, alone or after such a word."""

    plain: str
    points: str


#: lower-case letters of Latin-1 are single code points in every normal form
LATIN_WORDS = Words("[a-z\u00df-\u00f6\u00f8-\u00ff]+", string.punctuation)


def _letters_of_bytes() -> dict[int, str]:
    """The letters that byte-level tokenizers write bytes with: printable ones are themselves, others follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder:
    """Texts to ids. With ``words`` each worker process remembers the ids of words it has met lately."""

    def __init__(self, model: str, words: Words | None, end: int | None):
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_str(model), words
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = b"" if end is None else np.array([end], self.kind).tobytes()
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.size = 0
        if words:
            self.plain = re.compile(f"({words.plain})?([{re.escape(words.points)}]*)")
            self.letters = str.maketrans({chr(b): c for b, c in _letters_of_bytes().items()})

    def _bytes(self, ids: list[int]) -> bytes:
        out = array("H" if self.kind.itemsize == 2 else "I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [self._bytes(e.ids) for e in got]

    def _piece(self, piece: str) -> bytes:
        """Of one piece of the tokenizer's: only its model has work to do."""
        key = piece.encode()
        ids = self.known.get(key)
        if ids is None:
            letters = piece if piece.isascii() else key.decode("latin-1").translate(self.letters)
            ids = self.known[key] = self._bytes([t.id for t in self.model.tokenize(letters)])
            self.size += 200 + 2 * len(key)
        return ids

    def _words(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words."""
        if self.size > REMEMBERED:  # words of late stay
            self.before, self.known, self.size = self.known, {}, 0
        known, odd = self.known, []
        for w in words:
            if w in known:
                continue
            ids = self.before.get(w)
            if ids is None:
                match = self.plain.fullmatch(w.decode("utf-8", "replace").lower())
                if not match:
                    odd.append(w)
                    continue
                ids = b"".join(self._piece(x) for x in match.groups() if x)
            known[w] = ids
            self.size += 200 + 2 * len(w)
        known.update(zip(odd, self._encode(odd)))
        self.size += 200 * len(odd) + 2 * sum(map(len, odd))
        return list(map(known.__getitem__, words))

    def _by_word(self, texts: list[bytes]) -> list[bytes]:
        column = pa.array(texts, pa.binary())
        words = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(column), column.buffers()))
        coded = words.flatten().dictionary_encode()
        different = self._words(coded.dictionary.cast(pa.binary()).to_pylist())
        sizes = np.fromiter(map(len, different), np.int64, len(different))
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()),
                                       pa.Array.from_buffers(pa.uint8(), int(sizes.sum()), [None, pa.py_buffer(b"".join(different))]))
        taken = ids.take(coded.indices)
        whole = taken.flatten().to_numpy().tobytes()
        at = np.concatenate(([0], np.cumsum(sizes[coded.indices.to_numpy()])))[words.offsets.to_numpy()].tolist()
        return [whole[a:z] for a, z in zip(at, at[1:])]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if self.words is None:
            return [x + self.end for x in self._encode(texts)]
        out: list[bytes] = []
        some: list[bytes] = []
        size = 0
        for t in texts:
            if size + len(t) > CHUNK and some:
                out += self._by_word(some)
                some, size = [], 0
            if len(t) > CHUNK:
                out.append(b"".join(self._by_word([p])[0] for p in pieces(t, CHUNK)))
            else:
                some.append(t)
                size += len(t)
        if some:
            out += self._by_word(some)
        return [x + self.end for x in out]


def _encoder(model: str, words: Words | None, end: int | None) -> Encoder:
    """One for each worker process, whatever the number of its tasks; functions that travel by value keep no globals."""
    kept = sys.__dict__.setdefault("_token_encoders", {})
    name = (hash(model), words, end)
    if name not in kept:
        kept[name] = Encoder(model, words, end)
    return kept[name]


def encoded(docs: DataFrame, tokenizer: str, end: int | None, words: Words | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key (bigint), tie (orders equal keys), ids (binary), n: one row per row of ``docs``."""
    with open(tokenizer, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(model.value, words, end)
        for batch in batches:
            ids = e(batch.column(2).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.binary()),
                                   pa.array([len(x) // e.kind.itemsize for x in ids], pa.int64())], names=["key", "tie", "ids", "n"])

    whole = text_of(text)
    d = docs.select(F.col(key).cast("bigint").alias("key"), F.xxhash64(whole).alias("tie"), whole.cast("binary").alias("_bytes"))
    return d.mapInArrow(run, "key bigint, tie bigint, ids binary, n bigint")


def _frequencies(rows: DataFrame, kind: np.dtype, size: int) -> tuple[np.ndarray, int]:
    """The shared table, and how many ids there are. At most one row for each id of the vocabulary comes to the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used])], names=["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in rows.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return rans.frequencies(counts), int(counts.sum())


_UNIT = pa.schema([("path", pa.string()), *((n, pa.int64()) for n in ("shard", "first_doc", "docs", "first_id", "ids", "first_key", "last_key"))])
_UNIT_DDL = "path string, shard bigint, first_doc bigint, docs bigint, first_id bigint, ids bigint, first_key bigint, last_key bigint"


class _File:
    """One file being written: blocks as they fill up, then the index."""

    def __init__(self, out, table: rans.Table, kind: np.dtype):
        self.out, self.table, self.kind = out, table, kind
        self.parts: list[bytes] = []
        self.waiting = self.at = self.ids = 0
        self.keys: list[int | None] = []
        self.sizes: list[int] = []
        self.blocks: list[tuple[int, int, int]] = []
        self.sums: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, keys: list, sizes: list[int], ids: list[bytes]) -> None:
        self.keys += keys
        self.sizes += sizes
        for x in ids:
            self.parts.append(x)
            self.waiting += len(x) // self.kind.itemsize
            if self.waiting >= rans.BLOCK:
                self._blocks(rans.BLOCK)

    def _blocks(self, least: int) -> None:
        held = np.frombuffer(b"".join(self.parts), self.kind)
        while len(held) and len(held) >= least:
            ids, held = held[:rans.BLOCK], held[rans.BLOCK:]
            b = rans.encode(ids, self.table)
            self.blocks.append((self.at, b.n, len(b.words)))
            self.sums += [zlib.crc32(ids[i:i + rans.CHECKPOINT].astype("<u4").tobytes()) for i in range(0, len(ids), rans.CHECKPOINT)]
            self._put(b.states.astype("<u8").tobytes() + b.at.astype("<i8").tobytes() + b.words.astype("<u4").tobytes())
            self.ids += b.n
        self.parts, self.waiting = [held.tobytes()], len(held)

    def close(self) -> None:
        self._blocks(1)
        null = np.array([k is None for k in self.keys], "<u1")
        index = b"".join((np.array([k or 0 for k in self.keys], "<i8").tobytes(), null.tobytes(), np.array(self.sizes, "<i8").tobytes(),
                          np.array(self.blocks, "<i8").reshape(-1, 3).tobytes(), np.array(self.sums, "<u4").tobytes()))
        start = self.at
        self._put(index)
        self._put(struct.pack(_END, start, len(self.keys), len(self.blocks), len(self.sums), self.ids, zlib.crc32(index), MAGIC))

    def units(self, path: str, shard: int) -> pa.RecordBatch:
        ends = np.cumsum(np.array(self.sizes, np.int64))
        # a unit begins where the ids before a document pass a multiple of UNIT_IDS
        number = (ends - self.sizes) // UNIT_IDS
        first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        last = np.append(first[1:], len(ends))
        start = ends[first] - np.array(self.sizes, np.int64)[first]
        rows = [[path] * len(first), [shard] * len(first), first.tolist(), (last - first).tolist(), start.tolist(),
                (ends[last - 1] - start).tolist(), [self.keys[i] for i in first], [self.keys[i - 1] for i in last]]
        return pa.record_batch([pa.array(x, f.type) for x, f in zip(rows, _UNIT)], schema=_UNIT)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end: int | None = None, words: Words | None = None,
                 key: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> str:
    """Encode the texts with the tokenizer file (no special tokens; ``end`` is appended to each text) and write a dataset; its folder.

    Documents ascend by key (a whole number): NULL keys come last, equal ones are ordered by a hash of their text. A NULL text is empty. Empty
    texts, repeated rows and empty tables are written like any others; other columns are ignored. ``words``: see ``Words``.
    Without ``folder`` the dataset gets a new one in the shared folder.
    """
    spark = docs.sparkSession
    folder = (folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}").rstrip("/")
    with open(tokenizer, encoding="utf-8") as f:
        e = Encoder(f.read(), words, end)
    kind, size = e.kind, max(e.tokenizer.get_vocab_size(), (end or 0) + 1)
    rows = staged(encoded(docs, tokenizer, end, words, key, text))
    frequency, total = _frequencies(rows, kind, size)
    _write(f"{folder}/table", frequency.astype("<u4").tobytes())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        shard = TaskContext.get().partitionId()
        path, made = f"{folder}/data/{shard:06d}-{uuid.uuid4().hex}.rans", []

        def fill(out) -> None:
            file = _File(out, rans.Table(frequency), kind)
            made.append(file)
            for b in chain((batch,), batches):
                file.add(*(b.column(i).to_pylist() for i in range(3)))
            file.close()

        _write(path, fill)
        yield made[0].units(path, shard)

    order = (F.col("key").asc_nulls_last(), F.col("tie"), F.col("_row"))
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    ranges = numbered.repartitionByRange(max(1, -(-total // shard_ids)), *order).sortWithinPartitions(*order)
    ranges.select("key", "n", "ids").mapInArrow(write, _UNIT_DDL).write.parquet(f"{folder}/manifest")
    return folder


def _index(f, size: int) -> tuple[np.ndarray, ...]:
    f.seek(size - struct.calcsize(_END))
    start, docs, blocks, segments, _, check, magic = struct.unpack(_END, f.read(struct.calcsize(_END)))
    if magic != MAGIC:
        raise ValueError("not a file of token ids")
    f.seek(start)
    index = f.read(size - struct.calcsize(_END) - start)
    if zlib.crc32(index) != check:
        raise ValueError("damaged index of token ids")
    out, at = [], 0
    for dtype, n in (("<i8", docs), ("<u1", docs), ("<i8", docs), ("<i8", 3 * blocks), ("<u4", segments)):
        out.append(np.frombuffer(index, dtype, n, at))
        at += n * np.dtype(dtype).itemsize
    return (*out[:3], out[3].reshape(-1, 3), out[4])


def _ids(f, blocks: np.ndarray, sums: np.ndarray, table: rans.Table, first: int, n: int) -> np.ndarray:
    """n ids from the first one on; every segment touched is decoded whole and compared with its checksum."""
    before, segment = np.cumsum(blocks[:, 1]) - blocks[:, 1], 0
    out, skipped = [], None
    for (offset, size, words), start in zip(blocks.tolist(), before.tolist()):
        marks = -(-size // rans.CHECKPOINT)
        if start + size > first and start < first + n:
            a = max(first - start, 0) // rans.CHECKPOINT
            z = min(-(-(first + n - start) // rans.CHECKPOINT), marks)
            f.seek(offset)
            states = np.frombuffer(f.read(8 * rans.LANES * marks), "<u8").reshape(-1, rans.LANES)
            at = np.frombuffer(f.read(8 * marks), "<i8")
            # the stream from the first checkpoint needed to the one after the last
            stop = int(at[z]) if z < marks else words
            f.seek(offset + 8 * (rans.LANES + 1) * marks + 4 * int(at[a]))
            stream = np.frombuffer(f.read(4 * (stop - int(at[a]))), "<u4")
            block = rans.Block(size, states, at - at[a], stream)
            got = rans.decode(block, table, a * rans.CHECKPOINT, min(z * rans.CHECKPOINT, size))
            for i in range(a, z):
                part = got[(i - a) * rans.CHECKPOINT:(i - a + 1) * rans.CHECKPOINT]
                if zlib.crc32(part.astype("<u4").tobytes()) != sums[segment + i]:
                    raise ValueError("damaged token ids")
            skipped = start + a * rans.CHECKPOINT if skipped is None else skipped
            out.append(got)
        segment += marks
    got = np.concatenate(out) if out else np.empty(0, np.uint32)
    return got[first - (skipped or 0):][:n] if out else got


def read_tokens(spark: SparkSession, folder: str, keys: tuple[int, int] | None = None, tasks: int | None = None) -> DataFrame:
    """key, start (ids of all documents before it), n, ids (binary: little-endian uint32), one row per document.

    ``keys``: only documents with keys from the first to the second; files and units without them aren't opened.
    """
    units = spark.read.schema(_UNIT_DDL).parquet(f"{folder}/manifest")
    # one row per file
    shards = units.groupBy("shard").agg(F.sum("ids").alias("_n"))
    shards = shards.select("shard", (F.sum("_n").over(Window.orderBy("shard")) - F.col("_n")).alias("_before"))
    if keys is not None:
        units = units.filter((F.col("first_key") <= keys[1]) & F.coalesce(F.col("last_key") >= keys[0], F.lit(True)))
    # units are few and small rows that stand for much work: as many tasks as units, which adaptive execution would join again
    tasks = tasks or min(max(units.count(), 1), 20_000)
    todo = units.join(shards, "shard").select("path", "first_doc", "docs", "first_id", "ids", "_before").repartition(tasks)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            for path, first_doc, docs, first_id, n, before in zip(*(c.to_pylist() for c in batch.columns)):
                if table is None:
                    store, name = _open(f"{folder}/table")
                    with store.open_input_stream(name) as f:
                        table = rans.Table(np.frombuffer(f.read(), "<u4"))
                store, name = _open(path)
                with store.open_input_file(name) as f:
                    key, null, sizes, blocks, sums = _index(f, f.size())
                    ids = _ids(f, blocks, sums, table, first_id, n).astype("<u4")
                of = slice(first_doc, first_doc + docs)
                ends = np.cumsum(sizes[of])
                starts = ends - sizes[of]
                # a few documents at a time: batches stay small
                for some in np.array_split(np.arange(docs), max(1, n // (1 << 20))):
                    if len(some):
                        yield pa.record_batch(
                            [pa.array(key[of][some], mask=null[of][some].astype(bool)), pa.array(starts[some] + first_id + before),
                             pa.array(sizes[of][some]), pa.array([ids[a:z].tobytes() for a, z in zip(starts[some], ends[some])], pa.binary())],
                            names=["key", "start", "n", "ids"])

    d = todo.mapInArrow(read, "key bigint, start bigint, n bigint, ids binary")
    return d if keys is None else d.filter(F.col("key").between(*keys))
