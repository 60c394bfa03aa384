"""Text features: embeddings through a pluggable encoder, and relational TF-IDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from inspect import signature
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.vectors import let
from .joins import heavy_keys

Encoder = Callable[[list[str]], np.ndarray]
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
#: rows whose texts are cut into terms in one task, about
TASK_ROWS = 2000
#: rows that share one list of terms, at most (a place among them is below 2^15)
CHUNK_ROWS = 4096
#: bytes of text behind the terms that are counted in one task, about
PART_BYTES = 32 << 20
#: of a term in more than 1/HOT_TERMS of a chunk's rows, only their number goes where the term is counted
HOT_TERMS = 100
_HOT = 1 << 15
#: a text with this share of all rows is joined by broadcast
HEAVY_SHARE = 0.002

# Own prompt wordings; ``{text}`` is the row's text.
DEFAULT_PROMPTS = (
    "{text}",
    "Is the following text about a group of people, and is it unfair to them? {text}",
    "请判断下面这句话是否对某个群体带有偏见：{text}",
)
ONE_WORD_PROMPT = "In one word, the sentence \"{text}\" means: "


class NgramHashEncoder:
    """Deterministic stand-in for a sentence model: signed hashed character 1- to 3-grams, unit length."""

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.name = f"ngram-hash-{dim}"

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, s in enumerate(texts):
            codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            h = np.zeros(len(codes), dtype=np.uint64)
            for n in range(1, 4):
                if len(codes) < n:
                    break
                h = h[:len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1:] + np.uint64(n)
                mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                slot = (mixed >> np.uint64(33)) % np.uint64(self.dim)
                sign = 1.0 - 2.0 * ((mixed >> np.uint64(32)) & np.uint64(1)).astype(np.float64)
                out[i] += np.bincount(slot.astype(np.int64), weights=sign, minlength=self.dim)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def prompt_texts(df: DataFrame, text: str, templates: Sequence[str] = DEFAULT_PROMPTS) -> DataFrame:
    """One row per (row, prompt): adds ``prompt_no`` and ``prompt``."""
    items = F.array(*[F.replace(F.lit(t), F.lit("{text}"), F.col(text)) for t in templates])
    return df.select("*", F.posexplode(items).alias("prompt_no", "prompt"))


def _built(encoder):
    """The encoder itself, or what a class or a function without parameters makes."""
    if isinstance(encoder, type):
        return encoder()
    try:
        return encoder if signature(encoder).parameters else encoder()
    except ValueError:  # a built-in without a signature takes texts
        return encoder


def encode(df: DataFrame, text: str, encoder: Encoder | Callable[[], Encoder], name: str = "embedding",
           batch_size: int = 256) -> DataFrame:
    """Add an ``array<float>`` column. ``encoder`` is a picklable callable on a list of texts, or a
    zero-argument class/factory that is built once per task (for models too large to pickle).
    """
    schema = T.StructType(df.schema.fields + [T.StructField(name, T.ArrayType(T.FloatType()))])
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _built(encoder)
        for pdf in batches:
            texts = [s if isinstance(s, str) else "" for s in pdf[text]]
            parts = [enc(texts[i:i + batch_size]) for i in range(0, len(texts), batch_size)]
            rows = np.concatenate(parts).astype(np.float32) if parts else np.empty((0, 0), np.float32)
            pdf[name] = list(rows)
            yield pdf

    return df.mapInPandas(run, schema)


def _encode_prompts(df: DataFrame, text: str, encoder, templates: Sequence[str], dim: int,
                    batch_size: int = 256) -> DataFrame:
    """Add ``embedding``: all prompts of a row are encoded in one pass over the partition."""
    schema = T.StructType(df.schema.fields + [T.StructField("embedding", T.ArrayType(T.FloatType()))])
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _built(encoder)
        for pdf in batches:
            texts = [s if isinstance(s, str) else "" for s in pdf[text]]
            parts = []
            for t in templates:
                prompts = [t.replace("{text}", s) for s in texts]
                rows = [enc(prompts[i:i + batch_size]) for i in range(0, len(prompts), batch_size)]
                v = np.concatenate(rows) if rows else np.empty((0, max(dim, 0)))
                if dim > v.shape[1]:
                    raise ValueError(f"crop to {dim} exceeds vector size {v.shape[1]}")
                parts.append(v[:, :dim] if dim > 0 else v)
            pdf["embedding"] = list(np.concatenate(parts, axis=1).astype(np.float32))
            yield pdf

    return df.mapInPandas(run, schema)


def embed(df: DataFrame, text: str, encoder: Encoder, templates: Sequence[str] = DEFAULT_PROMPTS, dim: int = 0,
          dedupe: bool = True, provenance: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` plus ``embedding``: one vector per prompt, cropped to ``dim``, concatenated in prompt order.

    With ``dedupe`` every distinct text is encoded once and joined back by a digest of the text;
    the vectors of texts that each hold ``HEAVY_SHARE`` of all rows (so a few hundred) are joined by broadcast.
    ``provenance`` values become constant columns.
    """
    if dedupe:
        keyed = df.withColumn("_d", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
        # distinct over both columns is a hash aggregate; the digest alone would need a sort
        distinct = keyed.select("_d", F.coalesce(F.col(text), F.lit("")).alias(text)).distinct()

        def coded(texts: DataFrame) -> DataFrame:
            return _encode_prompts(texts, text, encoder, templates, dim).select("_d", "embedding")

        heavy = heavy_keys(keyed, "_d", HEAVY_SHARE)
        is_heavy = F.col("_d").isin(*heavy)
        # the texts are divided before they are encoded, so each one is encoded on one side only
        out = (keyed.filter(~is_heavy) if heavy else keyed).join(coded(distinct.filter(~is_heavy) if heavy else distinct), "_d")
        if heavy:
            out = out.unionByName(keyed.filter(is_heavy).join(F.broadcast(coded(distinct.filter(is_heavy))), "_d"))
        out = out.drop("_d")
    else:
        out = _encode_prompts(df, text, encoder, templates, dim)
    return out.withColumns({k: F.lit(v) for k, v in (provenance or {}).items()})


def english_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def token_array(text: Column | str, stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased word tokens in order, without stop words."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))
    return words


def with_bigrams(words: Column) -> Column:
    """Words followed by the pairs of neighbouring words."""
    def body(w: Column) -> Column:
        following = F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1)))
        pairs = F.zip_with(w, following, lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(w, F.filter(pairs, lambda x: x.isNotNull()))  # the last word has no follower

    return let(words, body)


def term_frequencies(words: Column, ngrams: int = 2) -> Column:
    """Token array -> ``array<struct<term,tf>>`` within the row: sort, then run lengths. No shuffle."""
    def runs(s: Column) -> Column:
        n = F.size(s)
        index = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.filter(index, lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))

    def pack(s: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1))), F.array(F.size(s) + 1))
        return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(s, a - 1).alias("term"), (b - a).alias("tf")))

    terms = F.sort_array(with_bigrams(words) if ngrams > 1 else words)
    packed = let(terms, lambda s: let(runs(s), lambda starts: pack(s, starts)))
    return F.filter(packed, lambda x: x["term"].isNotNull())


def tfidf(docs: DataFrame, key: str, text: str, min_df: int = 2, max_df: float = 0.95, ngrams: int = 2,
          stop_words: Sequence[str] | None = None, strategy: str = "auto") -> DataFrame:
    """``key, term, tf, df, weight``: smoothed TF-IDF, L2-normalised per document.

    idf = ln((1+n)/(1+df)) + 1. Terms in fewer than ``min_df`` rows or in more than ``max_df`` of them
    are dropped. Texts are dealt evenly and cut into terms once. What travels to be counted, and back, is packed: a term once for all rows
    of a chunk, with places and counts in as few bytes as they ask for. Rows of one key have one norm; only those of repeated keys are
    brought together for it. ``strategy="broadcast"`` counts first and broadcasts the vocabulary, which then has to be small.
    """
    stop = english_stop_words() if stop_words is None else list(stop_words)
    if strategy not in ("auto", "shuffle", "broadcast"):
        raise ValueError(f"unknown strategy: {strategy}")
    docs = docs.select(key, text)
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length(text))).first()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    tasks = max(2 * cores, n // TASK_ROWS)
    tokens = token_array(text, stop).alias("_w")
    idf = F.ln(F.lit(1.0 + n) / (F.lit(1.0) + F.col("df"))) + 1.0
    x = (F.col("tf") * idf).alias("_x")
    norm = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(Window.partitionBy(key)))
    out = [key, "term", "tf", "df"]
    if strategy == "broadcast":
        words = docs.repartition(tasks).select(key, tokens)
        tf = words.select(key, F.inline(term_frequencies(F.col("_w"), ngrams)))
        seen = with_bigrams(F.col("_w")) if ngrams > 1 else F.col("_w")
        counts = words.select(F.explode(F.array_distinct(seen)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        counted = tf.join(F.broadcast(counts.filter(F.col("df") >= min_df)), "term")
        kept = counted.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * n))).select(*out, x)
        return kept.select(*out, (F.col("_x") / norm).alias("weight"))
    repeated = docs.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col(key).alias("_k"), F.lit(True).alias("_again"))
    again = bool(repeated.limit(1).collect())
    if again:
        docs = docs.join(repeated, F.col(key).eqNullSafe(F.col("_k")), "left").select(key, text, F.coalesce("_again", F.lit(False)).alias("_again"))
    else:
        docs = docs.withColumn("_again", F.lit(False))
    # a file may come as one partition
    words = docs.repartition(tasks).select(F.col(key).alias("_key"), "_again", tokens)
    found = _counted(words, key, n, min_df, max_df * n, ngrams, tasks, max(cores, -(-(size or 0) // PART_BYTES)))
    once = found.select(*out, (x / F.sqrt("_square")).alias("weight"))
    if not again:
        return once
    # rows stay long: a window per document is a sort on the key, where collecting arrays would
    # fall back to sorted object aggregation
    more = found.filter("_again").select(*out, x)
    return found.filter("not _again").select(*once.columns[:-1], (x / F.sqrt("_square")).alias("weight")).unionByName(
        more.select(*out, (F.col("_x") / norm).alias("weight")))


def _zip(x: np.ndarray | bytes | pa.Buffer) -> bytes:
    x = x.tobytes() if isinstance(x, np.ndarray) else bytes(x)
    return len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True)


def _unzip(x: bytes) -> bytes:
    return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as the largest asks for."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


def _numbers(x: bytes, n: int) -> np.ndarray:
    """What ``_small`` and ``_zip`` made of n numbers."""
    x = _unzip(x)
    return np.frombuffer(x, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(x) // n]).astype(np.int64) if n else np.empty(0, np.int64)


def _strings(data: bytes, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _counted(words: DataFrame, key: str, n: int, least: float, most: float, ngrams: int, chunks: int, parts: int) -> DataFrame:
    """``key, term, tf, df, _square, _again`` of the terms in ``least`` to ``most`` of all rows; ``_square`` is the sum of a row's squared
    weights. ``words``: _key, _again, _w (array<string>).

    Rows are packed by chunks, a chunk's terms by parts, which a term's hash tells. A part counts its terms and sends those that are kept back
    to their chunks. The rows' keys, and the postings of hot terms, pass by (part below zero).
    """
    key_type = words.schema["_key"].dataType
    binary = ["terms", "sizes", "n", "pos", "tf", "df"]
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("chunk", T.LongType()),
                           T.StructField("keys", T.ArrayType(key_type)), T.StructField("again", T.ArrayType(T.BooleanType())),
                           *(T.StructField(c, T.BinaryType()) for c in binary)])
    hot_terms = HOT_TERMS

    def table(rows: list[dict], like: pa.Schema) -> pa.Table:
        return pa.Table.from_pydict({c.name: pa.array([r.get(c.name) for r in rows], c.type) for c in like}, like)

    def packed(chunk: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("_w")
        flat = lists.flatten().dictionary_encode()
        word = flat.dictionary
        by_name = pc.sort_indices(word).to_numpy()
        rank = np.empty(len(word), np.int64)
        rank[by_name] = np.arange(len(word))
        word, at = word.take(pa.array(by_name)), rank[flat.indices.to_numpy()]
        row = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        v = max(len(word), 1)
        code, of = at, row
        if ngrams > 1 and len(at):
            pair = np.flatnonzero(row[1:] == row[:-1])
            code, of = np.concatenate([at, (at[pair] + 1) * v + at[pair + 1]]), np.concatenate([row, row[pair]])
        order = np.lexsort((of, code))
        code, of = code[order], of[order]
        new = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (of[1:] != of[:-1])))) if len(code) else np.empty(0, np.int64)
        tf, code, pos = np.diff(np.append(new, len(code))), code[new], of[new]
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else new
        held, code = np.diff(np.append(first, len(code))), code[first]
        # alphabetical, words before pairs
        a, b = code // v - 1, code % v
        terms = word.take(pa.array(b[a < 0])).cast(pa.large_string())
        if (a >= 0).any():
            left, right = (word.take(pa.array(i[a >= 0])).cast(pa.large_string()) for i in (a, b))
            terms = pa.concat_arrays([terms, pc.binary_join_element_wise(left, right, pa.scalar(" ", pa.large_string()))])
        h = np.fromiter((zlib.crc32(w.encode()) for w in word.to_pylist()), np.uint64, len(word)) + np.uint64(1)
        mixed = np.where(a < 0, h[b], h[a] * np.uint64(0x9E3779B97F4A7C15) + h[b]) if len(b) else np.empty(0, np.uint64)
        part = ((mixed * np.uint64(0xD1342543DE82EF95)) >> np.uint64(33)).astype(np.int64) % parts
        # terms by part, and their postings likewise
        order = np.argsort(part, kind="stable")
        start = np.cumsum(held) - held
        part, terms, held, start = part[order], terms.take(pa.array(order)), held[order], start[order]
        moved = np.repeat(start - np.cumsum(held) + held, held) + np.arange(held.sum())
        pos, tf = pos[moved], tf[moved]
        hot = held * hot_terms > len(batch)
        is_hot = np.repeat(hot, held)
        sizes = pc.binary_length(terms).to_numpy()
        data = terms.buffers()[2] if len(terms) else pa.py_buffer(b"")
        offset = np.concatenate(([0], np.cumsum(sizes)))
        posting = np.concatenate(([0], np.cumsum(held)))
        cuts = np.append(np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))), len(part)).tolist() if len(part) else [0]
        rows = [{"part": -1 - chunk % parts, "chunk": chunk, "keys": batch.column("_key").to_pylist(), "again": batch.column("_again").to_pylist(),
                 "pos": _zip(pos[is_hot].astype(np.uint16)), "tf": _zip(_small(tf[is_hot]))}]
        for i, z in zip(cuts, cuts[1:]):
            some = slice(posting[i], posting[z])
            cold = ~is_hot[some]
            rows.append({"part": int(part[i]), "chunk": chunk, "terms": _zip(data[int(offset[i]):int(offset[z])]), "sizes": _zip(_small(sizes[i:z])),
                         "n": _zip((held[i:z] + hot[i:z] * _HOT).astype(np.uint16)), "pos": _zip(pos[some][cold].astype(np.uint16)),
                         "tf": _zip(_small(tf[some][cold]))})
        like = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("keys", pa.list_(batch.column("_key").type)), ("again", pa.list_(pa.bool_())),
                          *((c, pa.binary()) for c in binary)])
        return table(rows, like).combine_chunks().to_batches()[0]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        for batch in batches:
            pieces = -(-len(batch) // CHUNK_ROWS)
            for i in range(pieces):
                a, z = i * len(batch) // pieces, (i + 1) * len(batch) // pieces
                yield packed(chunk, batch.slice(a, z - a))
                chunk += 1

    def entries(t: pa.Table) -> tuple:
        """Sizes of the terms, numbers of their rows, whether they are hot, their bytes, and place and count of the others' postings."""
        n = [np.frombuffer(_unzip(x), np.uint16).astype(np.int64) for x in t.column("n").to_pylist()]
        sizes = np.concatenate([_numbers(x, len(y)) for x, y in zip(t.column("sizes").to_pylist(), n)])
        pos = [np.frombuffer(_unzip(x), np.uint16) for x in t.column("pos").to_pylist()]
        tf = np.concatenate([_numbers(x, len(y)) for x, y in zip(t.column("tf").to_pylist(), pos)])
        held = np.concatenate(n)
        return ([len(x) for x in n], sizes, held & (_HOT - 1), held >= _HOT, b"".join(_unzip(x) for x in t.column("terms").to_pylist()),
                np.concatenate(pos), tf)

    def count(t: pa.Table) -> pa.Table:
        if t.column("part")[0].as_py() < 0:
            return t
        each, sizes, held, hot, data, pos, tf = entries(t)
        terms = _strings(data, sizes)
        term = terms.dictionary_encode().indices.to_numpy()
        df = np.bincount(term, weights=held)[term].astype(np.int64)
        df[(df < least) | (df > most)] = 0
        back = hot | (df > 0)
        kept = terms.filter(pa.array(back))
        posting = np.repeat(back & ~hot, np.where(hot, 0, held))
        pos, tf, df = pos[posting], tf[posting], df[back]
        sent = np.concatenate(([0], np.cumsum(np.where(hot, 0, held)[back])))
        size, n = sizes[back], (held + hot * _HOT)[back].astype(np.uint16)
        offset = np.concatenate(([0], np.cumsum(size)))
        cuts = np.concatenate(([0], np.cumsum(back)))[np.concatenate(([0], np.cumsum(each)))].tolist()
        data = kept.buffers()[2] if len(kept) else pa.py_buffer(b"")
        rows = [{"part": part, "chunk": chunk, "terms": _zip(data[int(offset[i]):int(offset[z])]), "sizes": _zip(_small(size[i:z])),
                 "n": _zip(n[i:z]), "pos": _zip(pos[sent[i]:sent[z]]), "tf": _zip(_small(tf[sent[i]:sent[z]])), "df": _zip(_small(df[i:z]))}
                for part, chunk, i, z in zip(t.column("part").to_pylist(), t.column("chunk").to_pylist(), cuts, cuts[1:]) if z > i]
        return table(rows, t.schema)

    out = T.StructType([T.StructField(key, key_type), T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType()),
                        T.StructField("df", T.LongType()), T.StructField("_square", T.DoubleType()), T.StructField("_again", T.BooleanType())])

    def gather(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        own = pc.index(pc.less(t.column("part"), 0), True).as_py()
        keys, again = (t.column(c)[own].values for c in ("keys", "again"))
        hot_pos = np.frombuffer(_unzip(t.column("pos")[own].as_py()), np.uint16)
        hot_tf = _numbers(t.column("tf")[own].as_py(), len(hot_pos))
        t = t.slice(1)
        none = np.empty(0, np.int64)
        each, sizes, held, hot, data, pos, tf = entries(t) if len(t) else ([], none, none, none.astype(bool), b"", none, none)
        df = np.concatenate([none, *(_numbers(x, i) for x, i in zip(t.column("df").to_pylist(), each))])
        at = np.arange(len(held))
        term = np.concatenate([np.repeat(at[~hot], held[~hot]), np.repeat(at[hot], held[hot])])
        pos, tf = np.concatenate([pos, hot_pos]).astype(np.int64), np.concatenate([tf, hot_tf])
        kept = np.flatnonzero(df[term] > 0)
        kept = kept[np.argsort(pos[kept], kind="stable")]
        term, pos, tf = term[kept], pos[kept], tf[kept]
        x = tf * (np.log((1.0 + n) / (1.0 + df[term])) + 1.0)
        square = np.bincount(pos, x * x, minlength=1)[pos] if len(pos) else np.empty(0)
        names = _strings(data, sizes).cast(pa.large_string()).cast(pa.string())
        return pa.table({key: keys.take(pa.array(pos)), "term": names.take(pa.array(term)), "tf": pa.array(tf.astype(np.int32)),
                         "df": pa.array(df[term]), "_square": pa.array(square), "_again": again.take(pa.array(pos))})

    # as many tasks as chunks and parts, however many partitions a shuffle has: a task has to hold what it sorts
    by_part = words.mapInArrow(pack, schema).repartition(parts, "part").groupBy("part").applyInArrow(count, schema)
    return by_part.repartition(chunks, "chunk").groupBy("chunk").applyInArrow(gather, out)


def top_terms(weights: DataFrame, key: str, n: int) -> DataFrame:
    """The n heaviest terms of every document, ties by term; a task of ``tfidf`` leaves no more of them to be shuffled."""
    order = Window.partitionBy(key).orderBy(F.desc("weight"), "term")
    ranked = weights.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.select(key, "rank", "term", "weight")
