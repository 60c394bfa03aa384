"""Quality classifier: a factorisation machine on hashed words, structure statistics and metadata.

Every feature has a weight and a short vector; a pair of features interacts by the product of their vectors. The sum over
all pairs is taken as half of (square of the sum - sum of the squares) per vector component, so scoring a text is linear
in its number of features. Training reads a bounded sample of labelled rows; every round, each task runs one pass of
stochastic gradient steps over its own rows and the models are averaged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .base import staged, text_of
from .quality import _class_table

WORD_SLOTS = 1 << 14
RANK = 8
#: labelled rows that are used for training at most: those whose ids have the smallest hashes
MAX_TRAIN_ROWS = 20_000
ROWS_PER_TASK = 4_000
ROUNDS = 6
BATCH = 64
STEP = 0.15
SHRINK = 1e-5
SEED = 11

STRUCTURE = ("upper", "digit", "space", "symbol", "point", "beyond_ascii", "word_length", "distinct_words", "n_words",
             "repeated_lines", "words_ending_in_signs", "words_of_signs", "most_frequent_word", "lines", "n_chars")
N_FEATURES = WORD_SLOTS + len(STRUCTURE)
_CLASSES = _class_table()


def features(text: str, n_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, values): words by hash with damped counts of length 1, then the structure statistics."""
    b = text.encode("utf-8", "surrogatepass")
    per_class = np.bincount(_CLASSES[np.frombuffer(b, dtype=np.uint8)], minlength=9)[:8]
    chars = max(int(per_class.sum()), 1)
    words = b.split()
    times = Counter(w.lower() for w in words) if words else {}
    n = max(len(words), 1)
    lines = [x for x in b.split(b"\n") if x.strip()]
    signs_last = sum(k for w, k in times.items() if not (w[-1:].isalnum() or w[-1] >= 128))
    signs_only = sum(k for w, k in times.items() if not any(c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 for c in w[:4]))
    structure = [per_class[1] / chars, per_class[2] / chars, per_class[3] / chars, per_class[4] / chars, per_class[5] / chars,
                 per_class[7] / chars, min(chars / n / 20, 1), len(times) / n, np.log1p(n) / 10,
                 1 - len(set(lines)) / max(len(lines), 1), signs_last / n, signs_only / n,
                 max(times.values(), default=0) / n, min(len(lines) / n, 1), np.log1p(max(n_chars, 0)) / 12]
    slots = np.fromiter((zlib.crc32(w) & (WORD_SLOTS - 1) for w in times), dtype=np.int32, count=len(times))
    value = 1 + np.log(np.fromiter(times.values(), dtype=np.float32, count=len(times)))
    if len(value):
        value /= np.sqrt((value * value).sum())
    at = np.concatenate([slots, np.arange(WORD_SLOTS, N_FEATURES, dtype=np.int32)])
    return at, np.concatenate([value, np.array(structure, dtype=np.float32)]).astype(np.float32)


@dataclass
class Model:
    """Bias, weights (N_FEATURES) and vectors (N_FEATURES x RANK)."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def margins(self, at: np.ndarray, value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(margins, sums of value times vector) of rows that start at ``first`` in the flat arrays; no row is empty."""
        scaled = self.vectors[at] * value[:, None]
        sums = np.add.reduceat(scaled, first)
        squares = np.add.reduceat(scaled * scaled, first)
        linear = np.add.reduceat(self.weights[at] * value, first)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _flat(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(a) for a, _ in rows])
    first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    return np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows]), first


def _one_pass(model: Model, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int) -> Model:
    """Adaptive gradient steps over the rows in a seeded order."""
    w, v, bias = model.weights.copy(), model.vectors.copy(), model.bias
    seen_w, seen_v, seen_b = np.full_like(w, 1e-2), np.full_like(v, 1e-2), 1e-2
    order = np.random.default_rng(seed).permutation(len(rows))
    for k in range(0, len(order), BATCH):
        some = order[k:k + BATCH]
        at, value, first = _flat([rows[i] for i in some])
        now = Model(bias, w, v)
        margin, sums = now.margins(at, value, first)
        off = ((_sigmoid(margin) - labels[some]) / len(some)).astype(np.float32)
        size = np.diff(np.append(first, len(at)))
        per_entry, sums = np.repeat(off, size), np.repeat(sums, size, axis=0)
        used, slot = np.unique(at, return_inverse=True)
        gw = np.bincount(slot, weights=per_entry * value, minlength=len(used)) + SHRINK * w[used]
        entry = (per_entry * value)[:, None] * (sums - v[at] * value[:, None])
        gv = np.stack([np.bincount(slot, weights=entry[:, f], minlength=len(used)) for f in range(v.shape[1])], axis=1)
        gv += SHRINK * v[used]
        seen_w[used] += gw * gw
        seen_v[used] += gv * gv
        seen_b += float(off.sum()) ** 2
        w[used] -= STEP * gw / np.sqrt(seen_w[used])
        v[used] -= STEP * gv / np.sqrt(seen_v[used])
        bias -= STEP * float(off.sum()) / np.sqrt(seen_b)
    return Model(bias, w, v)


def held_out(key: str = "doc_id") -> Column:
    """crc32 of the key as text leaves 1 when divided by 3; a NULL key counts as ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _n_chars(docs: DataFrame, text: str, n_chars: str | None) -> Column:
    known = F.length(text_of(text)).cast("bigint")
    return F.coalesce(F.col(n_chars).cast("bigint"), known) if n_chars in docs.columns else known


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars",
          label: str = "quality", rounds: int = ROUNDS, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit on labelled rows that are not held out, ``max_rows`` of them at most.

    Repeated labels of a document count once, by their mean; NULL labels and labels without a document are ignored. With
    no rows, or one class only, the model says what it has seen. The sample's ids are what is broadcast.
    """
    marks = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(
        (F.avg(label) >= 0.5).cast("int").alias("_label"))
    marks = marks.orderBy(F.xxhash64(key), key).limit(max_rows)

    @F.arrow_udf("struct<at:array<int>, value:array<float>>")
    def extract(texts: pa.Array, sizes: pa.Array) -> pa.Array:
        rows = [features(t or "", n) for t, n in zip(texts.to_pylist(), sizes.to_pylist())]
        return pa.array([{"at": a, "value": v} for a, v in rows],
                        type=pa.struct([("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))]))

    joined = docs.join(F.broadcast(marks), key)  # at most max_rows ids and labels
    rows = staged(joined.select(F.col(key).cast("string").alias("_k"), "_label",
                                extract(text_of(text), _n_chars(docs, text, n_chars)).alias("_x")))
    n = rows.count()
    rng = np.random.default_rng(SEED)
    model = Model(0.0, np.zeros(N_FEATURES, np.float32), rng.normal(0, 0.01, (N_FEATURES, RANK)).astype(np.float32))
    tasks = max(1, -(-n // ROWS_PER_TASK))
    # so many models of fixed size come back each round, whatever the session's number of partitions
    dealt = rows.repartition(tasks).sortWithinPartitions("_k", "_label")
    for turn in range(rounds if n else 0):
        def learn(batches: Iterator[pd.DataFrame], start: Model = model, turn: int = turn) -> Iterator[pd.DataFrame]:
            data, said = [], []
            for b in batches:
                data += [(np.asarray(x["at"], np.int32), np.asarray(x["value"], np.float32)) for x in b["_x"]]
                said += b["_label"].tolist()
            if data:
                m = _one_pass(start, data, np.array(said, np.float32), SEED + turn)
                yield pd.DataFrame({"n": [len(data)], "bias": [float(m.bias)], "weights": [m.weights.astype(np.float32).tobytes()],
                                    "vectors": [m.vectors.astype(np.float32).tobytes()], "check": [said[0]]})

        parts = sorted(dealt.mapInPandas(learn, "n bigint, bias double, weights binary, vectors binary, check int").collect(),
                       key=lambda r: (r["n"], r["bias"]))
        share = np.array([p["n"] for p in parts]) / sum(p["n"] for p in parts)
        model = Model(
            float(sum(s * p["bias"] for s, p in zip(share, parts))),
            sum(s * np.frombuffer(p["weights"], np.float32) for s, p in zip(share, parts)).astype(np.float32),
            sum(s * np.frombuffer(p["vectors"], np.float32) for s, p in zip(share, parts)).astype(np.float32)
            .reshape(N_FEATURES, RANK))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", n_chars: str | None = "n_chars", name: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` plus the probability of label 1, from the whole text and its length alone.

    NULL and empty texts get the score of a text without words; equal texts get equal scores.
    """
    @F.arrow_udf("double")
    def probability(texts: pa.Array, sizes: pa.Array) -> pa.Array:
        rows = [features(t or "", n) for t, n in zip(texts.to_pylist(), sizes.to_pylist())]
        out: list[float] = []
        for i in range(0, len(rows), 256):
            out += _sigmoid(model.margins(*_flat(rows[i:i + 256]))[0].astype(np.float64)).tolist()
        return pa.array(out, type=pa.float64())

    return docs.withColumn(name, probability(text_of(text), _n_chars(docs, text, n_chars)))
