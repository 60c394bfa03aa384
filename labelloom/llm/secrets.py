"""Secrets in texts: one keyword automaton per text, anchored expressions at its hits, then checksums.

The automaton reads a text once. Only where it meets a keyword is a regular expression tried, anchored there, so the
cost of the expressions follows the number of hits, not the length of the text. Kinds whose tokens embed a checksum
(CRC-32 in base 62) are reported only if it holds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
import re
import string
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .base import text_of

BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase
CHECKED_LENGTH = 30
CHECKSUM_LENGTH = 6


def base62_checksum(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(CHECKSUM_LENGTH):
        n, digit = divmod(n, 62)
        out = BASE62[digit] + out
    return out


def has_checksum(token: str) -> bool:
    """``prefix_`` + 30 characters + the CRC-32 of these 30 in base 62."""
    body = token.rpartition("_")[2]
    return body[CHECKED_LENGTH:] == base62_checksum(body[:CHECKED_LENGTH])


@dataclass(frozen=True)
class Kind:
    """A kind of secret. ``keywords`` are in lower case: every match of ``pattern`` starts with one of them."""

    name: str
    keywords: tuple[str, ...]
    pattern: str
    group: int = 0  # the part whose length counts
    least: int = 1
    ignore_case: bool = False
    checksum: bool = False


# The kinds, base kinds first.
BASE_KINDS = (
    Kind("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"),
         r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, least=12, ignore_case=True),
    Kind("access", ("akia",), r"AKIA[A-Z0-9]+", least=18),
    # a run of hexadecimal characters starts with one of the four-character ones
    Kind("hex", tuple(map("".join, product("0123456789abcdef", repeat=4))), r"[0-9a-f]+", least=16),
)
CHECKED_KINDS = (
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", checksum=True),
    Kind("npm", ("npm_",), r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", checksum=True),
)


class Scanner:
    """Finds the spans of all kinds in one text; built once per task."""

    def __init__(self, kinds: Sequence[Kind]):
        self.kinds = [(k, re.compile(k.pattern, re.A | (re.I if k.ignore_case else 0))) for k in kinds]
        by_word: dict[str, list[int]] = {}
        for i, k in enumerate(kinds):
            for w in k.keywords:
                by_word.setdefault(w, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for w, which in by_word.items():
            self.automaton.add_word(w, (len(w), tuple(which)))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, kind number), leftmost and non-overlapping within each kind, in order of start then kind."""
        # only A-Z are lowered, so positions are those of the text
        low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        kinds = self.kinds
        hits: list[list[int]] = [[] for _ in kinds]
        for last, (size, which) in self.automaton.iter(low):
            for i in which:
                hits[i].append(last + 1 - size)
        out = []
        for i, (kind, pattern) in enumerate(kinds):
            end = -1
            for start in sorted(hits[i]):
                if start < end:
                    continue
                m = pattern.match(text, start)
                if m is None:
                    continue
                end = m.end()  # what is too short still takes its place
                if m.end(kind.group) - m.start(kind.group) >= kind.least and not (
                        kind.checksum and not has_checksum(m.group())):
                    out.append((start, end, i))
        return sorted(out, key=lambda x: (x[0], x[2]))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def find_secrets(docs: DataFrame, text: str = "text", name: str = "secrets",
                 kinds: Sequence[Kind] = BASE_KINDS + CHECKED_KINDS) -> DataFrame:
    """All rows and columns of ``docs`` plus an array of (start, end, kind): code points, end exclusive.

    NULL and empty texts give an empty array. Texts are scanned whole, in linear time. Spans of different kinds may
    overlap; equal texts give equal spans. An existing column ``name`` is replaced.
    """
    kinds = tuple(kinds)
    names = [k.name for k in kinds]
    kept: list[Scanner] = []

    @F.arrow_udf("array<struct<start:bigint, end:bigint, kind:string>>")
    def scan(column: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Scanner(kinds))
        return pa.array([[{"start": s, "end": e, "kind": names[k]} for s, e, k in kept[0].spans(t)] if t else []
                         for t in column.to_pylist()], type=_SPANS)

    return docs.withColumn(name, scan(text_of(text)))


def spans_text(spans: Column, only: Sequence[str] | None = None) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    if only is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(list(only)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` with every secret replaced by ``[kind]``; overlapping spans become one replacement of the first kind.

    Texts without secrets are unchanged (NULL stays NULL). ``n_chars``, if the column exists, follows the new text.
    """
    spans = "__secrets"
    found = find_secrets(docs, text, spans, **options)
    empty = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        head = F.concat(F.substring(F.col(text), (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")),
                        F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.when(fresh, F.concat(done["out"], head)).otherwise(done["out"]).alias("out"),
                        F.greatest(done["at"], s["end"]).alias("at"))

    def finish(done: Column) -> Column:
        return F.concat(done["out"], F.substring(F.col(text), (done["at"] + 1).cast("int"), F.length(text)))

    clean = F.when(F.size(spans) > 0, F.aggregate(spans, empty, step, finish)).otherwise(F.col(text))
    out = found.withColumn(text, clean).drop(spans)
    if n_chars and n_chars in docs.columns:
        touched = F.col(text).isNotNull()
        out = out.withColumn(n_chars, F.when(touched, F.length(text).cast(dict(docs.dtypes)[n_chars])).otherwise(F.col(n_chars)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
