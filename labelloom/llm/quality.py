"""Rule-based quality: counts of words, symbols and repetition, then distance from the text's language.

Each text becomes two histograms: character classes and common words. The reference of a language is the mean
histogram of all its documents (long enough to have one); the Jensen-Shannon distance of a text from it tells
token soup, shouting and markup remains from prose. Short texts have no stable histogram and are not judged by it.
A text whose language is not known is held against the nearest reference of the known ones.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .base import staged, text_of

# Frequent function words of four languages.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an",
    "en": "the of and to in a is that for it as was with be by on not he his but at are this",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más",
    "fr": "de la le et les des en un du une que est pour qui dans par pas au sur ne se plus avec",
}
# The symbols that count as such.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
#: a histogram needs so many characters, or words
MIN_CHARS_JUDGED = 200
MIN_WORDS_JUDGED = 40
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.42
#: of the mean of both distances: a text moderately odd in both ways
MAX_MEAN_DISTANCE = 0.23
#: a language's reference stands for texts of unknown language if at least so many documents made it
MIN_REFERENCE_DOCS = 10
#: so many references are tried on a text without one of its own
MOST_REFERENCES = 1000
#: a document's histogram enters the reference as shares of one million, so that sums are exact in any order
SCALE = 1_000_000

CLASSES = ("lower", "upper", "digit", "space", "symbol", "point", "other_ascii", "beyond_ascii")
VOCABULARY = sorted({w for words in COMMON_WORDS.values() for w in words.split()})


def _class_table() -> np.ndarray:
    """Class of every UTF-8 byte; a continuation byte gets none, so that code points are counted."""
    out = np.full(256, len(CLASSES), dtype=np.uint8)
    for b in range(256):
        c = chr(b)
        if b < 128:
            out[b] = (0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if b == 32 or 9 <= b <= 13
                      else 4 if c in SYMBOLS else 5 if c in ".,;:!?'\"()-" else 6)
        elif b >= 0xC0:
            out[b] = 7
    return out


def repeated_words(words: list, size: int = REPEAT_WINDOW) -> int:
    """Words inside a window of ``size`` words that occurs at least twice, the first one included."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    n = until = 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            n += i + size - max(i, until)
            until = i + size
    return n


_COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"

def _histograms(table: np.ndarray, slot: dict[bytes, int], text: bytes) -> tuple[list[int], list[int]]:
    """Code points per class and words per common word (the last number: all others)."""
    per_class = np.bincount(table[np.frombuffer(text, dtype=np.uint8)], minlength=len(CLASSES) + 1)[:-1]
    common = [0] * (len(slot) + 1)
    for w, n in Counter(text.lower().split()).items():
        common[slot.get(w, len(slot))] += n
    return per_class.tolist(), common


def _tools() -> tuple[np.ndarray, dict[bytes, int]]:
    return _class_table(), {w.encode(): i for i, w in enumerate(VOCABULARY)}


def _shares(text: Column) -> Column:
    """Both histograms as whole shares of ``SCALE``; all zero below the length guards."""
    table, slot = _tools()

    @F.arrow_udf("struct<classes:array<bigint>, common:array<bigint>>")
    def shares(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            both = _histograms(table, slot, (t or "").encode("utf-8", "surrogatepass"))
            rows.append({name: [SCALE * x // n for x in hist] if (n := sum(hist)) >= least else [0] * len(hist)
                         for name, hist, least in zip(("classes", "common"), both, (MIN_CHARS_JUDGED, MIN_WORDS_JUDGED))})
        return pa.array(rows, type=pa.struct([("classes", pa.list_(pa.int64())), ("common", pa.list_(pa.int64()))]))

    return shares(text)


def _measures(text: Column) -> Column:
    """The counts, and both histograms as shares; NULL below the length guards."""
    table, slot = _tools()
    names = [n.split()[0] for n in _COUNTS.split(", ")]
    share = pa.list_(pa.float64())

    @F.arrow_udf("struct<" + ", ".join(f"{n}:bigint" for n in names) + ", classes:array<double>, common:array<double>>")
    def measures(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            b = (t or "").encode("utf-8", "surrogatepass")
            classes, common = _histograms(table, slot, b)
            words, lines, chars = b.split(), [x for x in b.split(b"\n") if x.strip()], sum(classes)
            rows.append({
                "n_words": len(words), "word_chars": chars - classes[3], "n_symbols": classes[4],
                "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated_words(words),
                "classes": [x / chars for x in classes] if chars >= MIN_CHARS_JUDGED else None,
                "common": [x / len(words) for x in common] if len(words) >= MIN_WORDS_JUDGED else None})
        return pa.array(rows, type=pa.struct([*((n, pa.int64()) for n in names), ("classes", share), ("common", share)]))

    return measures(text)


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per language: mean histograms of all its documents of sufficient length, and ``__ref_docs``, how many have both.

    A document counts once, whatever its length. Sums are partial in each task before they are shuffled, so a language
    with most of the rows costs no more than another. NULL and empty languages have no reference.
    """
    h = docs.filter(F.col(lang) != "").select(F.col(lang).alias("__lang"), _shares(text_of(text)).alias("_h"))
    sides = {"classes": len(CLASSES), "common": len(VOCABULARY) + 1}
    sums = [F.sum(F.col(f"_h.{name}")[i]).alias(f"_{name}{i}") for name, n in sides.items() for i in range(n)]
    judged = (F.array_max("_h.classes") > 0) & (F.array_max("_h.common") > 0)
    out = h.groupBy("__lang").agg(*sums, F.count_if(judged).alias("__ref_docs"))

    out = out.select("__lang", "__ref_docs", *(F.array(*[f"_{name}{i}" for i in range(n)]).alias(name) for name, n in sides.items()))

    def mean(name: str) -> Column:
        total = F.aggregate(name, F.lit(0).cast("bigint"), lambda a, x: a + x)
        return F.when(total > 0, F.transform(name, lambda x: x / total)).alias(f"__ref_{name}")

    return out.select("__lang", "__ref_docs", *(mean(name) for name in sides))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance (root of the divergence in bits, 0 to 1) of two arrays of shares; NULL if either is."""
    def term(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    both = F.zip_with(p, q, lambda x, y: term(x, y) + term(y, x))
    distance = F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))
    return F.when(p.isNotNull() & q.isNotNull(), distance)


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", references: DataFrame | None = None,
                  max_class_distance: float = MAX_CLASS_DISTANCE,
                  max_word_distance: float = MAX_WORD_DISTANCE,
                  max_mean_distance: float = MAX_MEAN_DISTANCE) -> DataFrame:
    """All rows and columns of ``docs`` plus a struct ``_quality``.

    Its fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance
    (NULL below the length guards) and kept. Empty and NULL texts have no words and fail; equal texts of one language get
    equal verdicts; an empty table gives an empty result. ``references`` may come from another corpus; by default they
    are those of ``docs`` itself.

    A reference counts if ``MIN_REFERENCE_DOCS`` documents made it, so that no document is its own measure. A text of NULL, empty
    or unknown language, or of one without such a reference, is judged by the reference at the smallest mean of both distances, of
    the ``MOST_REFERENCES`` that most documents made; without any its distances are NULL.
    """
    refs = staged(language_references(docs, text, lang) if references is None else references)
    d = docs.withColumn("__m", _measures(text_of(text))).withColumn("__lang", F.coalesce(F.col(lang), F.lit("")))
    # a row per language, stored, so that Spark knows its size before it plans the join: small, it is broadcast and the
    # texts stay where they are; large, the join shuffles and adaptive execution splits a frequent language
    counted = refs.filter(F.col("__ref_docs") >= MIN_REFERENCE_DOCS)
    d = d.join(counted.withColumn("__known", F.lit(True)), "__lang", "left")
    # one row of bounded size that holds the references of the languages
    trusted = counted.filter(F.col("__ref_classes").isNotNull() & F.col("__ref_common").isNotNull()).orderBy(
        F.desc("__ref_docs"), "__lang").limit(MOST_REFERENCES)
    d = d.crossJoin(F.broadcast(trusted.agg(F.collect_list(F.struct("__ref_classes", "__ref_common")).alias("__refs"))))
    m = F.col("__m")

    def distances(classes: Column, common: Column) -> Column:
        by_class, by_word = jensen_shannon(m["classes"], classes), jensen_shannon(m["common"], common)
        near = F.coalesce((by_class + by_word) / 2, by_class, by_word)
        return F.struct(near.alias("near"), by_class.alias("classes"), by_word.alias("common"))

    nearest = F.array_min(F.transform("__refs", lambda r: distances(r["__ref_classes"], r["__ref_common"])))
    d = d.withColumn("__far", F.when(F.col("__known"), distances(F.col("__ref_classes"), F.col("__ref_common"))).otherwise(nearest))
    class_distance, word_distance = F.col("__far.classes"), F.col("__far.common")
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    counts = [n.split()[0] for n in _COUNTS.split(", ")]
    d = d.withColumn("_quality", F.struct(*(m[c].alias(c) for c in counts), failed.alias("base_failed"),
                                          class_distance.alias("class_distance"), word_distance.alias("word_distance")))
    q = F.col("_quality")
    far = (F.coalesce(q["class_distance"], F.lit(0.0)) > max_class_distance) | (
        F.coalesce(q["word_distance"], F.lit(0.0)) > max_word_distance) | (
        F.coalesce((q["class_distance"] + q["word_distance"]) / 2, F.lit(0.0)) > max_mean_distance)
    return d.withColumn("_quality", q.withField("kept", ~q["base_failed"] & ~far)).drop(
        "__m", "__lang", "__known", "__ref_docs", "__ref_classes", "__ref_common", "__refs", "__far")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows that pass, with the columns they came with."""
    return quality_rules(docs, **options).filter("_quality.kept").select(*(F.col(f"`{c}`") for c in docs.columns))
