"""Cleaning a lexicon against a labelled corpus, and its coverage per class.

A lexicon is a frame with ``term, definition, category`` and one row per entry.
"""

from __future__ import annotations

from collections.abc import Sequence
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.labels import NEGATIVE, POSITIVE
from ..functions.text import contains_any, py_strip
from .matching import TermList, flag_any_term, term_hit_counts

MIN_HITS = 3
# Phrases in a definition that disqualify a term.
STOP_PHRASES = ("在某些", "原本", "本意", "本为", "多数", "通称", "调侃")
STAGES = ("original", "not_in_negative", "longer_than_one", "not_short_latin",
          "no_stop_phrase", "min_hits", "category_ok")


@F.pandas_udf(T.StringType())
def nfkc_lower(s: pd.Series) -> pd.Series:
    """NFKC + lower case, NULL -> ''."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x).lower() if isinstance(x, str) else "")


def longer_than_one(term: Column | str) -> Column:
    return F.length(py_strip(F.coalesce(term if isinstance(term, Column) else F.col(term), F.lit("")))) > 1


def short_latin(term: Column | str) -> Column:
    """One or two ASCII letters and nothing else."""
    term = term if isinstance(term, Column) else F.col(term)
    return F.regexp_like(py_strip(F.coalesce(term, F.lit(""))), F.lit(r"\A[A-Za-z]{1,2}\z"))


def category_is_other(category: Column | str) -> Column:
    category = category if isinstance(category, Column) else F.col(category)
    return F.contains(F.lower(F.coalesce(category, F.lit(""))), F.lit("other"))


def usable_terms(lexicon: DataFrame, term: str = "term") -> DataFrame:
    """Stripped, non-blank, distinct terms."""
    return lexicon.select(py_strip(F.col(term)).alias("term")).filter(F.col("term") != "").distinct()


def lexicon_with_stages(lexicon: DataFrame, corpus: DataFrame, text: str = "sentence",
                        label: str = "label", stop_phrases: Sequence[str] = STOP_PHRASES,
                        min_hits: int = MIN_HITS, strategy: str = "auto") -> DataFrame:
    """Lexicon rows plus ``hits``, ``negative_hits`` and ``stage``: the last stage each row reaches (0-6).

    The corpus is matched once; both counts and every later stage come from that one pass.
    """
    counts = (
        term_hit_counts(
            corpus.withColumn("_neg", (F.col(label) == NEGATIVE).cast("int")),
            text, TermList(lexicon), by=["_neg"], strategy=strategy,
        )
        .groupBy("term")
        .agg(
            F.sum("hits").alias("hits"),
            F.sum(F.when(F.col("_neg") == 1, F.col("hits")).otherwise(0)).alias("negative_hits"),
        )
    )
    joined = lexicon.join(counts, "term", "left").fillna(0, ["hits", "negative_hits"])
    passes = [
        F.col("negative_hits") == 0,
        longer_than_one("term"),
        ~short_latin("term"),
        ~contains_any(nfkc_lower(F.col("definition")), stop_phrases),
        F.col("hits") >= min_hits,
        ~category_is_other("category"),
    ]
    stage = F.lit(len(passes))
    for i in range(len(passes) - 1, -1, -1):
        stage = F.when(~passes[i], F.lit(i)).otherwise(stage)
    return joined.withColumn("stage", stage)


def clean_lexicon(staged: DataFrame) -> DataFrame:
    """Rows of ``lexicon_with_stages`` that pass every stage."""
    return staged.filter(F.col("stage") == len(STAGES) - 1)


def funnel(staged: DataFrame) -> DataFrame:
    """``stage, stage_name, terms``: how many entries are left after each stage."""
    sums = [F.sum((F.col("stage") >= i).cast("long")).alias(f"s{i}") for i in range(len(STAGES))]
    rows = F.array(*[
        F.struct(F.lit(i).alias("stage"), F.lit(name).alias("stage_name"),
                 F.coalesce(F.col(f"s{i}"), F.lit(0)).alias("terms"))
        for i, name in enumerate(STAGES)
    ])
    return staged.agg(*sums).select(F.inline(rows))


def terms_without_class(lexicon: DataFrame, corpus: DataFrame, text: str, label: str,
                        cls: str = NEGATIVE, strategy: str = "auto") -> DataFrame:
    """Lexicon rows whose term occurs in no text of the class."""
    texts = corpus.filter(F.col(label) == cls).select(text)
    hits = term_hit_counts(texts, text, TermList(lexicon), strategy=strategy)
    return lexicon.join(hits.select("term"), "term", "left_anti")


def frequent_terms(lexicon: DataFrame, corpus: DataFrame, text: str, min_hits: int = MIN_HITS,
                   strategy: str = "auto") -> DataFrame:
    """``term, hits`` for terms found in at least ``min_hits`` texts."""
    hits = term_hit_counts(corpus.select(text), text, TermList(lexicon), strategy=strategy)
    return hits.filter(F.col("hits") >= min_hits)


def coverage(corpus: DataFrame, text: str, label: str, terms: DataFrame, row_key: str,
             classes: Sequence[str] = (NEGATIVE, POSITIVE), strategy: str = "auto") -> DataFrame:
    """``label, rows, hits, pct`` per class: share of texts with at least one term; empty class -> 0."""
    flagged = flag_any_term(corpus.select(row_key, text, label), text, TermList(terms), row_key,
                            strategy=strategy)
    per_class = [
        (F.count(F.when(F.col(label) == c, 1)).alias(f"n{i}"),
         F.coalesce(F.sum(F.when(F.col(label) == c, F.col("hit"))), F.lit(0)).alias(f"h{i}"))
        for i, c in enumerate(classes)
    ]
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("label"), F.col(f"n{i}").alias("rows"), F.col(f"h{i}").alias("hits"),
            F.when(F.col(f"n{i}") == 0, F.lit(0.0))
            .otherwise(100.0 * F.col(f"h{i}") / F.col(f"n{i}")).alias("pct"),
        )
        for i, c in enumerate(classes)
    ])
    return flagged.agg(*[c for pair in per_class for c in pair]).select(F.inline(rows))
