"""Clean a lexicon against the labelled corpus and report the funnel and the coverage."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import normalize_spaces, py_strip
from ..operators import lexicon as X
from ..sources import readers as R, sinks as S


def run(spark: SparkSession, lexicon_path: str, corpus_path: str, out: str,
        min_hits: int = X.MIN_HITS) -> dict[str, DataFrame]:
    """Writes the cleaned lexicon to ``out``; returns ``funnel`` and ``coverage``."""
    corpus = R.read_headerless_tsv(spark, corpus_path).select(
        normalize_spaces("sentence").alias("sentence"), py_strip("label").alias("label"))
    corpus = corpus.withColumn("row_key", F.monotonically_increasing_id())
    staged = X.lexicon_with_stages(R.read_lexicon(spark, lexicon_path), corpus, min_hits=min_hits)
    staged = staged.persist(StorageLevel.MEMORY_AND_DISK)  # lexicon-sized; read three times
    cleaned = X.clean_lexicon(staged).select("term", "definition", "category", "ordinal", "entry")
    S.write_lexicon(cleaned, out, R.read_lexicon_head(spark, lexicon_path))
    return {
        "funnel": X.funnel(staged),
        "coverage": X.coverage(corpus, "sentence", "label", cleaned, "row_key"),
    }
