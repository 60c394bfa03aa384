"""A training corpus in five stages: good texts, one of each near copy, no benchmark passages, no secrets, mixed.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelloom.llm import decontamination, mixing, quality, secrets, simhash, similarity
from labelloom.llm.base import staged, table

#: near copies of the corpus: five-word shingles of at least this Jaccard similarity in a hundred
NEAR_SHINGLE = 5
NEAR_PERCENT = 80
#: SimHash fingerprints that differ in at most so many bits bring texts together, as in op3; bands do so for others
NEAR_BITS = simhash.MAX_BITS


#: rows of an Arrow batch at most: texts may be long, and a batch is held by its worker as columns, as objects and as results
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python; a smaller bound of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    small_batches(spark)
    return quality.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: the one with the smallest id."""
    small_batches(spark)
    return simhash.one_of_each(docs, find=similarity.similar_texts, shingle=NEAR_SHINGLE, percent=NEAR_PERCENT,
                               bits=NEAR_BITS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    small_batches(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; no document goes."""
    small_batches(spark)
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its place in the mixture of the sources."""
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
]

#: language references and fingerprints can't be said in SQL; tests hold run() against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs)
    return docs
