"""Vectors that are computed once: a store by model, dimension and digest of the text.

A store is a folder of one bucketed Parquet table per model and dimension. Rows are found by the SHA-256 of what was encoded, so a row
is right whoever wrote it and whenever: writers only ever append, a failed append leaves no row (its files are not committed), and two
writers at once at worst store a vector twice. Lookups join on the buckets; the stored vectors are not shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.features import DEFAULT_PROMPTS, Encoder, embed

BUCKETS = 64


def digest(text: Column | str) -> Column:
    """Of a text; NULL is the empty text."""
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


class VectorStore:
    """``model`` names the encoder; its prompts and the dimension are part of the key. All stores of a folder share ``buckets``."""

    def __init__(self, spark: SparkSession, path: str, model: str, dim: int = 0, prompts: Sequence[str] = DEFAULT_PROMPTS,
                 buckets: int = BUCKETS):
        asked = hashlib.sha256("\0".join(prompts).encode()).hexdigest()[:16]
        self.spark, self.dim, self.prompts, self.buckets = spark, dim, tuple(prompts), buckets
        self.path = f"{path.rstrip('/')}/model={quote(model, safe='')}/prompts={asked}/dim={dim}/buckets={buckets}"
        self.table = f"vectors_{hashlib.sha256(self.path.encode()).hexdigest()[:24]}"
        # the table is only a name for the folder: another session declares it again and finds the same rows
        spark.sql(f"""CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, vector ARRAY<FLOAT>, version BIGINT) USING parquet
            LOCATION '{self.path}' CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS""")

    def rows(self, version: int | None = None) -> DataFrame:
        """digest, vector, version; with ``version`` as the store was after that one. Repeated digests are possible."""
        self.spark.catalog.refreshTable(self.table)
        d = self.spark.table(self.table)
        return d if version is None else d.filter(F.col("version") <= version)

    def version(self) -> int:
        """Of the last append; 0 for an empty store."""
        return self.rows().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def add(self, df: DataFrame, text: str, encoder: Encoder) -> int:
        """Encode the texts that are not stored yet, each distinct one once; the store's version then."""
        texts = df.select(F.coalesce(F.col(text), F.lit("")).alias("_text")).distinct().withColumn("digest", digest("_text"))
        new = texts.join(self.rows().select("digest"), "digest", "left_anti")
        number = self.version() + 1
        coded = embed(new, "_text", encoder, self.prompts, self.dim, dedupe=False)
        rows = coded.select("digest", F.col("embedding").alias("vector"), F.lit(number).cast("bigint").alias("version"))
        # one file per bucket and append
        rows.repartition(self.buckets, "digest").write.insertInto(self.table)
        return self.version()

    def attach(self, df: DataFrame, text: str, name: str = "embedding", version: str | None = None) -> DataFrame:
        """``df`` with the stored vectors (NULL where there is none), and the version that each came with if it gets a name.

        Texts with the same digest are few per bucket or copies; a text that a third of the rows have is split by adaptive execution.
        """
        once = self.rows().groupBy("digest").agg(F.min(F.struct("version", "vector")).alias("__v"))
        v = F.col("__v")
        extra = {} if version is None else {version: v["version"]}
        return df.withColumn("digest", digest(text)).join(once, "digest", "left").withColumns({name: v["vector"], **extra}).drop("digest", "__v")

    def embed(self, df: DataFrame, text: str, encoder: Encoder, name: str = "embedding") -> DataFrame:
        """``df`` plus the vectors of all its texts; only texts that no earlier run has stored reach the encoder."""
        self.add(df, text, encoder)
        return self.attach(df, text, name)
