"""Compare prompts of a completion function on the topic gold table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import joins, metrics as M, scoring
from ..operators.ranking import row_ordinal
from ..sources import readers as R, sinks as S


def gold_table(spark: SparkSession, flags_path: str, texts_path: str) -> DataFrame:
    """``idx, text, groups`` from the flag TSV and the text TSV; of duplicate texts the first row counts."""
    texts = row_ordinal(R.require_columns(R.read_table_tsv(spark, texts_path), "idx", "q", "c"))
    flags = R.require_columns(R.read_table_tsv(spark, flags_path), "idx")
    return R.require_rows(joins.topic_gold(flags, texts), "merged gold table")


def run(spark: SparkSession, flags_path: str, texts_path: str, prompts: dict[str, str],
        completer: Callable[[str, str], str | dict], out: str, threads: int = 5) -> DataFrame:
    """Both prompts in one job. The answer log is saved once; the metrics read it back."""
    gold = gold_table(spark, flags_path, texts_path).withColumnRenamed("groups", "gold")
    log = scoring.complete_rows(gold, prompts, completer, keep=["gold"], threads=threads)
    log = S.materialize(log.withColumn("parsed", F.to_json("parsed")), f"{out}/answers", overwrite=True)
    S.write_jsonl(log.drop("gold"), f"{out}/predictions")
    result = M.multilabel_metrics(log, "gold", "groups", by=["prompt_name"])
    S.write_metrics(result, f"{out}/category_results")
    return result
