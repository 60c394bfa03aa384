"""Turning external corpora into the two-column labelled table, and merging corrections back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.labels import NEGATIVE, any_hateful, keep_span_record, label_text, normalize_label
from ..functions.text import extract_qid, question_with_desc_stripped
from ..operators.joins import union_relabelled
from ..sources import readers as R, sinks as S

TEXT, LABEL = "Question", "Potentially_Pejorative"
RECORD = "map<string,string>"


def span_records_to_table(records: DataFrame) -> DataFrame:
    """Span-labelled records (one ``record`` map each), pruned, as text and label."""
    kept = records.filter(keep_span_record("record"))
    return kept.select(
        F.coalesce(F.try_element_at("record", F.lit("content")), F.lit("")).alias(TEXT),
        label_text(any_hateful("record")).alias(LABEL),
    )


def convert_span_corpus(spark: SparkSession, train_path: str, test_path: str, out: str) -> None:
    """Train rows then test rows; an absent file counts as empty."""
    parts = [span_records_to_table(R.read_json_any(spark, path, RECORD, missing_ok=True)) for path in (train_path, test_path)]
    S.write_tsv(parts[0].unionByName(parts[1]).select(TEXT, LABEL), out)


def harmless_rows(records: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Records whose integer label equals 0, as negatives."""
    zero = F.col(label).cast("string").try_cast("double") == 0
    return records.filter(zero).select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias(TEXT),
                                       F.lit(NEGATIVE).alias(LABEL))


def convert_harmless_corpus(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Writes the table; returns the quarantined lines. An array file has to parse as a whole."""
    records = R.read_json_any(spark, path, "text string, label string")
    S.write_tsv(harmless_rows(records), out)
    return R.bad_lines(spark, path)


def instruction_records(raw: DataFrame, max_chars: int = 1024) -> DataFrame:
    """Instruction/response rows as question records; answers of ``max_chars`` or more are dropped."""
    answer = F.coalesce(F.col("RESPONSE"), F.lit(""))
    return raw.filter(F.length(answer) < max_chars).select(
        extract_qid("METADATA").alias("qid"), F.lit("").alias("category"),
        F.coalesce("INSTRUCTION", F.lit("")).alias("title"), F.lit("").alias("desc"), answer.alias("answer"),
        "SOURCE", "METADATA", "upvotes",
    )


def convert_instruction_corpus(spark: SparkSession, path: str, out: str, split: str = "train") -> None:
    S.write_jsonl(instruction_records(R.read_corpus_split(spark, path, split)), out)


def merge_corrections(spark: SparkSession, train_path: str, new_path: str, out: str) -> DataFrame:
    """Append reviewed predictions (Question, desc, TRUE/FALSE) to the training table and save it."""
    train = R.read_labeled_tsv(spark, train_path, TEXT, LABEL, missing_as_null=False)
    new = R.require_columns(R.read_table_tsv(spark, new_path), TEXT, "desc", LABEL).select(
        question_with_desc_stripped(TEXT, "desc").alias(TEXT),
        normalize_label(LABEL, "true_false").alias(LABEL),
    )
    merged = union_relabelled([train, new], LABEL)
    S.write_tsv(merged, out, null_text=NEGATIVE)
    return merged
