"""The stateless operators on unbounded input: label normalisation and answer parsing.

Both are row-local, so they need no watermark and no state; the sink writes in append mode and the
checkpoint location makes a restart exactly-once for file sinks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.answers import parse_answers
from ..functions.labels import normalize_label


def read_answer_stream(spark: SparkSession, path: str,
                       schema: str = "idx string, prompt_name string, text string, raw_output string",
                       files_per_trigger: int = 1000) -> DataFrame:
    """JSONL answer logs as they arrive in a directory."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def parsed_answers(stream: DataFrame, raw: str = "raw_output") -> DataFrame:
    return parse_answers(stream, raw).drop("parsed")


def relabelled(stream: DataFrame, label: str, policy: str = "fill_none") -> DataFrame:
    return stream.withColumn(label, normalize_label(label, policy))


def append_parquet(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append to a Parquet table; ``once`` drains what is there and stops."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)
