"""Sinks. Every sink writes a directory of part files, one per task."""

from __future__ import annotations

from collections.abc import Callable, Sequence
import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .readers import exists, read_table_tsv


def _flat(df: DataFrame, float_format: str | None, null_text: str | None) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if float_format and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(c.isNotNull(), F.format_string(float_format, c))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.BooleanType):
            c = F.when(c, F.lit("True")).when(~c, F.lit("False"))
        if null_text is not None:
            c = F.coalesce(c.cast("string"), F.lit(null_text))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_tsv(df: DataFrame, path: str, float_format: str | None = None, null_text: str | None = None,
              mode: str = "overwrite") -> None:
    """Tab-separated with header, quotes only where needed; ``null_text`` is written for NULL."""
    (
        _flat(df, float_format, null_text).write.mode(mode).option("sep", "\t").option("header", True)
        .option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    (
        _flat(df, None, None).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
        .option("emptyValue", "").option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def write_issue_report(report: DataFrame, path: str) -> None:
    """The full report and, next to it, the suspicious rows only."""
    from ..operators.audit import ranked_report, suspicious_only

    write_csv(ranked_report(report), f"{path}/label_issues")
    write_csv(suspicious_only(report), f"{path}/suspicious_only")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object per line, NULL fields kept, text as UTF-8."""
    jsonl_lines(df).write.mode(mode).text(path)


def jsonl_lines(df: DataFrame) -> DataFrame:
    """``value``: each row as one JSON object with all its fields."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_embeddings(df: DataFrame, path: str, embedding_model: str, source: str, fmt: str,
                     text_cols: Sequence[str], mode: str = "overwrite") -> None:
    """Parquet with the vectors as ``array<float>`` and their provenance as constant columns."""
    df.withColumns({
        "embedding": F.col("embedding").cast("array<float>"),
        "embedding_model": F.lit(embedding_model), "source": F.lit(source), "format": F.lit(fmt),
        "text_cols": F.array(*[F.lit(c) for c in text_cols]),
    }).write.mode(mode).parquet(path)


def write_split(df: DataFrame, path: str, flag: str = "predicted_label") -> None:
    """All rows, and the positive rows only. The second output reads the first back instead of rescoring."""
    write_jsonl(df, f"{path}/augmented")
    spark = df.sparkSession
    back = spark.read.schema(df.schema).json(f"{path}/augmented")
    write_jsonl(back.filter(flag), f"{path}/possibly")


def materialize(df: Callable[[], DataFrame] | DataFrame, path: str, spark: SparkSession | None = None,
                overwrite: bool = False) -> DataFrame:
    """Read-through stage: load the Parquet at ``path`` if it is complete, otherwise compute and save it."""
    spark = spark or (df.sparkSession if isinstance(df, DataFrame) else SparkSession.active())
    if overwrite or not exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        (df if isinstance(df, DataFrame) else df()).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: attempts of a writer that others keep overtaking
_ATTEMPTS = 50


def upsert_tsv(spark: SparkSession, path: str, row_key: str, updates: DataFrame) -> str:
    """Add or replace result rows in a versioned TSV table; returns the new version's directory.

    The rows are written beside the table first. A version comes about by creating its commit file, which only one writer can do;
    another one that read the same version before reads again and applies its rows to the newer one. Readers of old versions are
    not disturbed, and a writer that dies leaves nothing that ``latest_version`` sees.
    """
    from ..operators.joins import upsert
    from .readers import file_system

    base = path.rstrip("/")
    for _ in range(_ATTEMPTS):
        number, last = _newest(spark, path)
        out = updates
        if last:
            out = upsert(read_table_tsv(spark, last), updates.select(*[F.col(f"`{c}`").cast("string").alias(c)
                                                                       for c in updates.columns]), row_key)
        else:
            out = updates.select(row_key, *sorted(c for c in updates.columns if c != row_key))
        target = f"{base}/data-{uuid.uuid4().hex}"
        write_tsv(out, target, mode="error")
        if _create(spark, f"{base}/_commits/{number + 1:06d}", target.rpartition("/")[2]):
            return target
        fs, p = file_system(spark, target)
        fs.delete(p, True)
    raise RuntimeError(f"{path}: overtaken by other writers {_ATTEMPTS} times")


def _create(spark: SparkSession, path: str, content: str) -> bool:
    """Create the file with this content unless it exists; False if it does. One of several writers at once succeeds."""
    from .readers import file_system

    fs, p = file_system(spark, path)
    fs.mkdirs(p.getParent())
    if fs.getUri().getScheme() == "file":  # Hadoop's local file system only looks before it writes
        name = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath()
        whole = f"{name}.{uuid.uuid4().hex}.part"
        with open(whole, "w", encoding="utf-8") as f:
            f.write(content)
        try:
            os.link(whole, name)  # whole or not at all
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(whole)
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception) or fs.exists(p):
            return False
        raise
    out.write(bytearray(content.encode()))
    out.close()
    return True


def _newest(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number and directory of the last version."""
    from .readers import file_system

    fs, p = file_system(spark, f"{path.rstrip('/')}/_commits")
    numbers = sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.isdigit()) if fs.exists(p) else []
    if not numbers:
        return 0, None
    text = spark.read.text(f"{path.rstrip('/')}/_commits/{numbers[-1]}").first()
    return int(numbers[-1]), f"{path.rstrip('/')}/{text[0]}"


def latest_version(spark: SparkSession, path: str) -> str | None:
    return _newest(spark, path)[1]


def write_metrics(df: DataFrame, path: str, first: str = "prompt_name") -> None:
    """Metric rows with the name column first."""
    write_tsv(df.select(first, *[F.col(f"`{c}`") for c in df.columns if c != first]), path)


def lexicon_document(terms: DataFrame, other: dict | None = None, by: str | None = None) -> DataFrame:
    """``value``: one JSON object, the other top-level keys unchanged and ``terms`` in their order; with ``by`` one for each value
    of that column, which stays beside it, so that a large lexicon is many documents of bounded size.

    ``entry`` (the whole term as read) is written where it exists, and ``ordinal`` gives the order; without them the
    known fields are written, ordered by their text.
    """
    fields = [c for c in ("term", "definition", "category") if c in terms.columns]
    entry = F.col("entry") if "entry" in terms.columns else F.to_json(F.struct(*fields))
    place = F.col("ordinal") if "ordinal" in terms.columns else F.lit(0).cast("bigint")
    pairs = F.array_sort(F.collect_list(F.struct(place.alias("p"), entry.alias("e"))))
    head = json.dumps(other or {}, ensure_ascii=False)[:-1]
    comma = ", " if other else ""
    listed = F.array_join(F.transform(pairs, lambda x: x["e"]), ",")
    grouped = terms if by is None else terms.groupBy(by)
    return grouped.agg(F.concat(F.lit(f"{head}{comma}\"terms\": ["), listed, F.lit("]}")).alias("value"))


def write_lexicon(terms: DataFrame, path: str, other: dict | None = None, bytes_limit: int = 256 << 20) -> None:
    """``lexicon_document`` as a file. The format is a single document, so its size is checked before it is assembled."""
    fields = [c for c in ("term", "definition", "category") if c in terms.columns]
    entry = F.col("entry") if "entry" in terms.columns else F.to_json(F.struct(*fields))
    size = terms.agg(F.coalesce(F.sum(F.octet_length(entry)), F.lit(0))).first()[0]
    if size > bytes_limit:
        raise ValueError(f"lexicon of {size} bytes is too large for one JSON document")
    lexicon_document(terms, other).write.mode("overwrite").text(path)


def write_run_config(spark: SparkSession, config: dict, path: str) -> None:
    """The run's parameters as one JSON object."""
    text = json.dumps(config, ensure_ascii=False, sort_keys=True)
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(path)
