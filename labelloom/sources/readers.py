"""Readers for the corpora, lexicons, exclusion lists, score tables and embeddings.

Files are read literally: the text ``None`` stays text. ``functions.text.null_tokens`` is applied
where a reader says so.
"""

from __future__ import annotations

from collections.abc import Sequence
import json
import logging

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import null_tokens, py_strip
from ..operators.ranking import row_ordinal

log = logging.getLogger(__name__)


class MissingColumns(ValueError):
    """The input lacks required columns."""


def require_columns(df: DataFrame, *cols: str) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns {missing}; found {df.columns}")
    return df


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """Fail on an empty frame; reads one row."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def require_same_count(a: DataFrame, b: DataFrame) -> None:
    na, nb = a.count(), b.count()
    if na != nb:
        raise ValueError(f"row counts differ: {na} and {nb}")


def file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return bool(fs.exists(p))


def _delimited(spark: SparkSession, path, sep: str, header: bool, multiline: bool):
    return (
        spark.read.option("sep", sep).option("header", header).option("quote", '"').option("escape", '"')
        .option("multiLine", multiline).option("mode", "PERMISSIVE").option("nullValue", None)
        .option("emptyValue", "")
    )


def read_labeled_tsv(spark: SparkSession, path, text_col: str = "Question",
                     label_col: str = "Potentially_Pejorative", missing_as_null: bool = True,
                     with_row_index: bool = False, multiline: bool = True) -> DataFrame:
    """Header TSV with quoted fields -> the text and label column.

    ``missing_as_null`` maps the spellings of a missing label to NULL and a missing text to ''.
    ``multiline=False`` lets one big file be split, when no field holds a line break.
    """
    df = require_columns(_delimited(spark, path, "\t", True, multiline).csv(path), text_col, label_col)
    if with_row_index:
        df = row_ordinal(df)
    df = df.select(*(["row_index"] if with_row_index else []), text_col, label_col)
    if missing_as_null:
        df = df.withColumn(text_col, F.coalesce(null_tokens(text_col), F.lit(""))).withColumn(
            label_col, null_tokens(label_col)
        )
    return df


def read_headerless_tsv(spark: SparkSession, path, names: Sequence[str] = ("sentence", "label"),
                        header_words: Sequence[str] = ("question", "Potentially_Pejorative"),
                        multiline: bool = True) -> DataFrame:
    """Two columns without a header, literals kept, rows that look like a header dropped."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = _delimited(spark, path, "\t", False, multiline).schema(schema).csv(path).fillna("")
    return without_header_rows(df, *names, header_words)


def without_header_rows(df: DataFrame, text: str, label: str,
                        header_words: Sequence[str] = ("question", "Potentially_Pejorative")) -> DataFrame:
    """Rows whose fields do not read like a header."""
    headerish = (F.lower(py_strip(text)) == header_words[0]) | (py_strip(label) == header_words[1])
    return df.filter(~headerish)


# blanks of JSON and the byte-order mark
_LEAD = r" \t\r\n\uFEFF"


def _scanner(spark: SparkSession, path: str):
    fs, p = file_system(spark, path)
    return spark._jvm.java.util.Scanner(fs.open(p), "UTF-8")


def _first_character(spark: SparkSession, path: str) -> str:
    """The file's first character that is no blank; '' if there is none. Reads up to it, however far that is."""
    scanner = _scanner(spark, path)
    try:
        return scanner.findWithinHorizon(f"[^{_LEAD}]", 0) or ""
    finally:
        scanner.close()


def _is_array_file(spark: SparkSession, path: str) -> bool:
    return _first_character(spark, path) == "["


def _files(spark: SparkSession, path: str) -> list[str]:
    fs, p = file_system(spark, path)
    found = fs.globStatus(p)
    out: list[str] = []
    for status in found or []:
        if status.isDirectory():
            out += [str(s.getPath().toString()) for s in fs.listStatus(status.getPath())
                    if not s.isDirectory() and not s.getPath().getName().startswith(("_", "."))]
        else:
            out.append(str(status.getPath().toString()))
    return sorted(out)


def without_mark(col: str) -> Column:
    return F.regexp_replace(col, "^\uFEFF", "")


def array_objects(texts: DataFrame, col: str = "value", strict: bool = True) -> DataFrame:
    """Whole JSON arrays in ``col`` -> one row ``json`` per element that is an object; other elements are dropped.

    A text that is no array is an error, or gives no rows if not ``strict``.
    """
    items = F.from_json(without_mark(col), "array<string>", {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    return texts.select(F.explode(items).alias("json")).filter(F.col("json").startswith("{"))


def _is_one_object(col: str) -> Column:
    """The text is one JSON object and nothing else."""
    inside = F.from_json(F.concat(F.lit("["), col, F.lit("]")), "array<string>")
    return F.coalesce(F.col(col).startswith("{") & (F.size(inside) == 1), F.lit(False))


def line_objects(lines: DataFrame, col: str = "value") -> DataFrame:
    """One row ``json`` per line that is a JSON object; blank, bad and other lines are dropped."""
    return lines.select(py_strip(without_mark(col)).alias("json")).filter(_is_one_object("json"))


def broken_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """The lines that are neither blank nor JSON."""
    json = py_strip(without_mark(col))
    parsed = F.from_json(F.concat(F.lit("["), json, F.lit("]")), "array<string>")
    return lines.filter((json != "") & (F.coalesce(F.size(parsed), F.lit(0)) != 1))


def _last_of_each_key(record: Column) -> Column:
    """A map whose repeated keys keep their last value."""
    entries = F.map_entries(record)
    later = lambda i: F.slice(entries, i + 2, F.size(entries))
    kept = F.filter(entries, lambda e, i: ~F.exists(later(i), lambda x: x["key"] == e["key"]))
    keys = F.map_keys(record)
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), record).otherwise(F.map_from_entries(kept))


def typed_objects(objects: DataFrame, schema: str | T.DataType) -> DataFrame:
    """``json`` -> typed columns, or one ``record`` column for a map schema; of a repeated key the last value counts."""
    parsed = objects.select(F.from_json("json", schema if isinstance(schema, str) else schema.json()).alias("record"))
    if isinstance(parsed.schema["record"].dataType, T.MapType):
        return parsed.select(_last_of_each_key(F.col("record")).alias("record"))
    return parsed.select("record.*")


def read_json_any(spark: SparkSession, path: str, schema: str, missing_ok: bool = False,
                  strict_arrays: bool = True, fmt: str = "auto") -> DataFrame:
    """JSON-array files and JSONL files, told apart by their first non-blank character.

    Bad lines and elements that are not objects are dropped; an array file that does not parse is an error, unless
    ``strict_arrays`` is off. ``schema`` is DDL, or a map type such as ``map<string,string>`` for records with varying keys
    (one ``record`` column). ``missing_ok`` turns an absent path into an empty frame. ``fmt="lines"`` or ``"array"`` skips
    the look into every file, for directories of very many files; lines are split across tasks, an array file is one
    task's work.
    """
    files = _files(spark, path)
    if not files:
        if missing_ok:
            return typed_objects(spark.createDataFrame([], "json string"), schema)
        raise FileNotFoundError(path)
    if fmt == "auto":
        arrays = [f for f in files if _is_array_file(spark, f)]
    else:
        arrays = files if fmt == "array" else []
    return typed_objects(_objects(spark, arrays, [f for f in files if f not in set(arrays)], strict_arrays), schema)


def _objects(spark: SparkSession, arrays: list[str], lines: list[str], strict: bool = True) -> DataFrame:
    out = spark.createDataFrame([], "json string")
    if arrays:
        out = out.unionByName(array_objects(spark.read.text(arrays, wholetext=True), strict=strict))
    if lines:
        out = out.unionByName(line_objects(spark.read.text(lines)))
    return out


def read_records_or_single(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``read_json_any``, but a file holding one (pretty-printed) object is one row, a missing file none, and an array
    file that does not parse is read as lines."""
    arrays, lines, singles = [], [], []
    for f in _files(spark, path):
        first = _first_character(spark, f)
        (arrays if first == "[" else singles if first == "{" and _spans_lines(spark, f) else lines).append(f)
    if arrays:
        whole = spark.read.text(arrays, wholetext=True).select(
            F.col("_metadata.file_path").alias("f"),
            F.from_json(without_mark("value"), "array<string>").isNull().alias("bad"))
        bad = {r["f"] for r in whole.filter("bad").collect()}  # names of files
        as_lines = [f for f in arrays if any(f.rpartition("/")[2] == b.rpartition("/")[2] for b in bad)]
        arrays, lines = [f for f in arrays if f not in as_lines], lines + as_lines
    out = _objects(spark, arrays, lines)
    if singles:
        whole = spark.read.text(singles, wholetext=True).select(py_strip(without_mark("value")).alias("json"))
        out = out.unionByName(whole.filter(_is_one_object("json")))
    return typed_objects(out, schema)


def _spans_lines(spark: SparkSession, path: str) -> bool:
    """The file's first non-blank line is not a complete JSON value."""
    scanner = _scanner(spark, path)
    try:
        while scanner.hasNextLine():
            line = scanner.nextLine().lstrip("\ufeff").strip()
            if line:
                json.loads(line)
                return False
        return False
    except json.JSONDecodeError:
        return True
    finally:
        scanner.close()


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line`` of the lines of JSONL files that do not parse; array files have no lines."""
    files = [f for f in _files(spark, path) if not _is_array_file(spark, f)]
    if not files:
        return spark.createDataFrame([], "file string, line string")
    lines = spark.read.text(files).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return broken_lines(lines, "line")


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSONL in which any bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_array_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array file that has to parse as a whole."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def read_embeddings(spark: SparkSession, path: str, labelled: bool = False) -> DataFrame:
    """Parquet with ``row_id, embedding`` and, when ``labelled``, a complete ``label``."""
    df = require_columns(spark.read.parquet(path), "row_id", "embedding", *(["label"] if labelled else []))
    if labelled and not df.filter(F.col("label").isNull()).isEmpty():
        raise ValueError("training embeddings must all carry a label")
    return df


def read_exclusions(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Distinct ``row_index`` over several CSVs; absent files, absent columns and bad numbers are skipped."""
    out = spark.createDataFrame([], "row_index long")
    for path in paths:
        if not path:
            continue
        if not exists(spark, path):
            log.warning("exclusion file not found: %s", path)
            continue
        df = _delimited(spark, path, ",", True, True).csv(path)
        if "row_index" not in df.columns:
            log.warning("exclusion file %s has no row_index column", path)
            continue
        out = out.unionByName(exclusion_rows(df))
    return out.distinct()


def exclusion_rows(df: DataFrame, col: str = "row_index") -> DataFrame:
    """Distinct whole ``row_index`` numbers; what is no number is skipped."""
    number = F.col(col).try_cast("double").cast("long").alias("row_index")
    return df.select(number).filter(F.col("row_index").isNotNull()).distinct()


LEXICON_FIELDS = "term string, definition string, category string"


def lexicon_terms(documents: DataFrame, col: str = "value") -> DataFrame:
    """Lexicon documents -> ``term, definition, category, ordinal, entry``: one row per entry with a non-blank term.

    ``ordinal`` is the entry's place and ``entry`` the whole of it, so that ``write_lexicon`` loses no field and no order.
    """
    terms = F.from_json(without_mark(col), "terms array<string>")["terms"]
    rows = documents.select(F.posexplode(terms).alias("ordinal", "entry")).filter(F.col("entry").startswith("{"))
    rows = rows.withColumn("t", F.from_json("entry", LEXICON_FIELDS))
    return rows.select("t.*", F.col("ordinal").cast("bigint").alias("ordinal"), "entry").filter(
        py_strip(F.coalesce("term", F.lit(""))) != "")


def lexicon_head(documents: DataFrame, col: str = "value") -> DataFrame:
    """``head``: the other top-level keys of each document as one JSON object."""
    keys = F.from_json(without_mark(col), "map<string,variant>")
    return documents.select(F.coalesce(F.to_json(F.map_filter(keys, lambda k, v: k != "terms")), F.lit("{}")).alias("head"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``term, definition, category, ordinal, entry`` of a lexicon file."""
    return lexicon_terms(spark.read.text(path, wholetext=True))


def read_lexicon_head(spark: SparkSession, path: str) -> dict:
    """Top-level keys of a lexicon file other than its terms."""
    row = lexicon_head(spark.read.text(path, wholetext=True)).first()
    return json.loads(row["head"]) if row else {}


def read_prompt(spark: SparkSession, path: str) -> str:
    """A whole (small) prompt file as one string."""
    return spark.read.text(path, wholetext=True).first()["value"]


def read_corpus_split(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """One split of a Parquet corpus laid out as ``<path>/<split>/``."""
    return spark.read.parquet(f"{path.rstrip('/')}/{split}")


def read_score_table(spark: SparkSession, path, label_col: str = "Potentially_Pejorative",
                     multiline: bool = True) -> DataFrame:
    """Wide TSV of scores next to a text and a label column; scores stay text until they are used."""
    return require_columns(_delimited(spark, path, "\t", True, multiline).csv(path), label_col)


def read_table_tsv(spark: SparkSession, path, multiline: bool = True) -> DataFrame:
    """Any header TSV, all columns as text."""
    return _delimited(spark, path, "\t", True, multiline).csv(path)
