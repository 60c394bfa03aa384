"""The parsing and rendering cores of sources and sinks, fed with text made from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources import readers as R, sinks as S
from .base import query, table


def _records(spark, d) -> DataFrame:
    """Documents as JSON texts with a repeated key, whose last value counts."""
    body = F.to_json(F.struct(F.col("text").alias("title"), F.col("lang").alias("desc"), "doc_id"))
    first = F.concat(F.lit('{"doc_id": -1, '), F.substr(body, F.lit(2)))
    return table(spark, d, "documents").select("doc_id", first.alias("json"))


@query("json_lines_parsed", """SELECT doc_id::VARCHAR AS doc_id, text AS title, lang AS "desc"
FROM documents WHERE doc_id % 7 <> 3 AND doc_id % 11 <> 5""")
def json_lines_parsed(spark, d) -> DataFrame:
    """One line per document; some are cut off, some are no objects, some carry a byte-order mark."""
    k = F.col("doc_id")
    line = (F.when(k % 7 == 3, F.substr("json", F.lit(1), F.length("json") - 1))
            .when(k % 11 == 5, F.concat(F.lit("["), "json", F.lit("]")))
            .when(k % 13 == 1, F.concat(F.lit("\ufeff "), "json")).otherwise(F.col("json")))
    lines = _records(spark, d).select(line.alias("value"))
    return R.typed_objects(R.line_objects(lines), "doc_id string, title string, desc string")


@query("json_broken_lines", "SELECT doc_id::VARCHAR AS doc_id FROM documents WHERE doc_id % 7 = 3")
def json_broken_lines(spark, d) -> DataFrame:
    """The quarantine: lines that are neither blank nor JSON."""
    cut = F.when(F.col("doc_id") % 7 == 3, F.substr("json", F.lit(1), F.length("json") - 1)).when(
        F.col("doc_id") % 5 == 0, F.lit("  ")).otherwise(F.col("json"))
    lines = _records(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), cut.alias("value"))
    return R.broken_lines(lines).select("doc_id")


@query("json_array_parsed", """SELECT doc_id::VARCHAR AS doc_id, text AS title, lang AS "desc", '12.0' AS score FROM documents""")
def json_array_parsed(spark, d) -> DataFrame:
    """Arrays of up to a hundred documents each, with elements that are no objects between them."""
    json = F.concat(F.lit('{"score": 12.0, '), F.substr("json", F.lit(2)))
    texts = _records(spark, d).groupBy(F.floor(F.col("doc_id") / 100).alias("g")).agg(
        F.concat(F.lit("\ufeff [5, "), F.array_join(F.collect_list(json), ", [1], "), F.lit(", null]")).alias("value"))
    return R.typed_objects(R.array_objects(texts), "doc_id string, title string, desc string, score string")


@query("record_maps_parsed", "SELECT doc_id::VARCHAR AS doc_id, text AS title, 3 AS fields FROM documents")
def record_maps_parsed(spark, d) -> DataFrame:
    """Records with varying keys as maps."""
    maps = R.typed_objects(R.line_objects(_records(spark, d), "json"), "map<string,string>")
    return maps.select(F.col("record")["doc_id"].alias("doc_id"), F.col("record")["title"].alias("title"), F.size("record").alias("fields"))


@query("jsonl_rendered", """SELECT to_json({'conv_id': conv_id, 'turn': turn, 'role': role, 'nothing': NULL, 'text': text})::VARCHAR AS value
FROM conversations""")
def jsonl_rendered(spark, d) -> DataFrame:
    return S.jsonl_lines(table(spark, d, "conversations").select(
        "conv_id", "turn", "role", F.lit(None).cast("string").alias("nothing"), "text"))


@query("lexicon_round_trip", """SELECT item_id // 20 AS version, item_id AS id, trim(text, ' ' || chr(10)) AS term,
  row_number() OVER (PARTITION BY item_id // 20 ORDER BY item_id) - 1 AS ordinal FROM benchmark WHERE trim(text, ' ' || chr(10)) <> ''""")
def lexicon_round_trip(spark, d) -> DataFrame:
    """Lexicon documents of up to twenty terms with a field the library does not know, read, written and read again."""
    entry = F.to_json(F.struct(F.trim(F.translate("text", "\n", " ")).alias("x"), F.col("text").alias("term"), F.col("item_id").alias("id"),
                               (F.col("item_id") / 20).cast("bigint").alias("version")))
    pairs = F.array_sort(F.collect_list(F.struct("item_id", entry.alias("e"))))
    documents = table(spark, d, "benchmark").groupBy(F.floor(F.col("item_id") / 20).alias("g")).agg(
        F.concat(F.lit('{"version": '), F.col("g"), F.lit(', "terms": ['), F.array_join(F.transform(pairs, lambda p: p["e"]), ","),
                 F.lit("]}")).alias("value"))
    again = S.lexicon_document(R.lexicon_terms(documents).withColumn("version", F.get_json_object("entry", "$.version").cast("bigint")),
                               {"version": 1}, by="version")
    terms = R.lexicon_terms(again.select("value"))
    version = F.get_json_object("entry", "$.version").cast("bigint")
    return terms.select(version.alias("version"), F.get_json_object("entry", "$.id").cast("bigint").alias("id"),
                        F.trim(F.col("term"), F.lit(" \n")).alias("term"), "ordinal")


@query("header_rows_dropped", "SELECT doc_id FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 10 <> 1")
def header_rows_dropped(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 9 == 0, F.lit(" Question ")).otherwise(F.col("text")).alias("sentence"),
        F.when(F.col("doc_id") % 10 == 1, F.lit("Potentially_Pejorative ")).otherwise(F.lit("None")).alias("label"))
    return R.without_header_rows(rows, "sentence", "label").select("doc_id")


@query("exclusions_parsed", """SELECT DISTINCT doc_id // 3 AS row_index FROM documents WHERE doc_id % 4 < 2""")
def exclusions_parsed(spark, d) -> DataFrame:
    """Row numbers as text: whole, with a fraction of zero, no numbers, and missing."""
    k = F.floor(F.col("doc_id") / 3).cast("string")
    text = (F.when(F.col("doc_id") % 4 == 0, k).when(F.col("doc_id") % 4 == 1, F.concat(k, F.lit(".0")))
            .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("row "), k)))
    return R.exclusion_rows(table(spark, d, "documents").select(text.alias("row_index")))
