"""Parsing free-form model answers into label sets, as column expressions.

The tolerant JSON step tries, in order: the text as it is; the text from its first bracket on, without code
fences; the part up to its last bracket; trailing commas removed; open strings and brackets closed, innermost
first and not counting those inside strings; missing commas inserted; single quotes turned into double quotes.
Single-quoted strings and keys without quotes are read as such. Of a repeated key the last value counts. The last
resort picks the last ``groups`` list out by pattern.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .labelsets import TOPIC_IDS
from .text import _col, py_strip
from .vectors import let

# Answer markers.
OPEN_TAG = "<final_answer>"
CLOSE_TAG = "</final_answer>"
# Error texts of the answer log.
ERR_EMPTY = "empty or non-string output"
ERR_NOT_OBJECT = "parsed JSON is not an object (no 'groups' field)"
ERR_NOT_LIST = "'groups' field is not a list"
ERR_COMPLETION = "completion error: "


def strip_answer_tags(c: Column | str) -> Column:
    """Text between the first open tag and the last close tag, stripped; whole text if a tag is missing."""
    s = F.coalesce(_col(c).cast("string"), F.lit(""))
    start = F.instr(s, OPEN_TAG)
    after_last_close = F.substring_index(s, CLOSE_TAG, -1)
    close_at = F.length(s) - F.length(after_last_close) - len(CLOSE_TAG) + 1
    body_at = start + len(OPEN_TAG)
    inner = F.substring(s, body_at, F.greatest(close_at - body_at, F.lit(0)))
    tagged = (start > 0) & F.contains(s, F.lit(CLOSE_TAG))
    return py_strip(F.when(tagged, inner).otherwise(s))


def first_message_field(*fields: Column | str) -> Column:
    """First field that is not blank, returned unstripped; '' when all are blank."""
    usable = [F.when(py_strip(_col(f)) != "", _col(f)) for f in fields]
    return F.coalesce(*usable, F.lit(""))


def user_message(text: Column | str, prefix: str = "文本: ") -> Column:
    """Text with the user-message prefix."""
    return F.concat(F.lit(prefix), _col(text))


def _close_open_parts(s: Column) -> Column:
    """Finish an open string, drop a dangling comma or colon, and close open brackets in the order they were opened."""
    start = F.struct(F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit("").alias("open"))

    def step(state: Column, ch: Column) -> Column:
        quoted, escaped, open_ = state["quoted"], state["escaped"], state["open"]
        outside = ~quoted & ~escaped
        stack = (F.when(outside & (ch == "["), F.concat(F.lit("]"), open_)).when(outside & (ch == "{"), F.concat(F.lit("}"), open_))
                 .when(outside & ch.isin("]", "}") & F.startswith(open_, ch), F.substring(open_, 2, 1 << 20)).otherwise(open_))
        return F.struct(
            F.when(~escaped & (ch == '"'), ~quoted).otherwise(quoted).alias("quoted"),
            (quoted & ~escaped & (ch == "\\")).alias("escaped"), stack.alias("open"))

    def finish(end: Column) -> Column:
        body = F.when(end["quoted"], F.concat(s, F.lit('"'))).otherwise(F.regexp_replace(s, r"[,:\s]+$", ""))
        return F.concat(body, end["open"])

    return F.aggregate(F.split(s, ""), start, step, finish)


def json_value(c: Column) -> Column:
    """The text as one JSON value in its usual notation, or NULL."""
    items = F.from_json(F.concat(F.lit("["), c, F.lit("]")), "array<string>",
                        {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true"})
    return F.when(F.size(items) == 1, items[0])


def tolerant_json(c: Column | str) -> Column:
    """Answer text (tags already stripped) -> JSON text, or NULL when nothing JSON-like is found.

    Each repair is only evaluated when the ones before it failed.
    """
    def groups_only(t: Column) -> Column:
        lists = F.regexp_extract_all(t, F.lit(r'"groups"\s*:\s*(\[[^\]]*\])'), F.lit(1))
        return json_value(F.concat(F.lit('{"groups":'), F.try_element_at(lists, F.lit(-1)), F.lit("}")))

    def closed(t: Column) -> Column:
        return json_value(_close_open_parts(t))

    def requoted(t: Column) -> Column:
        return F.coalesce(closed(t), groups_only(t))

    def repaired(cut: Column) -> Column:
        tidy = F.regexp_replace(cut, r",(\s*[\]}])", "$1")
        spaced = F.regexp_replace(tidy, r"([\"\]}\d])(\s+)(?=[\"\[{])", "$1,$2")
        whole = F.regexp_extract(cut, r"(?s)^(.*[\]}])", 1)
        return F.when(cut != "", F.coalesce(
            json_value(cut), json_value(tidy), json_value(F.when(whole != "", whole)), closed(tidy), closed(spaced),
            let(F.replace(tidy, F.lit("'"), F.lit('"')), requoted)))

    s = _col(c)
    from_bracket = F.regexp_extract(F.regexp_replace(s, r"```[A-Za-z]*", ""), r"(?s)([\[{].*)", 1)
    return F.coalesce(json_value(s), let(from_bracket, repaired))


def parse_answers(df: DataFrame, raw: str = "raw_output", label_ids: Sequence[str] = TOPIC_IDS,
                  keep_unknown: bool = False) -> DataFrame:
    """Add ``parsed`` (variant), ``groups`` (array), ``error`` and ``error_msg``.

    Known ids are kept in order with their duplicates; ``keep_unknown`` keeps every non-blank id.
    A missing ``groups`` key is an empty answer, not an error.
    """
    blank = py_strip(F.coalesce(F.col(raw), F.lit(""))) == ""
    staged = df.withColumn("_json", F.when(~blank, strip_answer_tags(raw)))
    staged = staged.withColumn("_json", tolerant_json("_json")).withColumn("parsed", F.try_parse_json("_json"))
    # numbers keep their notation, and the last of repeated keys counts, in text but not in a variant
    inner = F.from_json("_json", "groups string")["groups"]
    inner_kind = F.schema_of_variant(F.try_variant_get("parsed", "$.groups", "variant"))  # of a JSON null: VOID
    is_list = F.coalesce(inner_kind.startswith("ARRAY"), inner.startswith("["), F.lit(False))
    staged = staged.withColumn(
        "error_msg",
        F.when(blank, F.lit(ERR_EMPTY))
        .when(F.col("_json").isNull() | ~F.col("_json").startswith("{"), F.lit(ERR_NOT_OBJECT))
        .when((inner_kind.isNotNull() | inner.isNotNull()) & ~is_list, F.lit(ERR_NOT_LIST))
        .otherwise(F.lit("")),
    )
    items = F.transform(
        F.from_json("_json", "groups array<string>")["groups"],
        lambda g: py_strip(F.coalesce(g, F.lit("None"))),
    )
    keep = (lambda g: g != "") if keep_unknown else (lambda g: g.isin(*label_ids))
    groups = F.when(F.col("error_msg") == "", F.filter(items, keep))
    return (
        staged.withColumn("groups", F.coalesce(groups, F.array().cast("array<string>")))
        .withColumn("error", F.col("error_msg") != "")
        .drop("_json")
    )
