"""Text cleaning expressions.

``None``/``nan`` handling lives here and nowhere else: files are read literally and
``null_tokens`` decides which spellings mean "missing".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The characters str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Spellings of a missing value, compared after strip + lower.
NULL_TOKENS = ("", "none", "nan", "null", "na", "n/a")
IDEOGRAPHIC_SPACE = "\u3000"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """Strip like ``str.strip()``: tabs, newlines and U+3000 too, not only U+0020."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def null_tokens(c: Column | str) -> Column:
    """NULL for any spelling of a missing value, the unchanged text otherwise."""
    c = _col(c)
    return F.when(F.lower(py_strip(c)).isin(*NULL_TOKENS), F.lit(None)).otherwise(c)


def is_missing_title(c: Column | str) -> Column:
    """True for NULL, blank, ``none`` and ``nan`` (narrower than ``null_tokens``)."""
    c = _col(c)
    return c.isNull() | F.lower(py_strip(c)).isin("", "none", "nan")


def sanitize(c: Column | str) -> Column:
    """NULL -> '', control characters -> visible ``\\t`` ``\\r`` ``\\n``, then strip."""
    out = F.coalesce(_col(c).cast("string"), F.lit(""))
    for raw, shown in (("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return py_strip(out)


def sanitize_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Sanitise the listed columns that exist; by default every scalar column.

    Nested columns (array, map, struct) are left alone.
    """
    nested = (T.ArrayType, T.MapType, T.StructType)
    scalar = [f.name for f in df.schema.fields if not isinstance(f.dataType, nested)]
    chosen = scalar if cols is None else [c for c in cols if c in df.columns]
    return df.withColumns({c: sanitize(F.col(f"`{c}`")) for c in chosen})


def normalize_spaces(c: Column | str) -> Column:
    """Ideographic space -> plain space, then strip."""
    return py_strip(F.replace(_col(c), F.lit(IDEOGRAPHIC_SPACE), F.lit(" ")))


def join_nonempty(cols: Sequence[Column | str], sep: str = " ") -> Column:
    """Sanitised columns, empty ones dropped, joined in the given order."""
    parts = F.array(*[sanitize(c) for c in cols])
    return F.array_join(F.filter(parts, lambda p: p != F.lit("")), sep)


def question_with_desc(question: Column | str, desc: Column | str) -> Column:
    """``question + ' ' + desc``; an empty desc leaves the trailing blank in place."""
    return F.concat(_col(question), F.lit(" "), F.coalesce(_col(desc), F.lit("")))


def question_with_desc_stripped(question: Column | str, desc: Column | str) -> Column:
    """Both sides stripped, joined by one blank, stripped again."""
    q = py_strip(F.coalesce(_col(question), F.lit("")))
    d = py_strip(F.coalesce(_col(desc), F.lit("")))
    return py_strip(F.concat(q, F.lit(" "), d))


def question_with_context(question: Column | str, context: Column | str) -> Column:
    """``question`` directly followed by ``context``; a NULL context adds nothing."""
    return F.concat(_col(question), F.coalesce(_col(context), F.lit("")))


def first_text(df: DataFrame, preferred: Sequence[str] = ("text", "content", "Question")) -> Column:
    """First non-empty of the preferred columns that exist, else the frame's first column, else ''."""
    names = [c for c in preferred if c in df.columns] + df.columns[:1]
    picks = [F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names]
    return F.coalesce(*picks, F.lit(""))


def category_column_name(c: Column | str) -> Column:
    """Category display name -> column name with the ``_confidence`` suffix."""
    out = _col(c)
    for raw, safe in ((" ", "_"), ("&", "and"), (",", ""), ("/", "_")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return F.concat(out, F.lit("_confidence"))


def extract_qid(metadata: Column | str, field: str = "question_id") -> Column:
    """``question_id`` of a JSON string as text; ``12.0`` -> ``12``; bad or missing -> ''."""
    raw = F.get_json_object(_col(metadata), f"$.{field}")
    return F.coalesce(F.regexp_replace(raw, r"^(-?\d+)\.0+$", "$1"), F.lit(""))


def tolerant_int(c: Column | str) -> Column:
    """``int(float(x))`` for anything numeric, 0 for everything else (NaN and infinity too)."""
    as_double = _col(c).cast("string").try_cast("double")
    return F.coalesce(F.when(~F.isnan(as_double), as_double).try_cast("int"), F.lit(0))


def contains_any(c: Column | str, phrases: Sequence[str]) -> Column:
    """True when any of the (few, caller-supplied) phrases occurs literally."""
    c = _col(c)
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.contains(c, F.lit(p))
    return hit
