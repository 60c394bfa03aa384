"""Label policies: how a raw annotation string becomes a label.

The policies disagree on ``Possible``, ``NONE``, ``nan`` and friends on purpose; each call site
names the one it means.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .text import _col, py_strip

# The two label spellings of the labelled tables.
POSITIVE = "Potentially"
NEGATIVE = "None"
# Words counted as true by the ``truthy`` policy.
TRUTHY = ("1", "true", "yes", "y", "potentially", "pos", "positive")

BINARY_POLICIES = ("strict_positive", "non_empty", "non_empty_cs", "truthy", "roc")
TEXT_POLICIES = ("prefix", "fill_none", "true_false")


def normalize_label(c: Column | str, policy: str = "non_empty",
                    positives: Sequence[str] = (POSITIVE,)) -> Column:
    """Apply a named policy. Binary policies give int 0/1, text policies give a label string.

    * ``strict_positive``  1 only for the listed positives (case-insensitive)
    * ``non_empty``        0 for blank/none/nan in any case, else 1
    * ``non_empty_cs``     as above but case-sensitive, so ``NONE`` is 1
    * ``truthy``           1 for the usual words for true
    * ``roc``              0 for blank/none, else 1 (the text ``nan`` counts as 1)
    * ``prefix``           ``Potentially`` if it starts with "potential", else ``None``
    * ``fill_none``        blank/NULL/nan -> ``None``, anything else unchanged
    * ``true_false``       TRUE -> ``Potentially``, FALSE -> ``None``, other -> NULL
    """
    c = _col(c)
    text = F.coalesce(c, F.lit(""))
    stripped = py_strip(text)
    low = F.lower(stripped)
    if policy == "strict_positive":
        return low.isin(*[p.lower() for p in positives]).cast("int")
    if policy == "non_empty":
        return (~low.isin("", "none", "nan")).cast("int")
    if policy == "non_empty_cs":
        return (~stripped.isin("", "None", "none", "nan", "NaN")).cast("int")
    if policy == "truthy":
        return low.isin(*TRUTHY).cast("int")
    if policy == "roc":
        return (~low.isin("", "none")).cast("int")
    if policy == "prefix":
        return F.when(low.startswith("potential"), F.lit(POSITIVE)).otherwise(F.lit(NEGATIVE))
    if policy == "fill_none":
        return F.when(low.isin("", "nan"), F.lit(NEGATIVE)).otherwise(c)
    if policy == "true_false":
        up = F.upper(c)
        return F.when(up == "TRUE", F.lit(POSITIVE)).when(up == "FALSE", F.lit(NEGATIVE))
    raise ValueError(f"unknown label policy: {policy}")


def label_text(binary: Column | str) -> Column:
    """0/1 -> ``None``/``Potentially``."""
    return F.when(_col(binary) == 1, F.lit(POSITIVE)).otherwise(F.lit(NEGATIVE))


def any_hateful(record: Column | str) -> Column:
    """1 when any ``Q<n> hateful`` entry of a string map says hate (any n)."""
    hits = F.exists(
        F.map_entries(_col(record)),
        lambda e: F.regexp_like(e["key"], F.lit(r"(?U)\AQ\d+\s*hateful\z"))
        & (F.lower(py_strip(e["value"])) == "hate"),
    )
    return F.coalesce(hits, F.lit(False)).cast("int")


def has_null_token(record: Column | str) -> Column:
    """True when any value of a string map, stripped and upper-cased, is ``NULL``."""
    return F.coalesce(
        F.exists(F.map_values(_col(record)), lambda v: F.upper(py_strip(v)) == "NULL"),
        F.lit(False),
    )


def hate_with_named_group(record: Column | str, numbers: Sequence[int] = (1, 2, 3)) -> Column:
    """True when some question in ``numbers`` is hateful and its group list lacks ``others``."""
    record = _col(record)
    keep = F.lit(False)
    for n in numbers:
        verdict = F.lower(py_strip(F.try_element_at(record, F.lit(f"Q{n} hateful"))))
        tokens = F.transform(
            F.split(F.try_element_at(record, F.lit(f"Q{n} Group")), ","),
            lambda t: F.lower(py_strip(t)),
        )
        keep = keep | F.coalesce(
            (verdict == "hate") & ~F.array_contains(tokens, "others"), F.lit(False)
        )
    return keep


def keep_span_record(record: Column | str) -> Column:
    """Both record filters together: no NULL token anywhere, and hate against a named group."""
    return ~has_null_token(record) & hate_with_named_group(record)
