"""One annotated record -> its training examples for several tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _example(task: str, x: Column, y: Column | str, condition: Column | None = None) -> Column:
    item = F.struct(F.lit(task).alias("task"), x.alias("x"),
                    (F.lit(y) if isinstance(y, str) else y).alias("y"))
    return item if condition is None else F.when(condition, item)


def _with_default(name: str, default: str) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def six_tasks(df: DataFrame, key: str) -> DataFrame:
    """``key, task, x, y`` for the six promise/evidence tasks.

    A promised record with a promise snippet gives two positives; a promised record without one
    gives none. The snippet tasks take the record's text as x.
    """
    text = _with_default("extracted_text", "")
    promise, evidence = _with_default("promise_status", "No"), _with_default("evidence_status", "No")
    promise_str, evidence_str = _with_default("promise_string", ""), _with_default("evidence_string", "")
    yes = promise == "Yes"
    has_promise = yes & (promise_str != "")
    ev_yes = yes & (evidence == "Yes")
    has_evidence = ev_yes & (evidence_str != "")
    examples = F.array(
        _example("promise_status", text, "Yes", has_promise),
        _example("promise_status", promise_str, "Yes", has_promise),
        _example("promise_status", text, promise, ~yes),
        _example("promise_string", text, promise_str, has_promise),
        _example("evidence_status", text, "Yes", has_evidence),
        _example("evidence_status", evidence_str, "Yes", has_evidence),
        _example("evidence_status", text, evidence, yes & (evidence != "Yes")),
        _example("evidence_string", text, evidence_str, has_evidence),
        _example("evidence_quality", text, _with_default("evidence_quality", "N/A"), ev_yes),
        _example("verification_timeline", text, _with_default("verification_timeline", "No"), yes),
    )
    return df.select(key, F.inline(F.filter(examples, lambda e: e.isNotNull())))


def four_tasks(df: DataFrame, key: str, data: str = "data") -> DataFrame:
    """``key, task, x, y`` for records that carry their input in one ``data`` column."""
    x = F.col(data)
    promise, evidence = _with_default("promise_status", "No"), _with_default("evidence_status", "No")
    yes = promise == "Yes"
    examples = F.array(
        _example("promise_status", x, promise),
        _example("evidence_status", x, evidence, yes),
        _example("evidence_quality", x, _with_default("evidence_quality", "N/A"), yes & (evidence == "Yes")),
        _example("verification_timeline", x, _with_default("verification_timeline", "N/A"), yes),
    )
    return df.select(key, F.inline(F.filter(examples, lambda e: e.isNotNull())))
