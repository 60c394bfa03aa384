"""Calling a scorer or a completion function per row, in batches, with retries inside the task.

The functions to call are supplied by the caller; nothing here opens a connection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
import time

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.answers import ERR_COMPLETION, first_message_field, parse_answers, user_message
from ..functions.labels import normalize_label
from ..functions.labelsets import TOPIC_IDS

# Moderation score columns.
MODERATION_CATEGORIES = (
    "sexual", "sexual/minors", "harassment", "harassment/threatening",
    "hate", "hate/threatening", "illicit", "illicit/violent",
    "self-harm", "self-harm/intent", "self-harm/instructions",
    "violence", "violence/graphic",
)


def _with_retries(call: Callable, text: str, models: Sequence[str | None], tries: int, pause: float):
    """Call with alternating model names; None after the last failure."""
    for attempt in range(tries):
        try:
            return call(text, models[attempt % len(models)])
        except Exception:
            if attempt + 1 < tries and pause > 0:
                time.sleep(pause)
    return None


def _mapper(threads: int):
    """``map`` that overlaps the waiting of slow calls within one task, in input order."""
    if threads <= 1:
        return lambda fn, items: [fn(i) for i in items]

    def run(fn, items):
        with ThreadPoolExecutor(threads) as pool:
            return list(pool.map(fn, items))

    return run


def score_rows(df: DataFrame, scorer: Callable[[str, str | None], dict], text: str,
               categories: Sequence[str] = MODERATION_CATEGORIES, models: Sequence[str | None] = (None,),
               tries: int = 5, pause: float = 15.0, threads: int = 1, tasks: int | None = None) -> DataFrame:
    """Input columns plus the missing category columns (double).

    ``scorer(text, model)`` returns category -> score. Blank text and a call that fails ``tries``
    times leave NULLs. Rows keep their keys; order is a matter for the sink. ``tasks`` x ``threads``
    bounds the number of calls in flight.
    """
    wanted = list(categories)
    fields = [T.StructField(f.name, T.DoubleType()) if f.name in wanted else f for f in df.schema.fields]
    fields += [T.StructField(c, T.DoubleType()) for c in wanted if c not in df.columns]
    schema = T.StructType(fields)
    names = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        do = _mapper(threads)
        for pdf in batches:
            got = do(lambda s: (_with_retries(scorer, s, models, tries, pause) or {}) if s else {},
                     [s if isinstance(s, str) else "" for s in pdf[text]])
            for c in wanted:
                pdf[c] = pd.Series([g.get(c) for g in got], dtype="float64", index=pdf.index)
            yield pdf[names]

    return _spread(df, tasks).mapInPandas(run, schema)


def _spread(df: DataFrame, tasks: int | None) -> DataFrame:
    return df if tasks is None else df.repartition(tasks)


def score_rows_map(df: DataFrame, scorer: Callable[[str], dict], text: str, pause: float = 0.0,
                   name: str = "scores", threads: int = 1, tasks: int | None = None) -> DataFrame:
    """Add a ``map<string,double>`` column; a failed call gives an empty map."""
    schema = T.StructType(df.schema.fields + [T.StructField(name, T.MapType(T.StringType(), T.DoubleType()))])

    def one(s):
        try:
            out = {str(k): float(v) for k, v in scorer(s).items()}
        except Exception:
            out = {}
        if pause > 0:
            time.sleep(pause)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        do = _mapper(threads)
        for pdf in batches:
            pdf[name] = do(one, list(pdf[text]))
            yield pdf

    return _spread(df, tasks).mapInPandas(run, schema)


def expand_prompts(df: DataFrame, prompts: dict[str, str]) -> DataFrame:
    """Every row once per prompt: adds ``prompt_name, prompt``. The prompts travel inside the plan."""
    items = F.array(*[F.struct(F.lit(n).alias("prompt_name"), F.lit(p).alias("prompt"))
                      for n, p in prompts.items()])
    return df.select("*", F.inline(items))


def complete_rows(df: DataFrame, prompts: dict[str, str], completer: Callable[[str, str], str | dict],
                  key: str = "idx", text: str = "text", keep: Sequence[str] = (),
                  label_ids: Sequence[str] = TOPIC_IDS, threads: int = 1, tasks: int | None = None) -> DataFrame:
    """Answer log: one row per (row, prompt) with raw output, parsed value, groups and error.

    ``completer(prompt, message)`` returns the answer text, or a message dict with ``content`` and
    perhaps ``reasoning_content``. An exception becomes an empty answer with a message.
    """
    rows = expand_prompts(df.select(key, *keep, text), prompts)
    schema = T.StructType(rows.schema.fields + [
        T.StructField("content", T.StringType()), T.StructField("reasoning", T.StringType()),
        T.StructField("call_error", T.StringType()),
    ])
    rows = rows.withColumn("_msg", user_message(text))
    names = schema.fieldNames()

    def call(pair):
        try:
            out = completer(*pair)
            if isinstance(out, dict):
                return out.get("content"), out.get("reasoning_content"), ""
            return out, None, ""
        except Exception as e:
            return None, None, ERR_COMPLETION + str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        do = _mapper(threads)
        for pdf in batches:
            got = do(call, list(zip(pdf["prompt"], pdf["_msg"])))
            pdf["content"] = pd.Series([g[0] for g in got], dtype=object, index=pdf.index)
            pdf["reasoning"] = pd.Series([g[1] for g in got], dtype=object, index=pdf.index)
            pdf["call_error"] = [g[2] for g in got]
            yield pdf[names]

    answered = _spread(rows, tasks).mapInPandas(run, schema).withColumn(
        "raw_output", first_message_field("content", "reasoning")
    )
    parsed = parse_answers(answered, "raw_output", label_ids)
    failed = F.col("call_error") != ""
    return (
        parsed.withColumn("error_msg", F.when(failed, F.col("call_error")).otherwise(F.col("error_msg")))
        .withColumn("error", F.col("error_msg") != "")
        .select(key, *keep, "prompt_name", text, "raw_output", "parsed", "groups", "error", "error_msg")
    )


def safe_label(raw: str):
    """Predicted label text -> ``Potentially``/``None``; a failed prediction is ``None``."""
    return normalize_label(F.coalesce(F.col(raw), F.lit("None")), "prefix")
