"""Row scoring with deterministic stand-ins for the external scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.labelsets import TOPIC_IDS
from ..operators import metrics as M, pivot, scoring as S
from .base import query, sql_list, table

CATEGORIES = ("hate", "violence", "self-harm/intent")


def stub_scores(text: str, model: str | None) -> dict:
    """Scores from the text length; lengths divisible by 13 always fail, odd ones fail for model ``a``."""
    n = len(text)
    if n % 13 == 0 or (n % 2 == 1 and model == "a"):
        raise RuntimeError("unavailable")
    return {"hate": (n * 7 % 997) / 997.0, "violence": (n * 11 % 997) / 997.0}


@query("stub_scoring", """
WITH x AS (SELECT doc_id, length(CASE WHEN doc_id % 10 = 0 THEN '' ELSE text END) AS n FROM documents)
SELECT doc_id, CASE WHEN n > 0 AND n % 13 > 0 THEN round((n * 7 % 997) / 997.0::DOUBLE, 6) ELSE -1 END AS hate,
       CASE WHEN n > 0 AND n % 13 > 0 THEN round((n * 11 % 997) / 997.0::DOUBLE, 6) ELSE -1 END AS violence,
       -1.0::DOUBLE AS self_harm_intent FROM x""")
def stub_scoring(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("text")).alias("text"))
    out = S.score_rows(docs, stub_scores, "text", CATEGORIES, models=("a", "b"), pause=0)
    return out.select("doc_id", *[F.coalesce(F.round(F.col(f"`{c}`"), 6), F.lit(-1.0)).alias(n)
                                  for c, n in zip(CATEGORIES, ("hate", "violence", "self_harm_intent"))])


def stub_categories(text: str) -> dict:
    n = len(text)
    if n % 17 == 0:
        raise RuntimeError("unavailable")
    out = {"Toxic": n % 100 / 100.0}
    if n % 3 == 0:
        out["Death, Harm & Tragedy"] = n % 50 / 50.0
    return out


@query("stub_categories_pivot", """
SELECT conv_id, turn, CASE WHEN n % 17 = 0 OR n % 3 > 0 THEN -1 ELSE round(n % 50 / 50.0::DOUBLE, 6) END AS "Death_Harm_and_Tragedy_confidence",
       CASE WHEN n % 17 = 0 THEN -1 ELSE round(n % 100 / 100.0::DOUBLE, 6) END AS "Toxic_confidence"
FROM (SELECT conv_id, turn, length(text) AS n FROM conversations)""")
def stub_categories_pivot(spark, d) -> DataFrame:
    conv = table(spark, d, "conversations").select("conv_id", "turn", "text")
    scored = S.score_rows_map(conv, stub_categories, "text").drop("text")
    wide = pivot.widen_scores(scored)
    return wide.select("conv_id", "turn", *[F.coalesce(F.round(c, 6), F.lit(-1.0)).alias(c)
                                            for c in wide.columns if c.endswith("_confidence")])


def stub_answer(prompt: str, message: str):
    """Topic ids picked by message length and prompt; some calls fail, some answers use the reasoning field."""
    n, k = len(message), 2 if prompt == "short" else 3
    if n % 19 == 0:
        raise RuntimeError("down")
    ids = [t for i, t in enumerate(TOPIC_IDS, 1) if (n + i) % k == 0]
    body = '<final_answer>{"groups": [' + ", ".join(f'"{t}"' for t in ids) + "]}</final_answer>"
    return {"content": " ", "reasoning_content": body} if n % 5 == 0 else body


_IDS = sql_list(TOPIC_IDS)
_SQL_LOG = f"""log AS (SELECT conv_id, turn, prompt_name, length(text) + 4 AS n, (length(text) + 4) % 19 = 0 AS failed,
    list_filter({_IDS}, lambda x, i: (conv_id * (i + 2) + turn) % 4 = 0) AS gold,
    CASE WHEN (length(text) + 4) % 19 = 0 THEN [] ELSE list_filter({_IDS}, lambda x, i: (length(text) + 4 + i) % k = 0) END AS groups
  FROM conversations, (VALUES ('basic', 2), ('optimized', 3)) p(prompt_name, k))"""


def prompt_log(spark, d) -> DataFrame:
    ids = F.array(*[F.lit(i) for i in TOPIC_IDS])
    conv = table(spark, d, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("idx"), "text",
        F.filter(ids, lambda x, i: (F.col("conv_id") * (i + 3) + F.col("turn")) % 4 == 0).alias("gold"))
    return S.complete_rows(conv, {"basic": "short", "optimized": "a longer prompt"}, stub_answer, keep=["gold"])


@query("prompt_log", f"""WITH {_SQL_LOG}
SELECT conv_id || '-' || turn AS idx, prompt_name, array_to_string(groups, ',') AS groups, failed::INT AS error,
       CASE WHEN failed THEN 'completion error: down' ELSE '' END AS error_msg FROM log""")
def prompt_log_query(spark, d) -> DataFrame:
    return prompt_log(spark, d).select("idx", "prompt_name", F.array_join("groups", ",").alias("groups"),
                                       F.col("error").cast("int").alias("error"), "error_msg")


_SQL_AB = " UNION ALL ".join(
    f"SELECT prompt_name, count(*) AS n, count(*) FILTER (list_contains(gold, '{i}') AND list_contains(groups, '{i}')) AS tp, "
    f"count(*) FILTER (NOT list_contains(gold, '{i}') AND list_contains(groups, '{i}')) AS fp, "
    f"count(*) FILTER (list_contains(gold, '{i}') AND NOT list_contains(groups, '{i}')) AS fn FROM log GROUP BY 1"
    for i in TOPIC_IDS)


@query("prompt_ab", f"""WITH {_SQL_LOG}, l AS ({_SQL_AB}),
 e AS (SELECT prompt_name, round(avg((gold = groups)::INT), 6) AS subset_accuracy FROM log GROUP BY 1)
SELECT prompt_name, any_value(subset_accuracy) AS subset_accuracy,
       round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)), 6) AS macro_f1,
       round(avg((n - fp - fn) / n::DOUBLE), 6) AS macro_accuracy, round(sum(fp + fn) / (9 * any_value(n))::DOUBLE, 6) AS hamming_loss
FROM l JOIN e USING (prompt_name) GROUP BY prompt_name""")
def prompt_ab(spark, d) -> DataFrame:
    out = M.multilabel_metrics(prompt_log(spark, d), "gold", "groups", by=["prompt_name"])
    return out.select("prompt_name", *[F.round(c, 6).alias(c) for c in
                                       ("subset_accuracy", "macro_f1", "macro_accuracy", "hamming_loss")])


@query("safe_labels", """SELECT conv_id, turn, CASE WHEN length(text) % 4 = 0 THEN 'Potentially' ELSE 'None' END AS label FROM conversations""")
def safe_labels(spark, d) -> DataFrame:
    n = F.length("text")
    raw = F.when(n % 4 == 0, F.lit(" Potentially pejorative")).when(n % 4 == 1, F.lit("No"))
    return table(spark, d, "conversations").select("conv_id", "turn", raw.alias("raw")).select(
        "conv_id", "turn", S.safe_label("raw").alias("label"))
