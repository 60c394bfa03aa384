"""Model answers: tags, tolerant JSON, groups, and label-set scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import answers as A, labelsets as S
from .base import query, sql_list, sql_strip, table

IDS = sql_list(S.TOPIC_IDS)

# answer templates around the conversation text {t}: (answer, groups, error message)
TEMPLATES = (
    ('{t} <final_answer>{"groups": ["4", "7"]}</final_answer>', "4,7", ""),
    ('<final_answer> {"groups": ["0"], "tuples": [["x"]]} </final_answer> {t} </final_answer>', "0", ""),
    ('```json\n{"groups": ["q", "w", "zz"],}\n```', "q,w", ""),
    ("{'groups': ['5', '5']}", "5,5", ""),
    ('{"groups": ["8", "9"', "8,9", ""),
    ('{"reason": "none"}', "", ""),
    ('{"groups": null}', "", A.ERR_NOT_LIST),
    ('{"groups": "7"}', "", A.ERR_NOT_LIST),
    ('{"groups": [4, " 6 ", 9]}', "4,6,9", ""),
    ('["4"]', "", A.ERR_NOT_OBJECT),
    ("  \n ", "", A.ERR_EMPTY),
    ("{t}", "", A.ERR_NOT_OBJECT),
    ('{"groups": ["4"], "why": "x", "groups": ["7"]}', "7", ""),
    ('{"tuples":[{"a":["x"],"b":"y"', "", ""),
    ('{"why":"see [1","groups":["4"', "4", ""),
    ('{groups: ["4"]}', "4", ""),
    ('{"groups": ["4" "7"\n"w"]}', "4,7,w", ""),
    ('{"groups": [7.0, 8]}', "8", ""),
    ('{"groups": ["4", "7"]} and {t', "4,7", ""),
    ('So: {"a": {"b": [1, {"c": "}"', "", ""),
)


def answer_log(spark, d) -> DataFrame:
    """``conv_id, turn, raw_output``: a template chosen by key around the turn's whole text."""
    conv = table(spark, d, "conversations")
    raw = F.lit(None).cast("string")
    for i, (t, _, _) in enumerate(TEMPLATES):
        filled = F.replace(F.lit(t), F.lit("{t}"), F.col("text"))
        raw = F.when((F.col("conv_id") + F.col("turn")) % len(TEMPLATES) == i, filled).otherwise(raw)
    return conv.select("conv_id", "turn", raw.alias("raw_output"))


def _sql_case(i: int | None) -> str:
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    cases = []
    for n, tpl in enumerate(TEMPLATES):
        value = f"replace({lit(tpl[0])}, '{{t}}', text)" if i is None else lit(tpl[i])
        cases.append(f"WHEN {n} THEN {value}")
    return f"CASE (conv_id + turn) % {len(TEMPLATES)} {' '.join(cases)} END"


@query("answer_tags", f"""
WITH r AS (SELECT conv_id, turn, {_sql_case(None)} AS s FROM conversations),
 p AS (SELECT *, strpos(s, '<final_answer>') AS a,
              CASE WHEN contains(s, '</final_answer>')
                   THEN length(s) - strpos(reverse(s), reverse('</final_answer>')) - 14 + 1 ELSE 0 END AS b FROM r)
SELECT conv_id, turn, md5({sql_strip("CASE WHEN a > 0 AND b > 0 THEN substring(s, a + 14, greatest(b - a - 14, 0)) ELSE s END")}) AS inner_md5
FROM p""")
def answer_tags(spark, d) -> DataFrame:
    return answer_log(spark, d).select("conv_id", "turn", F.md5(A.strip_answer_tags("raw_output")).alias("inner_md5"))


@query("groups_parsed", f"""
SELECT conv_id, turn, {_sql_case(1)} AS groups, ({_sql_case(2)} <> '')::INT AS error, {_sql_case(2)} AS error_msg
FROM conversations""")
def groups_parsed(spark, d) -> DataFrame:
    return A.parse_answers(answer_log(spark, d)).select(
        "conv_id", "turn", F.array_join("groups", ",").alias("groups"), F.col("error").cast("int").alias("error"), "error_msg")


@query("groups_parsed_unknown_kept", f"""
SELECT conv_id, turn, CASE g WHEN '8' THEN '7.0,8' ELSE replace(g, 'q,w', 'q,w,zz') END AS groups
FROM (SELECT conv_id, turn, {_sql_case(1)} AS g FROM conversations)""")
def groups_parsed_unknown_kept(spark, d) -> DataFrame:
    parsed = A.parse_answers(answer_log(spark, d), keep_unknown=True)
    return parsed.select("conv_id", "turn", F.array_join("groups", ",").alias("groups"))


def gold_and_pred(df: DataFrame, a: Column, b: Column, extra: str = "zz") -> DataFrame:
    """Label sets picked by arithmetic on two integer columns."""
    ids = F.array(*[F.lit(i) for i in S.TOPIC_IDS])
    gold = F.filter(ids, lambda x, i: (a * (i + 3) + b) % 4 == 0)
    pred = F.filter(ids, lambda x, i: (a * (i + 6) + b) % 3 == 0)
    return df.withColumn("gold", gold).withColumn(
        "pred", F.when(a % 9 == 0, F.array().cast("array<string>")).when(a % 11 == 0, F.col("gold"))
        .when(a % 13 == 0, F.concat(pred, F.array(F.lit(extra)))).otherwise(pred))


def sql_gold_and_pred(a: str, b: str, extra: str = "zz") -> str:
    return f"""list_filter({IDS}, lambda x, i: ({a} * (i + 2) + {b}) % 4 = 0) AS gold,
     CASE WHEN {a} % 9 = 0 THEN [] WHEN {a} % 11 = 0 THEN list_filter({IDS}, lambda x, i: ({a} * (i + 2) + {b}) % 4 = 0)
          WHEN {a} % 13 = 0 THEN list_append(list_filter({IDS}, lambda x, i: ({a} * (i + 5) + {b}) % 3 = 0), '{extra}')
          ELSE list_filter({IDS}, lambda x, i: ({a} * (i + 5) + {b}) % 3 = 0) END AS pred"""


_SQL_SETS = f"""s AS (SELECT doc_id, {sql_gold_and_pred('doc_id', 'quality')} FROM labels),
 z AS (SELECT *, list_sort(list_filter(gold, lambda x: list_contains(pred, x))) AS correct,
       list_sort(list_filter(gold, lambda x: NOT list_contains(pred, x))) AS missing,
       list_sort(list_filter(pred, lambda x: NOT list_contains(gold, x))) AS extra FROM s),
 c AS (SELECT *, len(correct) - 3 * len(list_filter(extra, lambda x: x <> 'w')) AS raw, greatest(len(gold), 1) AS best FROM z),
 n AS (SELECT *, (raw + 24) / (best + 24.0::DOUBLE) AS norm, 24 / (best + 24.0::DOUBLE) AS base FROM c),
 w AS (SELECT *, CASE WHEN norm <= 0 THEN 0 WHEN norm < base THEN 0.5 * norm / base
                      ELSE least(1.0, 0.5 + 0.5 * (norm - base) / (1 - base)) END AS score FROM n)"""


@query("weighted_jaccard", f"""WITH {_SQL_SETS}
SELECT doc_id, array_to_string(correct, ',') AS correct, array_to_string(missing, ',') AS missing,
       array_to_string(extra, ',') AS extra, array_to_string(list_filter(extra, lambda x: x <> 'w'), ',') AS penalised,
       round(score, 6) AS score FROM w""")
def weighted_jaccard(spark, d) -> DataFrame:
    sets = gold_and_pred(table(spark, d, "labels"), F.col("doc_id"), F.col("quality"))
    diff = S.set_differences("gold", "pred")
    return sets.select(
        "doc_id", *[F.array_join(diff[k], ",").alias(k) for k in ("correct", "missing", "extra", "penalised")],
        F.round(S.weighted_jaccard("gold", "pred"), 6).alias("score"))


def _sql_quoted(x: str) -> str:
    return f"CASE WHEN len({x}) = 0 THEN '[]' ELSE '[''' || array_to_string({x}, ''', ''') || ''']' END"


def _sql_line(name: str, x: str, always: bool = False) -> str:
    text = f"'{S.FEEDBACK[name]}' || {_sql_quoted(x)} || {'chr(10)' if always else "'.' || chr(10)"}"
    return text if always else f"CASE WHEN len({x}) > 0 THEN {text} ELSE '' END"


_SQL_PENALISED, _SQL_FREE = (f"list_filter(extra, lambda x: x {op} 'w')" for op in ("<>", "="))


@query("feedback_text", f"""WITH {_SQL_SETS}
SELECT doc_id, round(score, 6) AS score, {_sql_line('gold', 'gold', True)} || {_sql_line('pred', 'pred', True)}
  || {_sql_line('correct', 'correct', True)} || {_sql_line('missing', 'missing')} || {_sql_line('penalised', _SQL_PENALISED)}
  || {_sql_line('unpenalised', _SQL_FREE)} || '{S.FEEDBACK["score"]}' || printf('%.3f', floor(round(score, 6) * 1000 + 0.5) / 1000) AS feedback FROM w""")
def feedback_text(spark, d) -> DataFrame:
    sets = gold_and_pred(table(spark, d, "labels"), F.col("doc_id"), F.col("quality"))
    return sets.select("doc_id", F.round(S.weighted_jaccard("gold", "pred"), 6).alias("score"),
                       S.feedback_text("gold", "pred").alias("feedback"))


@query("mean_row_score", f"""WITH {_SQL_SETS}
SELECT count(*) AS n, round(avg(CASE WHEN doc_id % 17 = 0 THEN 0 ELSE score END), 6) AS mean_score FROM w""")
def mean_row_score(spark, d) -> DataFrame:
    from ..operators.metrics import mean_score

    sets = gold_and_pred(table(spark, d, "labels"), F.col("doc_id"), F.col("quality"))
    scored = sets.select(F.when(F.col("doc_id") % 17 > 0, S.weighted_jaccard("gold", "pred")).alias("score"))
    return mean_score(scored, "score").withColumn("mean_score", F.round("mean_score", 6))


@query("gold_answers", f"""WITH s AS (SELECT doc_id, {sql_gold_and_pred('doc_id', 'quality')} FROM labels)
SELECT doc_id, '{{"groups":[' || array_to_string(list_transform(gold, lambda x: '"' || x || '"'), ',') || ']}}' AS answer,
       CASE WHEN doc_id % 5 = 0 THEN '' ELSE array_to_string(gold, ',') END AS back,
       {', '.join(f"list_contains(gold, '{i}')::INT AS is_{i}" for i in S.TOPIC_IDS)}
FROM s""")
def gold_answers(spark, d) -> DataFrame:
    sets = gold_and_pred(table(spark, d, "labels"), F.col("doc_id"), F.col("quality"))
    hot = S.multi_hot("gold")
    answer = S.answer_json("gold")
    broken = F.when(F.col("doc_id") % 5 == 0, F.lit('{"groups": oops')).otherwise(answer)
    return sets.select("doc_id", answer.alias("answer"), F.array_join(S.parse_answer_json(broken), ",").alias("back"),
                       *[hot[f"is_{i}"].alias(f"is_{i}") for i in S.TOPIC_IDS])


@query("remap_scores", """
SELECT event_id, round(CASE WHEN s <= 0.1 THEN 0 WHEN s < 0.6 THEN 0.5 * (s - 0.1) / 0.5::DOUBLE
   ELSE least(1, 0.5 + 0.5 * (s - 0.6) / 0.4::DOUBLE) END, 6) AS score
FROM (SELECT event_id, value / 100.0::DOUBLE AS s FROM events)""")
def remap_scores(spark, d) -> DataFrame:
    s = F.col("value") / 100.0
    return table(spark, d, "events").select("event_id", F.round(S.remap_score(s, 0.6, 0.1), 6).alias("score"))


@query("user_messages", """
SELECT conv_id, turn, md5('文本: ' || text) AS message_md5,
       CASE WHEN trim(role) = 'system' THEN 'reasoned' ELSE role END AS usable FROM conversations""")
def user_messages(spark, d) -> DataFrame:
    content = F.when(F.col("role") == "system", F.lit(" \n")).otherwise(F.col("role"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.md5(A.user_message("text")).alias("message_md5"),
        A.first_message_field(content, F.lit("reasoned")).alias("usable"))
