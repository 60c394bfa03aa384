"""Multi-label sets: flags <-> arrays, scores and set differences."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from .text import _col, tolerant_int

# Topic ids and names, in reporting order.
TOPICS: dict[str, str] = {
    "4": "地域",
    "5": "中国的少数民族",
    "6": "种族文化",
    "7": "性别",
    "8": "性傾向",
    "9": "身心障碍",
    "0": "职业/教育",
    "q": "宗教",
    "w": "其他",
}
# Gold-table flag column -> topic id.
TOPIC_FLAG_COLUMNS: dict[str, str] = {
    "topics_地域": "4",
    "topics_少数民族": "5",
    "topics_种族文化": "6",
    "topics_性别": "7",
    "topics_性傾向": "8",
    "topics_身心障碍": "9",
    "topics_职业教育": "0",
    "topics_宗教": "q",
    "topics_其他": "w",
}
TOPIC_IDS: tuple[str, ...] = tuple(TOPICS)
# The label that is never penalised, and the cost of a wrong label.
UNPENALISED = "w"
FALSE_POSITIVE_COST = 3


def flags_to_ids(flags: Mapping[str, str]) -> Column:
    """Wide 0/1 columns -> ordered array of ids; only a value equal to 1 counts."""
    picks = [
        F.when(tolerant_int(F.col(f"`{name}`")) == 1, F.lit(label_id))
        for name, label_id in flags.items()
    ]
    return F.filter(F.array(*picks), lambda x: x.isNotNull())


def multi_hot(groups: Column | str, label_ids: Sequence[str] = TOPIC_IDS,
              prefix: str = "is_") -> dict[str, Column]:
    """One 0/1 column per label; unknown ids are ignored, duplicates count once."""
    groups = _col(groups)
    return {
        f"{prefix}{i}": F.coalesce(F.array_contains(groups, i), F.lit(False)).cast("int")
        for i in label_ids
    }


def answer_json(groups: Column | str) -> Column:
    """``{"groups":[...]}``"""
    return F.to_json(F.struct(_col(groups).alias("groups")))


def parse_answer_json(answer: Column | str) -> Column:
    """Gold answer text -> array of ids; bad JSON or a missing field -> empty array."""
    parsed = F.from_json(_col(answer), "groups array<string>")
    return F.coalesce(parsed["groups"], F.array().cast("array<string>"))


def remap_score(s: Column | str, baseline: float, s_min: float = 0.0) -> Column:
    """Piecewise linear: ``s_min`` -> 0, ``baseline`` -> 1/2, 1 -> 1, clamped to [0, 1]."""
    if not s_min < baseline < 1.0:
        raise ValueError("baseline must lie strictly between s_min and 1")
    s = _col(s)
    low = (s - s_min) * (0.5 / (baseline - s_min))
    high = 0.5 + (s - baseline) * (0.5 / (1.0 - baseline))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(s < baseline, low).otherwise(high)))


def weighted_jaccard(gold: Column | str, pred: Column | str,
                     label_ids: Sequence[str] = TOPIC_IDS,
                     unpenalised: str = UNPENALISED,
                     cost: int = FALSE_POSITIVE_COST) -> Column:
    """Set score in [0, 1]: +1 per right label, ``-cost`` per wrong one (never for ``unpenalised``).

    Predicting nothing scores 1/2, also when the gold set is empty.
    """
    gold, pred = F.array_distinct(_col(gold)), F.array_distinct(_col(pred))
    correct = F.size(F.array_intersect(gold, pred))
    wrong = F.size(F.array_remove(F.array_except(pred, gold), unpenalised))
    raw = (correct - cost * wrong).cast("double")
    floor = float(cost * sum(1 for i in label_ids if i != unpenalised))
    best = F.greatest(F.size(gold), F.lit(1)).cast("double")
    return F.when(raw >= 0, 0.5 + 0.5 * raw / best).otherwise(
        F.greatest(F.lit(0.0), 0.5 * (1.0 + raw / floor))
    )


def set_differences(gold: Column | str, pred: Column | str,
                    unpenalised: str = UNPENALISED) -> dict[str, Column]:
    """Sorted arrays: correct, missing, extra, and extra split into penalised / unpenalised."""
    gold, pred = _col(gold), _col(pred)
    extra = F.sort_array(F.array_except(pred, gold))
    return {
        "correct": F.sort_array(F.array_intersect(gold, pred)),
        "missing": F.sort_array(F.array_except(gold, pred)),
        "extra": extra,
        "penalised": F.array_remove(extra, unpenalised),
        "unpenalised": F.filter(extra, lambda x: x == F.lit(unpenalised)),
    }


def quoted_list(arr: Column | str) -> Column:
    """``['a', 'b']`` — the list notation of the feedback lines."""
    arr = _col(arr)
    return F.when(F.size(arr) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("['"), F.array_join(arr, "', '"), F.lit("']"))
    )


# how the lines of a feedback text begin
FEEDBACK = {
    "gold": "Labels of the row: ",
    "pred": "Labels predicted: ",
    "correct": "Found: ",
    "missing": "Overlooked: ",
    "penalised": "Wrongly added, three points off each: ",
    "unpenalised": "Wrongly added at no cost: ",
    "score": "Score from 0 to 1: ",
}


def feedback_text(gold: Column | str, pred: Column | str, error_msg: Column | str | None = None) -> Column:
    """Per-row explanation of a prediction: what was right, missing, wrong, and the score."""
    gold, pred = _col(gold), _col(pred)
    diff = set_differences(gold, pred)

    def line(label: str, arr: Column, tail: str = "") -> Column:
        return F.concat(F.lit(label), quoted_list(arr), F.lit(tail))

    def line_if_any(label: str, arr: Column) -> Column:
        return F.when(F.size(arr) > 0, line(label, arr, "."))

    report = F.concat_ws(
        "\n",
        line(FEEDBACK["gold"], gold),
        line(FEEDBACK["pred"], pred),
        line(FEEDBACK["correct"], diff["correct"]),
        line_if_any(FEEDBACK["missing"], diff["missing"]),
        line_if_any(FEEDBACK["penalised"], diff["penalised"]),
        line_if_any(FEEDBACK["unpenalised"], diff["unpenalised"]),
        F.concat(F.lit(FEEDBACK["score"]), F.format_string("%.3f", F.round(weighted_jaccard(gold, pred), 3))),
    )
    if error_msg is None:
        return report
    err = F.coalesce(_col(error_msg), F.lit(""))
    return F.when(err != "", F.concat(F.lit("Output could not be parsed: "), err)).otherwise(report)


def exact_match_score(gold: Column | str, normalized_pred: Column | str) -> Column:
    """1.0 when the normalised prediction equals the gold label, ignoring case."""
    from .text import py_strip

    return (F.lower(_col(normalized_pred)) == F.lower(py_strip(_col(gold)))).cast("double")


def exact_match_feedback(gold: Column | str, normalized_pred: Column | str, rule: str,
                         predictor: str | None = None) -> Column:
    """``Gold: .. Pred: ..`` and, when wrong, the labelling rule supplied by the caller."""
    from .text import py_strip

    gold_low = F.lower(py_strip(_col(gold)))
    parts = [F.concat(F.lit("Gold: "), gold_low, F.lit(". Pred: "), _col(normalized_pred), F.lit("."))]
    if predictor:
        parts.append(F.lit(f"Predictor: {predictor}."))
    wrong = F.lower(_col(normalized_pred)) != gold_low
    return F.concat_ws(" ", *parts, F.when(wrong, F.lit(rule)))
