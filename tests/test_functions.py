"""Cleaning, label policies, label sets and answer parsing on small literals."""

import math

from pyspark.sql import functions as F
import pytest

from labelloom.functions import answers as A, labels as L, labelsets as S, text as X, vectors as V


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[1] for r in df.select("i", fn(F.col("c"))).orderBy("i").collect()]


def test_whitespace_is_pythons():
    assert sorted(X.WHITESPACE) == sorted(c for c in map(chr, range(0x110000)) if c.isspace())


def test_strip_null_tokens_sanitize(spark):
    vals = ["  a\t", "　b \n", None, " None ", "NaN", "n/a", "nothing", "a\tb\r\nc"]
    assert column(spark, vals, X.py_strip) == ["a", "b", None, "None", "NaN", "n/a", "nothing", "a\tb\r\nc"]
    assert column(spark, vals, X.null_tokens) == ["  a\t", "　b \n", None, None, None, None, "nothing", "a\tb\r\nc"]
    assert column(spark, vals, X.sanitize)[-1] == "a\\tb\\r\\nc"
    assert column(spark, [None], X.sanitize) == [""]


def test_sanitize_columns_leaves_nested(spark):
    df = spark.createDataFrame([("a\tb", 1, ["x\ty"])], "t string, n int, a array<string>")
    row = X.sanitize_columns(df).first()
    assert (row.t, row.n, row.a) == ("a\\tb", "1", ["x\ty"])


def test_compositions(spark):
    df = spark.createDataFrame([("q", None), (" q", "d "), ("", "")], "q string, d string")
    got = df.select(X.question_with_desc("q", "d"), X.question_with_desc_stripped("q", "d"),
                    X.question_with_context("q", "d"), X.join_nonempty(["q", "d"])).collect()
    assert [tuple(r) for r in got] == [("q ", "q", "q", "q"), (" q d ", "q d", " qd ", "q d"), (" ", "", "", "")]


def test_first_text_falls_back_to_first_column(spark):
    df = spark.createDataFrame([("z", "", None), ("z", "t", "c"), (None, None, None)], "other string, text string, content string")
    assert [r[0] for r in df.select(X.first_text(df)).collect()] == ["z", "t", ""]


def test_category_name_qid_tolerant_int(spark):
    assert column(spark, ["Death, Harm & Tragedy", "a/b"], X.category_column_name) == [
        "Death_Harm_and_Tragedy_confidence", "a_b_confidence"]
    vals = ['{"question_id": 12.0}', '{"question_id": 7}', '{"question_id": "x.0"}', "{}", "broken", "", None]
    assert column(spark, vals, X.extract_qid) == ["12", "7", "x.0", "", "", "", ""]
    assert column(spark, ["1", "1.0", "1.9", "x", "", None, "NaN", "inf", "0"], X.tolerant_int) == [1, 1, 1, 0, 0, 0, 0, 0, 0]


RAW = ["Potentially", "None", None, "", " None ", "NONE", "nan", "NaN", "Possible", " potentially", "TRUE", "false"]


@pytest.mark.parametrize("policy,want", [
    ("strict_positive", [1, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0]),
    ("non_empty", [1, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1]),
    ("non_empty_cs", [1, 0, 0, 0, 0, 1, 0, 0, 1, 1, 1, 1]),
    ("truthy", [1, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 0]),
    ("roc", [1, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1]),
    ("prefix", ["Potentially", *["None"] * 8, "Potentially", "None", "None"]),
    ("fill_none", ["Potentially", "None", "None", "None", " None ", "NONE", "None", "None", "Possible", " potentially", "TRUE", "false"]),
    ("true_false", [*[None] * 10, "Potentially", "None"]),
])
def test_label_policies(spark, policy, want):
    assert column(spark, RAW, lambda c: L.normalize_label(c, policy)) == want


def test_unknown_policy():
    with pytest.raises(ValueError):
        L.normalize_label("x", "nope")


def test_span_records(spark):
    recs = [
        {"Q4 hateful": "hate", "Q4 Group": "Region"},            # label sees any n, pruning only 1..3
        {"Q1 hateful": "Hate ", "Q1 Group": "Sexism, others"},
        {"Q2 hateful": "hate", "Q2 Group": "Sexism"},
        {"Q1 hateful": "hate", "Q1 Group": "Sexism", "content": " null "},
        {"Q1 hateful": "non-hate", "Q1 Group": "Sexism"},
        {"Q1 hateful": "hate"},
        {"xQ1 hateful": "hate", "Q1hateful": None},
    ]
    kind = "map<string,string>"
    assert column(spark, recs, L.any_hateful, kind) == [1, 1, 1, 1, 0, 1, 0]
    assert column(spark, recs, L.keep_span_record, kind) == [False, False, True, False, False, False, False]


SETS = [(["4"], ["4"]), ([], []), (["4", "5"], ["4"]), (["4"], ["7"]), (["4"], ["w"]), ([], ["w"]),
        (["4"], ["4", "4", "5"]), (["4"], ["5", "6", "7", "8", "9", "0", "q", "zz", "yy"])]


def direct_score(gold, pred):
    """The published definition, with its normalisation and remapping spelled out."""
    g, p = set(gold), set(pred)
    raw = len(g & p) - 3 * len([x for x in p - g if x != "w"])
    top, low = max(len(g), 1), -24
    norm = min(1.0, max(0.0, (raw - low) / (top - low)))
    base = -low / (top - low)
    return 0.0 if norm <= 0 else (0.5 * norm / base if norm < base else 0.5 + 0.5 * (norm - base) / (1 - base))


def test_weighted_jaccard(spark):
    df = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(SETS)], "i int, g array<string>, p array<string>")
    got = [r[1] for r in df.select("i", S.weighted_jaccard("g", "p")).orderBy("i").collect()]
    assert got == pytest.approx([direct_score(g, p) for g, p in SETS])
    assert got[1] == 0.5 and got[0] == 1.0 and got[-1] == 0.0


def test_remap_score(spark):
    got = column(spark, [-1.0, 0.0, 0.4, 0.8, 0.9, 1.0, 2.0], lambda c: S.remap_score(c, 0.8), "double")
    assert got == pytest.approx([0, 0, 0.25, 0.5, 0.75, 1, 1])
    with pytest.raises(ValueError):
        S.remap_score("x", 1.0)


def test_feedback(spark):
    df = spark.createDataFrame([(["4", "7"], ["7", "5", "w"])], "g array<string>, p array<string>")
    text = df.select(S.feedback_text("g", "p")).first()[0]
    assert text.split("\n") == [
        "Labels of the row: ['4', '7']", "Labels predicted: ['7', '5', 'w']", "Found: ['7']",
        "Overlooked: ['4'].", "Wrongly added, three points off each: ['5'].",
        "Wrongly added at no cost: ['w'].", "Score from 0 to 1: 0.458"]


def test_flags_hot_answer(spark):
    df = spark.createDataFrame([("1", "2", None, "1.0"), ("x", "1", "0", "")], "a string, b string, c string, d string")
    got = [r[0] for r in df.select(S.flags_to_ids({"a": "4", "b": "5", "c": "6", "d": "w"})).collect()]
    assert got == [["4", "w"], ["5"]]
    df = spark.createDataFrame([(["4", "4", "zz"],)], "g array<string>")
    hot = df.select(*[c.alias(n) for n, c in S.multi_hot("g").items()]).first()
    assert sum(hot) == 1 and hot["is_4"] == 1
    assert df.select(S.parse_answer_json(S.answer_json("g"))).first()[0] == ["4", "4", "zz"]
    assert column(spark, ["oops", "{}", None], S.parse_answer_json) == [[], [], []]


def test_strip_answer_tags(spark):
    o, c = A.OPEN_TAG, A.CLOSE_TAG
    vals = [f"x{o} a {c}y", f"{o}a{c}b{c}", f"{o}only", f"a{c}", f"{c}{o}", " plain ", None]
    assert column(spark, vals, A.strip_answer_tags) == ["a", f"a{c}b", f"{o}only", f"a{c}", "", "plain", ""]


@pytest.mark.parametrize("raw,groups,err", [
    ('<final_answer>{"groups": ["4","7"]}</final_answer>', ["4", "7"], ""),
    ('```json\n{"groups": ["q"],}\n```', ["q"], ""),
    ("{'groups': ['5', '5']}", ["5", "5"], ""),
    ('{"groups": ["8", "9"', ["8", "9"], ""),
    ('{"groups": ["8", "9', ["8", "9"], ""),
    ('sure: {"groups": [4, " 6 ", null]} ok', ["4", "6"], ""),
    ('{"a": 1}', [], ""),
    ('{"groups": null}', [], A.ERR_NOT_LIST),
    ('{"groups": "7"}', [], A.ERR_NOT_LIST),
    ('["4"]', [], A.ERR_NOT_OBJECT),
    ("12", [], A.ERR_NOT_OBJECT),
    ("no json here", [], A.ERR_NOT_OBJECT),
    (" \n", [], A.ERR_EMPTY),
    (None, [], A.ERR_EMPTY),
    ('{"groups": ["zz", "w"]}', ["w"], ""),
])
def test_parse_answers(spark, raw, groups, err):
    row = A.parse_answers(spark.createDataFrame([(raw,)], "raw_output string")).first()
    assert (row.groups, row.error_msg, row.error) == (groups, err, err != "")


def test_keep_unknown_and_message_field(spark):
    df = spark.createDataFrame([('{"groups": ["zz", "", "w"]}',)], "raw_output string")
    assert A.parse_answers(df, keep_unknown=True).first().groups == ["zz", "w"]
    df = spark.createDataFrame([(" ", " r "), ("c", "r"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(A.first_message_field("a", "b")).collect()] == [" r ", "c", ""]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [list(r[0]) for r in df.select(V.l2_normalize("v")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert [len(r[0]) for r in df.select(V.crop("v", 1)).collect()] == [1, 1]
    assert [len(r[0]) for r in df.select(V.crop("v", -1)).collect()] == [2, 2]
    with pytest.raises(Exception, match="exceeds vector size"):
        df.select(V.crop("v", 3)).collect()
    p = column(spark, [0.0, 0.5, 1.0], V.logit, "double")
    assert p[1] == 0 and p[0] == pytest.approx(math.log(1e-12)) and p[2] > 27
    assert column(spark, [0.49, 0.5], V.decide, "double") == [0, 1]
    assert column(spark, [-0.1, 0.0], V.decide_raw, "double") == [0, 1]
