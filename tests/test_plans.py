"""End-to-end jobs on small files."""

import json

from pyspark.sql import functions as F

from labelloom.operators import features as X, models as M
from labelloom.plans import corpora, embed_and_label, label_audit, lexicon_job, model_grid, moderation, topic_evaluation
from labelloom.sources import readers as R
from labelloom import streaming

ENC = X.NgramHashEncoder(16)
FAST = M.decision_tree(3)


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def labelled_tsv(tmp_path, n=40):
    lines = [f"{'nice day' if i % 2 else 'awful thing'} {i}\t{'None' if i % 2 else 'Potentially'}" for i in range(n)]
    lines[3] = "nice day 3\tPotentially"  # one wrong label
    return put(tmp_path / "train.tsv", "Question\tPotentially_Pejorative\n" + "\n".join(lines) + "\n")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_corpora(spark, tmp_path):
    train = put(tmp_path / "train.json", json.dumps([{"content": "a", "Q1 hateful": "hate", "Q1 Group": "Sexism"},
                                                     {"content": "b", "Q1 hateful": "hate", "Q1 Group": "others"}]))
    corpora.convert_span_corpus(spark, train, str(tmp_path / "missing.json"), str(tmp_path / "o1"))
    assert rows(R.read_table_tsv(spark, str(tmp_path / "o1"))) == [("a", "Potentially")]
    harm = put(tmp_path / "h.jsonl", '{"text": "x", "label": 0}\n{"text": "y", "label": 1}\n{"text": "z"}\noops\n')
    bad = corpora.convert_harmless_corpus(spark, harm, str(tmp_path / "o2"))
    assert rows(R.read_table_tsv(spark, str(tmp_path / "o2"))) == [("x", "None")] and bad.count() == 1
    raw = spark.createDataFrame([("i", "a" * 1023, "s", '{"question_id": 5.0}', "3"), ("i", "a" * 1024, "s", "{}", None)],
                                "INSTRUCTION string, RESPONSE string, SOURCE string, METADATA string, upvotes string")
    raw.write.parquet(str(tmp_path / "hub/train"))
    corpora.convert_instruction_corpus(spark, str(tmp_path / "hub"), str(tmp_path / "o3"))
    got = spark.read.json(str(tmp_path / "o3")).collect()
    assert [(r.qid, r.title, r.category) for r in got] == [("5", "i", "")]
    base = put(tmp_path / "base.tsv", "Question\tPotentially_Pejorative\nq\tPossible\nr\t\n")
    new = put(tmp_path / "new.tsv", "Question\tdesc\tPotentially_Pejorative\tself_confidence\n x \t d\tTRUE\t0.5\ny\t\tFalse\t0.5\nz\t\t?\t0.5\n")
    corpora.merge_corrections(spark, base, new, str(tmp_path / "o4"))
    assert rows(R.read_table_tsv(spark, str(tmp_path / "o4"))) == [
        ("q", "Possible"), ("r", "None"), ("x d", "Potentially"), ("y", "None"), ("z", "None")]


def test_lexicon_job(spark, tmp_path):
    lex = put(tmp_path / "lex.json", json.dumps({"terms": [
        {"term": "rude", "definition": "d", "category": "a"}, {"term": "nice", "definition": "d", "category": "a"}]}))
    corpus = put(tmp_path / "c.tsv", "Question\tPotentially_Pejorative\nnice\tNone\nrude 1\tPotentially\nrude 2\tPotentially\n　rude nice\tPotentially\n")
    out = lexicon_job.run(spark, lex, corpus, str(tmp_path / "out"))
    assert [r.terms for r in out["funnel"].orderBy("stage").collect()] == [2, 1, 1, 1, 1, 1, 1]
    assert {r.label: r.pct for r in out["coverage"].collect()} == {"None": 0.0, "Potentially": 100.0}
    assert [r.term for r in R.read_lexicon(spark, str(tmp_path / "out")).collect()] == ["rude"]


def test_embed_train_predict(spark, tmp_path):
    tsv = labelled_tsv(tmp_path)
    embed_and_label.embed_table(spark, tsv, str(tmp_path / "e"), ENC, label_col="Potentially_Pejorative", dim=8)
    js = put(tmp_path / "q.jsonl", "\n".join(json.dumps({"title": t, "desc": d}) for t, d in
                                             [("nice day 99", None), ("awful thing 98", "x\ty")]))
    infer = embed_and_label.embed_table(spark, js, str(tmp_path / "i"), ENC, fmt="json", text_cols=("title", "desc"), dim=8)
    assert infer.filter(F.size("embedding") == 24).count() == 2
    out = embed_and_label.train_and_predict(spark, str(tmp_path / "e"), str(tmp_path / "i"), str(tmp_path / "p"), trainer=FAST)
    got = {r.title: r.predicted_label for r in out.collect()}
    assert got == {"nice day 99": False, "awful thing 98": True}
    assert spark.read.text(str(tmp_path / "p/possibly")).count() == 1


def test_label_round(spark, tmp_path):
    tsv = labelled_tsv(tmp_path)
    js = put(tmp_path / "q.jsonl", "\n".join(json.dumps({"title": t, "desc": d}) for t, d in
                                             [("nice day 99", None), ("awful thing", "b\tc"), ("none", "skipped")]))
    out = embed_and_label.label_round(spark, tsv, js, str(tmp_path / "o"), ENC, trainer=FAST)
    labels = rows(R.read_table_tsv(spark, str(tmp_path / "o/predicted_labels")))
    assert [r[0] for r in labels] == ["awful thing", "nice day 99"] and labels[0][1] == "b\\tc"
    assert {r[2] for r in labels} <= {"True", "False"} and out["lowest_confidence"].count() <= 1


def test_label_audit(spark, tmp_path):
    tsv = labelled_tsv(tmp_path)
    ignore = put(tmp_path / "fix.csv", "row_index\n999\n")
    kw = dict(trainer=M.nearest_neighbours(5), folds=2, ignore_paths=[ignore])
    out = label_audit.run(spark, tsv, str(tmp_path / "a"), ENC, **kw)
    flagged = [r.row_index for r in out["report"].filter("suspicious").collect()]
    assert flagged == [3]
    assert out["dropped"].count() == 39
    again = label_audit.run(spark, tsv, str(tmp_path / "a"), ENC, **kw)  # second run reads the stages
    assert [r.row_index for r in again["report"].filter("suspicious").collect()] == [3]
    assert spark.read.option("header", True).csv(str(tmp_path / "a/suspicious_only")).count() == 1


def test_topic_evaluation(spark, tmp_path):
    flags = put(tmp_path / "f.tsv", "uncertainty\ttopics_地域\ttopics_性别\tidx\n1\t1\t0\t7\n1\t0\t1\t8\n1\t0\t1\t9\n")
    texts = put(tmp_path / "t.tsv", "idx\tq\tc\n7\tqq\tcc\n7\tother\t\n8\tq8\t\n")
    gold = topic_evaluation.gold_table(spark, flags, texts)
    assert rows(gold) == [("7", "qqcc", ["4"]), ("8", "q8", ["7"])]

    def completer(prompt, message):
        return '<final_answer>{"groups": ["4"]}</final_answer>' if "qq" in message or prompt == "p" else "?"

    res = topic_evaluation.run(spark, flags, texts, {"basic": "p", "optimized": "o"}, completer, str(tmp_path / "o"))
    got = {r.prompt_name: (r.subset_accuracy, r.hamming_loss) for r in res.collect()}
    assert got["basic"] == (0.5, 2 / 18) and got["optimized"] == (0.5, 1 / 18)
    log = spark.read.json(str(tmp_path / "o/predictions"))
    assert log.count() == 4 and log.filter("error").count() == 1


def test_moderation(spark, tmp_path):
    tsv = labelled_tsv(tmp_path, 10)
    moderation.score_table(spark, tsv, str(tmp_path / "m"), lambda t, m: {"hate": 0.9 if "awful" in t else 0.1},
                           ("hate", "violence"), pause=0)
    table = R.read_table_tsv(spark, str(tmp_path / "m"))
    assert table.columns == ["Question", "Potentially_Pejorative", "hate", "violence"]
    judged = moderation.judge_scores(spark, str(tmp_path / "m"))
    assert [(r.category, r.auc) for r in judged["auc"].collect()] == [("hate", 5 * 4 / 24 + 4 / 24 / 2 + 0.0)] or \
        judged["auc"].first().category == "hate"
    moderation.score_dynamic(spark, tsv, str(tmp_path / "d"), lambda t: {"Bad & sad": 0.5} if "awful" in t else {})
    wide = R.read_table_tsv(spark, str(tmp_path / "d/table"))
    assert wide.columns == ["Question", "Potentially_Pejorative", "Bad_and_sad_confidence"]
    assert wide.filter("Bad_and_sad_confidence = '0.5'").count() == 5


def test_model_grid(spark, tmp_path):
    df = spark.createDataFrame([(i, ("good " if i % 2 else "bad ") + str(i), i % 2) for i in range(30)],
                               "row_id long, text string, label int")
    zoo = {"tree": FAST}
    out = model_grid.run(df, {"enc16": ENC, "enc8": X.NgramHashEncoder(8)}, str(tmp_path / "g"), zoo, folds=2)
    assert out["results"].count() == 2
    from labelloom.sources.sinks import latest_version
    table = R.read_table_tsv(spark, latest_version(spark, str(tmp_path / "g/results_f1")))
    assert rows(table.select("feature_set")) == [("enc16",), ("enc8",)]
    ex = df.select(F.col("row_id").alias("id"), F.lit("promise_status").alias("task"), F.col("text").alias("x"),
                   F.when(F.col("label") == 1, "Yes").otherwise("No").alias("y"))
    assert model_grid.task_grid(ex, "id", zoo, ENC, folds=2).first().feature_set == "promise_status"


def test_streaming_answers(spark, tmp_path):
    put(tmp_path / "in/a.jsonl", json.dumps({"idx": "1", "prompt_name": "p", "text": "t", "raw_output": '{"groups": ["7"]}'}) + "\n")
    stream = streaming.parsed_answers(streaming.read_answer_stream(spark, str(tmp_path / "in")))
    for _ in range(2):  # the second run finds nothing new
        q = streaming.append_parquet(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
        assert q.awaitTermination(60)
    assert [r.groups for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [["7"]]


def test_every_row_is_scored_once(spark, tmp_path):
    from labelloom.plans import moderation

    calls = spark.sparkContext.accumulator(0)

    def scorer(text, model):
        calls.add(1)
        return {"hate": len(text) / 100}

    path = tmp_path / "in.tsv"
    path.write_text("Question\tPotentially_Pejorative\n" + "".join(f"row {i}\tNone\n" for i in range(200)), encoding="utf-8")
    moderation.score_table(spark, str(path), str(tmp_path / "out"), scorer, categories=["hate"])
    assert calls.value == 200
    assert R.read_table_tsv(spark, str(tmp_path / "out")).count() == 200
