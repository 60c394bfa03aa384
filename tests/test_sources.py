"""Readers and sinks, by writing files and reading them back."""

import json

from pyspark.sql import functions as F
import pytest

from labelloom.operators.ranking import row_ordinal
from labelloom.sources import readers as R, sinks as S


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_labeled_tsv(spark, tmp_path):
    p = put(tmp_path / "a.tsv", "id\tQuestion\tPotentially_Pejorative\n1\t\"a\tb\nc \"\"q\"\"\"\tPotentially\n2\tNA\tNone\n3\tz\t\n4\t🐶　\tNONE\n")
    got = R.read_labeled_tsv(spark, p, with_row_index=True).orderBy("row_index").collect()
    assert [tuple(r) for r in got] == [(0, 'a\tb\nc "q"', "Potentially"), (1, "", None), (2, "z", None), (3, "🐶　", None)]
    literal = R.read_labeled_tsv(spark, p, missing_as_null=False).collect()
    assert [r[1] for r in literal][1] == "None" and literal[1][0] == "NA"
    with pytest.raises(R.MissingColumns):
        R.read_labeled_tsv(spark, p, "nope")


def test_row_ordinal_over_files(spark, tmp_path):
    for name, n in (("b", 3), ("a", 40), ("c", 1)):
        put(tmp_path / f"d/{name}.tsv", "v\n" + "".join(f"{name}{i}\n" for i in range(n)))
    df = row_ordinal(R.read_table_tsv(spark, str(tmp_path / "d"), multiline=False))
    got = [r.v for r in df.orderBy("row_index").collect()]
    assert got == [f"a{i}" for i in range(40)] + ["b0", "b1", "b2", "c0"]
    assert [r.row_index for r in df.orderBy("row_index").collect()] == list(range(44))
    spark.range(0, 50, numPartitions=5).write.parquet(str(tmp_path / "p"))
    back = row_ordinal(spark.read.parquet(str(tmp_path / "p")))
    assert [r.row_index for r in back.orderBy("id").collect()] == list(range(50))


def test_headerless(spark, tmp_path):
    p = put(tmp_path / "h.tsv", "Question\tPotentially_Pejorative\ns1\tNone\ns2\tPotentially\n")
    assert rows(R.read_headerless_tsv(spark, p)) == [("s1", "None"), ("s2", "Potentially")]


def test_json_any(spark, tmp_path):
    schema = "title string, desc string"
    put(tmp_path / "j/arr.json", '\n [{"title": "a", "desc": null}, 5, {"title": "b"}, [1]]')
    put(tmp_path / "j/lines.jsonl", '{"title": "c", "desc": "d"}\n\nbroken {\n[1,2]\n{"title": null}\n')
    got = rows(R.read_json_any(spark, str(tmp_path / "j"), schema))
    assert got == sorted([("a", None), ("b", None), ("c", "d"), (None, None)], key=str)
    assert rows(R.bad_lines(spark, str(tmp_path / "j/lines.jsonl")).select("line")) == [("broken {",)]
    assert R.read_json_any(spark, str(tmp_path / "none.json"), schema, missing_ok=True).count() == 0
    with pytest.raises(FileNotFoundError):
        R.read_json_any(spark, str(tmp_path / "none.json"), schema)
    bad = put(tmp_path / "bad.json", '[{"title": "a"')
    with pytest.raises(Exception):
        R.read_json_any(spark, bad, schema).collect()
    assert R.read_json_any(spark, bad, schema, strict_arrays=False).count() == 0
    fallback = put(tmp_path / "fallback.json", '[1]\n{"title": "a"}\n')
    assert rows(R.read_records_or_single(spark, fallback, schema)) == []  # the first value is an array
    torn = put(tmp_path / "torn.json", '[1\n{"title": "a"}\n')
    assert rows(R.read_records_or_single(spark, torn, schema)) == [("a", None)]


def test_json_loses_nothing(spark, tmp_path):
    schema = "a string, b string"
    record = '{"a": 1, "b": 12.0, "a": "last"}'
    for name, text in (("arr.json", f"[{record}, {record}]"), ("lines.jsonl", f"{record}\n{record}\n"),
                       ("mark.json", f"\ufeff[{record}, {record}]"), ("mark.jsonl", f"\ufeff{record}\n{record}"),
                       ("blank.json", "\n " * 1500 + f"[{record},{record}]"), ("blank.jsonl", "\n" * 3000 + f"{record}\n{record}")):
        p = put(tmp_path / name, text)
        assert rows(R.read_json_any(spark, p, schema)) == [("last", "12.0")] * 2, name
        assert R.read_json_any(spark, p, "map<string,string>").first().record == {"a": "last", "b": "12.0"}, name
        assert R.bad_lines(spark, p).count() == 0, name
    pretty = put(tmp_path / "pretty.json", json.dumps([{"a": 1}, {"b": 2}], indent=2))
    assert R.bad_lines(spark, pretty).count() == 0
    assert rows(R.read_json_any(spark, put(tmp_path / "two.jsonl", '{"a": 1},{"a": 2}\n{"a": 3}'), schema)) == [("3", None)]


def test_large_json_array(spark, tmp_path):
    p = tmp_path / "large.json"
    filler = "x" * 1000
    with p.open("w") as f:
        f.write("[" + ",".join(f'{{"a": {i}, "b": "{filler}"}}' for i in range(145_000)) + "]")
    assert p.stat().st_size > 145_000_000
    assert R.read_json_any(spark, str(p), "a int").agg(F.count("a"), F.max("a")).first()[:] == (145_000, 144_999)


def test_zero_labels_of_any_spelling(spark, tmp_path):
    from labelloom.plans import corpora
    lines = put(tmp_path / "z.jsonl", '{"text": "x", "label": 0.0}\n{"text": "y", "label": 0}\n{"text": "z", "label": 1}\nbroken\n')
    bad = corpora.convert_harmless_corpus(spark, lines, str(tmp_path / "o1"))
    assert [r["line"] for r in bad.collect()] == ["broken"]
    assert rows(R.read_table_tsv(spark, str(tmp_path / "o1")).select("Question")) == [("x",), ("y",)]
    array = put(tmp_path / "z.json", '[{"text": "x", "label": 0.0},\n {"text": "y", "label": "0"}]')
    assert corpora.convert_harmless_corpus(spark, array, str(tmp_path / "o2")).count() == 0
    assert R.read_table_tsv(spark, str(tmp_path / "o2")).count() == 2


def test_json_map_records_and_single_object(spark, tmp_path):
    p = put(tmp_path / "m.jsonl", '{"content": "x", "Q1 hateful": "hate", "n": 3}\n')
    assert R.read_json_any(spark, p, "map<string,string>").first().record == {"content": "x", "Q1 hateful": "hate", "n": "3"}
    one = put(tmp_path / "one.json", '{\n "title": "a",\n "desc": "b"\n}')
    assert rows(R.read_records_or_single(spark, one, "title string, desc string")) == [("a", "b")]
    assert rows(R.read_records_or_single(spark, p, "content string")) == [("x",)]
    assert R.read_records_or_single(spark, str(tmp_path / "zip"), "content string").count() == 0


def test_strict_readers(spark, tmp_path):
    good = put(tmp_path / "g.jsonl", '{"a": 1}\n{"a": 2}\n')
    bad = put(tmp_path / "b.jsonl", '{"a": 1}\nnope\n')
    assert rows(R.read_jsonl_strict(spark, good, "a int")) == [(1,), (2,)]
    with pytest.raises(Exception):
        R.read_jsonl_strict(spark, bad, "a int").collect()
    arr = put(tmp_path / "arr.json", '[{"a": 1},\n {"a": 2}]')
    assert rows(R.read_json_array_strict(spark, arr, "a int")) == [(1,), (2,)]


def test_exclusions(spark, tmp_path):
    a = put(tmp_path / "a.csv", "row_index,text\n3,x\n3.0,y\nbad,z\n,q\n7,\"m\nn\"\n")
    b = put(tmp_path / "b.csv", "other\n1\n")
    assert rows(R.read_exclusions(spark, [a, b, str(tmp_path / "missing.csv"), ""])) == [(3,), (7,)]


def test_lexicon_prompt_and_back(spark, tmp_path):
    terms = [{"term": "b", "definition": "d", "category": "c", "id": 7, "tags": ["x", {"y": 1}]}, {"term": " "}, {"term": "a", "definition": "x \"q\""}]
    p = put(tmp_path / "lex.json", json.dumps({"version": 2, "terms": terms}, ensure_ascii=False, indent=1))
    lex = R.read_lexicon(spark, p)
    assert rows(lex.select("term")) == [("a",), ("b",)]
    assert R.read_lexicon_head(spark, p) == {"version": 2}
    S.write_lexicon(lex, str(tmp_path / "out"), R.read_lexicon_head(spark, p))
    doc = json.loads(spark.read.text(str(tmp_path / "out")).first()[0])
    assert doc == {"version": 2, "terms": [terms[0], terms[2]]}
    S.write_lexicon(lex.select("term", "category"), str(tmp_path / "plain"))
    assert [t["term"] for t in json.loads(spark.read.text(str(tmp_path / "plain")).first()[0])["terms"]] == ["a", "b"]
    assert rows(R.read_lexicon(spark, str(tmp_path / "out")).select("term")) == [("a",), ("b",)]
    assert R.read_prompt(spark, put(tmp_path / "p.txt", "line 1\nline 2\n")) == "line 1\nline 2\n"


def test_tsv_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(' a\t"b"\nc ', None, 0.5), ("", "x", None)], "Question string, l string, p double")
    out = str(tmp_path / "t")
    S.write_tsv(df, out, float_format="%.6f", null_text="None")
    got = rows(R.read_table_tsv(spark, out))
    assert got == sorted([(' a\t"b"\nc ', "None", "0.500000"), (None, "x", "None")], key=str)
    nulls = R.read_labeled_tsv(spark, out, "Question", "l").filter("l is null").count()
    assert nulls == 1


def test_jsonl_split_config_metrics(spark, tmp_path):
    df = spark.createDataFrame([(1, None, True), (2, "中", False)], "id int, t string, predicted_label boolean")
    S.write_split(df, str(tmp_path / "s"))
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "s/augmented")).collect())
    assert lines == ['{"id":1,"t":null,"predicted_label":true}', '{"id":2,"t":"中","predicted_label":false}']
    assert spark.read.text(str(tmp_path / "s/possibly")).count() == 1
    S.write_run_config(spark, {"b": 1, "a": "字"}, str(tmp_path / "c"))
    assert json.loads(spark.read.text(str(tmp_path / "c")).first()[0]) == {"a": "字", "b": 1}
    S.write_metrics(spark.createDataFrame([(0.5, "basic")], "f1_7 double, prompt_name string"), str(tmp_path / "m"))
    assert R.read_table_tsv(spark, str(tmp_path / "m")).columns == ["prompt_name", "f1_7"]


def test_embeddings_and_materialize(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 1.0], 1), (2, [1.5, 2.0], None)], "row_id long, embedding array<double>, label int")
    p = str(tmp_path / "e")
    S.write_embeddings(df, p, "enc", "src.tsv", "tsv", ["Question"])
    back = R.read_embeddings(spark, p)
    assert dict(back.dtypes)["embedding"] == "array<float>" and back.first().embedding_model == "enc"
    with pytest.raises(ValueError):
        R.read_embeddings(spark, p, labelled=True)
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    m = str(tmp_path / "stage")
    assert S.materialize(build, m, spark).count() == 3 and S.materialize(build, m, spark).count() == 3
    assert len(calls) == 1
    S.materialize(build, m, spark, overwrite=True)
    assert len(calls) == 2


def test_upsert_versions(spark, tmp_path):
    p = str(tmp_path / "results")
    one = spark.createDataFrame([("m1", 0.1, 0.2)], "row string, svm double, knn double")
    two = spark.createDataFrame([("m1", 0.9), ("m2", 0.3)], "row string, tree double")
    assert S.latest_version(spark, p) is None
    S.upsert_tsv(spark, p, "row", one)
    S.upsert_tsv(spark, p, "row", two)
    last = R.read_table_tsv(spark, S.latest_version(spark, p))
    assert last.columns == ["row", "knn", "svm", "tree"]
    assert rows(last) == [("m1", "0.2", "0.1", "0.9"), ("m2", None, None, "0.3")] or rows(last) == [
        ("m1", "0.2", "0.1", "0.9"), ("m2", "", "", "0.3")]


def test_writers_at_once_lose_no_row(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    p = str(tmp_path / "results")
    frames = [spark.createDataFrame([(f"m{i}", str(i))], "row string, score string") for i in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda f: S.upsert_tsv(spark, p, "row", f), frames))
    assert rows(R.read_table_tsv(spark, S.latest_version(spark, p))) == [(f"m{i}", str(i)) for i in range(4)]
    assert sorted(x.name for x in (tmp_path / "results/_commits").iterdir() if x.name.isdigit()) == ["000001", "000002", "000003", "000004"]


def test_a_dead_writer_is_not_seen(spark, tmp_path):
    p = str(tmp_path / "results")
    S.upsert_tsv(spark, p, "row", spark.createDataFrame([("a", "1")], "row string, score string"))
    last = S.latest_version(spark, p)
    S.write_tsv(spark.createDataFrame([("b", "2")], "row string, score string"), f"{p}/data-dead")  # written, never committed
    assert S.latest_version(spark, p) == last


def test_corpus_split_and_checks(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "hub/train"))
    assert R.read_corpus_split(spark, str(tmp_path / "hub")).count() == 2
    with pytest.raises(ValueError):
        R.require_rows(spark.range(0))
    with pytest.raises(ValueError):
        R.require_same_count(spark.range(1), spark.range(2))
