"""The vector store: what is stored is not encoded again, and survives failures."""

import numpy as np
import pytest

from labelloom.sources.vector_store import VectorStore


def Lengths(folder, broken=None):
    """An encoder that leaves a file for each text it is given."""
    folder = str(folder)

    def encode(texts):
        import uuid
        if broken in texts:
            raise RuntimeError("no")
        for t in texts:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(t)
        return np.array([[len(t), t.count("a"), 0.5] for t in texts], np.float32)

    return encode


def texts_of(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def frame(spark, *texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, text string, digest string").repartition(2)


def store(spark, tmp_path, model="m", dim=2):
    return VectorStore(spark, str(tmp_path / "store"), model, dim, ("{text}",), buckets=4)


def test_texts_are_encoded_once(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    s = store(spark, tmp_path)
    out = s.embed(frame(spark, "a", "bb", "a", None, ""), "text", Lengths(seen))
    assert {r["id"]: r["embedding"] for r in out.collect()} == {0: [1, 1], 1: [2, 0], 2: [1, 1], 3: [0, 0], 4: [0, 0]}
    assert texts_of(seen) == ["", "a", "bb"] and s.version() == 1
    assert store(spark, tmp_path).add(frame(spark, "bb", "a"), "text", Lengths(seen)) == 1  # nothing new
    assert texts_of(seen) == ["", "a", "bb"]
    assert s.add(frame(spark, "bb", "ccc"), "text", Lengths(seen)) == 2
    assert texts_of(seen) == ["", "a", "bb", "ccc"]
    assert s.rows(version=1).count() == 3 and s.rows().count() == 4
    store(spark, tmp_path, model="other/one").add(frame(spark, "a"), "text", Lengths(seen))
    store(spark, tmp_path, dim=3).add(frame(spark, "a"), "text", Lengths(seen))
    assert texts_of(seen) == ["", "a", "a", "a", "bb", "ccc"]


def test_another_session_finds_the_rows(spark, tmp_path):
    (tmp_path / "seen").mkdir()
    s = store(spark, tmp_path)
    s.add(frame(spark, "a", "bb"), "text", Lengths(tmp_path / "seen"))
    spark.sql(f"DROP TABLE {s.table}")
    again = store(spark, tmp_path)
    got = again.attach(frame(spark, "bb", "new"), "text", version="version").collect()
    assert sorted((r["text"], r["embedding"], r["version"]) for r in got) == [("bb", [2, 0], 1), ("new", None, None)]


def test_a_failed_run_leaves_the_last_version(spark, tmp_path):
    (tmp_path / "seen").mkdir()
    s = store(spark, tmp_path)
    s.add(frame(spark, "a", "bb"), "text", Lengths(tmp_path / "seen"))
    with pytest.raises(Exception, match="no"):
        s.add(frame(spark, *(f"text {i}" for i in range(50)), "bad"), "text", Lengths(tmp_path / "seen", broken="bad"))
    assert s.version() == 1 and s.rows().count() == 2
    assert s.add(frame(spark, "bad"), "text", Lengths(tmp_path / "seen")) == 2


def test_stored_vectors_are_not_shuffled(spark, tmp_path):
    (tmp_path / "seen").mkdir()
    s = store(spark, tmp_path)
    s.add(frame(spark, "a", "bb"), "text", Lengths(tmp_path / "seen"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = s.attach(frame(spark, "a"), "text")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
