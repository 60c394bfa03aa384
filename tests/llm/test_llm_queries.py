"""The registered queries of the llm subpackage, and the pipeline."""

import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from labelloom.llm.queries import ORACLES, QUERIES
from tools.check import normal

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert {name.partition("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = QUERIES[name](spark, DATA)
    cur = con.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cur.fetchall(), cols)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_a_row_for_each_input_row(spark, name):
    source = "pages" if name.startswith("op9") else "documents"
    rows = spark.read.parquet(f"{DATA}/{source}.parquet")
    if name.startswith("op13"):
        rows = spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id").distinct()
    assert QUERIES[name](spark, DATA).count() == rows.count()


def test_pipeline_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "near-duplicates", "decontamination", "secrets", "mixing"]
    out = corpus_pipeline.run(spark, DATA)
    assert set(docs.columns) <= set(out.columns)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 0.5 * docs.count() < len(ids) < docs.count()
    assert set(ids) <= {r["doc_id"] for r in docs.select("doc_id").collect()}
