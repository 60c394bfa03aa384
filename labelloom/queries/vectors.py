"""Vector expressions, prompt embedding, nearest neighbours and TF-IDF."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import vectors as V
from ..operators import ann as A, features as X, knn as N
from ..session import shared_folder
from ..sources.vector_store import VectorStore
from .base import query, table
from .metrics import _SQL_FOLDS

PROMPTS = ("{text}", "About: {text}?", "用一句话 {text} aeio")


class LetterCounts:
    """Encoder that SQL can repeat: counts of four letters."""

    def __call__(self, texts: list[str]) -> np.ndarray:
        return np.array([[s.count(c) for c in "aeio"] for s in texts], dtype=np.float32)


@query("vector_crop_concat", """
SELECT vec_id, len(v) AS dim, round(list_sum(list_transform(v, lambda x: x::DOUBLE)), 4) AS total,
       v[1]::DOUBLE AS first, v[17]::DOUBLE AS seam, v[24]::DOUBLE AS last
FROM (SELECT vec_id, list_concat(embedding[1:16], embedding[1:8]) AS v FROM embeddings)""")
def vector_crop_concat(spark, d) -> DataFrame:
    v = V.concat_vectors([V.crop("embedding", 16), V.crop("embedding", 8)])
    x = table(spark, d, "embeddings").select("vec_id", v.alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double"))
    return x.select("vec_id", F.size("v").cast("long").alias("dim"), F.round(total, 4).alias("total"),
                    *[F.col("v")[i].cast("double").alias(n) for i, n in ((0, "first"), (16, "seam"), (23, "last"))])


@query("vector_l2", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
 n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e)
SELECT vec_id, round(v[1] / norm, 6) AS u1, round(v[64] / norm, 6) AS u64, 1.0::DOUBLE AS norm FROM n""")
def vector_l2(spark, d) -> DataFrame:
    u = table(spark, d, "embeddings").select("vec_id", V.l2_normalize("embedding").alias("u"))
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x))
    return u.select("vec_id", F.round(F.col("u")[0], 6).alias("u1"), F.round(F.col("u")[63], 6).alias("u64"),
                    F.round(norm, 6).alias("norm"))


def _sql_embedded() -> str:
    cols = []
    for p, t in enumerate(PROMPTS):
        s = f"replace('{t}', '{{text}}', text)"
        cols += [f"(length({s}) - length(replace({s}, '{c}', '')))::DOUBLE AS e{p}_{c}" for c in "aei"]
    return "SELECT doc_id, " + ", ".join(cols) + ", 'letters' AS embedding_model FROM documents"


@query("embed_prompts", _sql_embedded())
def embed_prompts(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = X.embed(docs, "text", LetterCounts(), PROMPTS, dim=3, provenance={"embedding_model": "letters"})
    names = [f"e{p}_{c}" for p in range(3) for c in "aei"]
    return out.select("doc_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)],
                      "embedding_model")


@query("embedding_store", """
WITH known AS (SELECT text FROM benchmark UNION SELECT text FROM documents WHERE lang = 'en')
SELECT doc_id, CASE WHEN coalesce(d.text, '') IN (SELECT coalesce(text, '') FROM known) THEN 1 ELSE 2 END::BIGINT AS version,
  (length(coalesce(d.text, '')) - length(replace(coalesce(d.text, ''), 'a', '')))::DOUBLE AS n_a,
  (length(coalesce(d.text, '')) - length(replace(coalesce(d.text, ''), 'e', '')))::DOUBLE AS n_e FROM documents d""")
def embedding_store(spark, d) -> DataFrame:
    """A first run stores the benchmark's and the English texts; a second one over all documents encodes only the others."""
    store = VectorStore(spark, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}", "letters", dim=4, prompts=("{text}",), buckets=16)
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    store.add(table(spark, d, "benchmark").select("text").unionByName(docs.filter("lang = 'en'").select("text")), "text", LetterCounts())
    store.add(docs, "text", LetterCounts())
    v = F.col("embedding")
    return store.attach(docs, "text", version="version").select(
        "doc_id", "version", v[0].cast("double").alias("n_a"), v[1].cast("double").alias("n_e"))


@query("prompt_variants", """
SELECT doc_id, p.prompt_no::INT AS prompt_no, md5(replace(p.t, '{text}', text)) AS prompt_md5
FROM documents, (VALUES (0, '{text}'), (1, 'About: {text}?'), (2, '用一句话 {text} aeio')) p(prompt_no, t)""")
def prompt_variants(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return X.prompt_texts(docs, "text", PROMPTS).select("doc_id", "prompt_no", F.md5("prompt").alias("prompt_md5"))


@query("hashed_embedding")
def hashed_embedding(spark, d) -> DataFrame:
    """The stand-in sentence encoder over whole documents."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    out = X.embed(docs, "text", X.NgramHashEncoder(64))
    v = F.col("embedding")
    return out.select("doc_id", F.size(v).alias("dim"), F.round(v[0].cast("double"), 5).alias("e0"),
                      F.round(v[191].cast("double"), 5).alias("e191"))


_SQL_NEAR = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
 p AS (SELECT a.vec_id, b.vec_id AS neighbour_id, b.label AS neighbour_label, list_distance(a.v, b.v) AS distance
       FROM e a JOIN e b ON a.vec_id % 3 <> b.vec_id % 3),
 r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS rank FROM p)"""


def _neighbours(spark, d, **kw) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("fold", (F.col("vec_id") % 3).cast("int"))
    near = N.knn(e, e, 5, key="vec_id", fold="fold", **kw)
    return near.select("vec_id", F.posexplode("neighbours").alias("pos", "n")).select(
        "vec_id", (F.col("pos") + 1).cast("long").alias("rank"), F.col("n.id").alias("neighbour_id"),
        F.col("n.label").alias("neighbour_label"), F.round("n.distance", 6).alias("distance"))


_SQL_KNN = f"WITH {_SQL_NEAR} SELECT vec_id, rank, neighbour_id, neighbour_label, round(distance, 6) AS distance FROM r WHERE rank <= 5"


@query("knn_neighbours", _SQL_KNN)
def knn_neighbours(spark, d) -> DataFrame:
    return _neighbours(spark, d)


@query("knn_blocks", _SQL_KNN)
def knn_blocks(spark, d) -> DataFrame:
    """The form for training sides beyond the broadcast limit, with small blocks."""
    return _neighbours(spark, d, strategy="blocks", block_rows=256, pivots=8)


@query("knn_approximate", """SELECT vec_id, 10::BIGINT AS found, 0::BIGINT AS wrong_distances, TRUE AS recall_reached
FROM embeddings WHERE vec_id % 100 = 0""")
def knn_approximate(spark, d) -> DataFrame:
    """Every hundredth vector against the inverted lists of all: ten neighbours each, distances as computed directly, and at
    least nine tenths of what an exact search finds."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(0).alias("label"))
    q = e.filter("vec_id % 100 = 0")
    found = A.Index(e, 10, "vec_id").search(q, "vec_id")
    exact = N.knn(q, e, 10, key="vec_id").select("vec_id", F.explode("neighbours").alias("_n")).select("vec_id", F.col("_n.id").alias("id"))
    apart = F.aggregate(F.zip_with("_a", "_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    pairs = found.join(q.select("vec_id", F.col("embedding").alias("_a")), "vec_id").join(
        e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("_b")), "id")
    pairs = pairs.join(exact.withColumn("_true", F.lit(1)), ["vec_id", "id"], "left")
    per = pairs.groupBy("vec_id").agg(F.count("*").alias("found"), F.count("_true").alias("_true"),
                                      F.count_if(F.abs(F.sqrt(apart) - F.col("distance")) > 1e-9).alias("wrong_distances"))
    reached = per.agg(F.sum("_true") >= 0.9 * F.sum("found")).first()[0]
    return per.select("vec_id", "found", "wrong_distances", F.lit(reached).cast("boolean").alias("recall_reached"))


SQL_OOF = _SQL_FOLDS + """,
 d AS (SELECT a.vec_id, a.label, a.fold, b.label AS nl, b.vec_id AS nid,
              list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist FROM f a JOIN f b ON a.fold <> b.fold),
 n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nid) AS k FROM d),
 oof AS (SELECT vec_id, any_value(label)::INT AS label, any_value(fold) AS fold, sum(nl) / 10.0::DOUBLE AS prob1 FROM n WHERE k <= 10 GROUP BY vec_id)"""


def oof_frame(spark, d) -> DataFrame:
    """``vec_id, label, fold, prob0, prob1``: out-of-fold class share of the 10 nearest neighbours."""
    from ..operators.splits import stratified_folds

    e = table(spark, d, "embeddings").withColumn("label", (F.col("label") % 2).cast("int"))
    e = stratified_folds(e, "vec_id", "label", 5)
    p = N.knn_probability(N.knn(e, e, 10, key="vec_id", fold="fold"))
    return e.select("vec_id", "label", "fold").join(p, "vec_id")


@query("knn_oof", f"WITH {SQL_OOF} SELECT vec_id, label, fold, round(prob1, 6) AS prob1, round(1 - prob1, 6) AS prob0 FROM oof")
def knn_oof(spark, d) -> DataFrame:
    return oof_frame(spark, d).select("vec_id", "label", "fold", F.round("prob1", 6).alias("prob1"),
                                      F.round("prob0", 6).alias("prob0"))


STOP = ("the", "and", "of", "to", "in", "de", "la", "le", "und", "der")


@query("tfidf_top_terms", f"""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
             lambda x: x NOT IN ({", ".join(f"'{s}'" for s in STOP)})) AS ws FROM documents),
 t AS (SELECT doc_id, unnest(ws) AS term FROM w UNION ALL
       SELECT doc_id, unnest([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) FROM w),
 f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
 c AS (SELECT count(*) AS n FROM documents),
 v AS (SELECT term, count(*) AS df, ln((1 + any_value(n)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM f, c GROUP BY term
       HAVING count(*) >= 2 AND count(*) <= 0.95::DOUBLE * any_value(n)),
 x AS (SELECT doc_id, term, tf, tf * idf AS x FROM f JOIN v USING (term)),
 y AS (SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 9) AS weight FROM x),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM y)
SELECT doc_id, rank, term, round(weight, 6) AS weight FROM r WHERE rank <= 5""")
def tfidf_top_terms(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    w = X.tfidf(docs, "doc_id", "text", stop_words=STOP).withColumn("weight", F.round("weight", 9))
    return X.top_terms(w, "doc_id", 5).select("doc_id", F.col("rank").cast("long").alias("rank"), "term",
                                              F.round("weight", 6).alias("weight"))


@query("tfidf_weights_shuffled", f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS ws FROM documents),
 f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM w) GROUP BY 1, 2),
 c AS (SELECT count(*) AS n FROM documents),
 v AS (SELECT term, count(*) AS df, ln((1 + any_value(n)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM f, c GROUP BY term
       HAVING count(*) >= 3 AND count(*) <= 0.5::DOUBLE * any_value(n)),
 x AS (SELECT doc_id, term, tf, df, tf * idf AS x FROM f JOIN v USING (term)),
 y AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM x)
SELECT doc_id, count(*) AS terms, sum(tf)::BIGINT AS tokens, sum(df)::BIGINT AS df_total, round(sum(weight), 5) AS weight_total FROM y GROUP BY doc_id""")
def tfidf_weights_shuffled(spark, d) -> DataFrame:
    """Words only, with the join used for vocabularies beyond the broadcast limit."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    w = X.tfidf(docs, "doc_id", "text", min_df=3, max_df=0.5, ngrams=1, stop_words=(), strategy="shuffle")
    return w.groupBy("doc_id").agg(
        F.count("*").alias("terms"), F.sum("tf").alias("tokens"), F.sum("df").alias("df_total"),
        F.round(F.sum("weight"), 5).alias("weight_total"))
