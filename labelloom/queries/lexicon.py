"""Lexicon matching and cleaning. The lexicon is the words, word pairs and word triples of ``benchmark``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import label_text
from ..operators import hybrid, lexicon as X
from ..operators.matching import TermList, flag_any_term, term_hit_counts
from .base import query, table


def lexicon_of(spark, d, words: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``term, definition, category``; definition and category follow from the term's length."""
    ws = F.split(F.col("text"), " ")
    second, third = F.slice(ws, 2, 1 << 20), F.slice(ws, 3, 1 << 20)
    pairs = F.zip_with(ws, second, lambda a, b: F.concat(a, F.lit(" "), b))
    triples = F.zip_with(pairs, third, lambda a, b: F.concat(a, F.lit(" "), b))
    by_size = {1: ws, 2: pairs, 3: triples}
    terms = F.concat(*[by_size[w] for w in words])
    out = table(spark, d, "benchmark").select(F.explode(terms).alias("term"))
    out = out.filter("term is not null and term <> ''").distinct()
    n = F.length("term")
    return out.select(
        "term",
        F.concat(F.when(n % 7 == 0, "ＡＢ 原本 ").when(n % 11 == 0, "通称：").otherwise("plain "), "term").alias("definition"),
        F.when(n % 5 == 0, "Other").when(n % 5 == 1, "some OTHERS").when(n % 5 == 2, "region").alias("category"),
    )


def sql_lexicon(words: tuple[int, ...] = (1, 2, 3)) -> str:
    by_size = {
        1: "ws",
        2: "[ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]",
        3: "[ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]",
    }
    parts = " UNION ".join(f"SELECT unnest({by_size[w]}) AS term FROM bw" for w in words)
    return f"""bw AS (SELECT string_split(text, ' ') AS ws FROM benchmark),
  lex AS (SELECT term, CASE WHEN length(term) % 7 = 0 THEN 'ＡＢ 原本 ' WHEN length(term) % 11 = 0 THEN '通称：' ELSE 'plain ' END || term AS definition,
     CASE length(term) % 5 WHEN 0 THEN 'Other' WHEN 1 THEN 'some OTHERS' WHEN 2 THEN 'region' END AS category
     FROM (SELECT DISTINCT term FROM ({parts}) WHERE term <> ''))"""


_SQL_CORPUS = """corpus AS (SELECT d.doc_id, d.text AS sentence, CASE WHEN l.toxic = 1 THEN 'Potentially' ELSE 'None' END AS label
     FROM documents d JOIN labels l USING (doc_id))"""
_SQL_HITS = """hits AS (SELECT term, count(*) AS hits, count(*) FILTER (label = 'None') AS negative_hits
     FROM lex JOIN corpus ON contains(sentence, term) GROUP BY term)"""


def corpus_of(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.join(table(spark, d, "labels"), "doc_id").select(
        "doc_id", F.col("text").alias("sentence"), label_text("toxic").alias("label"))


@query("lexicon_antijoin", f"""WITH {sql_lexicon()}, {_SQL_CORPUS}
SELECT term FROM lex WHERE NOT EXISTS (SELECT 1 FROM corpus WHERE label = 'None' AND contains(sentence, term))""")
def lexicon_antijoin(spark, d) -> DataFrame:
    return X.terms_without_class(lexicon_of(spark, d), corpus_of(spark, d), "sentence", "label").select("term")


@query("lexicon_hits", f"""WITH {sql_lexicon()}, {_SQL_CORPUS}, {_SQL_HITS}
SELECT term, hits FROM hits WHERE hits >= 3""")
def lexicon_hits(spark, d) -> DataFrame:
    return X.frequent_terms(lexicon_of(spark, d), corpus_of(spark, d), "sentence")


@query("lexicon_hits_join", f"""WITH {sql_lexicon()}, {_SQL_CORPUS}, {_SQL_HITS}
SELECT term, hits FROM hits""")
def lexicon_hits_join(spark, d) -> DataFrame:
    """The strategy for lexicons beyond the broadcast limit."""
    terms = lexicon_of(spark, d)
    return term_hit_counts(corpus_of(spark, d), "sentence", terms, strategy="join")


@query("lexicon_hits_array", """WITH t AS (SELECT DISTINCT string_split(text, ' ')[1] AS term FROM benchmark WHERE text <> '')
SELECT term, count(*) AS hits FROM t JOIN documents ON contains(text, term) GROUP BY term""")
def lexicon_hits_array(spark, d) -> DataFrame:
    """The first word of every benchmark text, matched without leaving the JVM."""
    few = table(spark, d, "benchmark").filter("text <> ''").select(F.split("text", " ")[0].alias("term"))
    return term_hit_counts(table(spark, d, "documents"), "text", few, strategy="array")


@query("lexicon_funnel", f"""WITH {sql_lexicon()}, {_SQL_CORPUS}, {_SQL_HITS},
  j AS (SELECT lex.*, coalesce(hits, 0) AS hits, coalesce(negative_hits, 0) AS negative_hits FROM lex LEFT JOIN hits USING (term)),
  s AS (SELECT CASE WHEN negative_hits > 0 THEN 0 WHEN length(trim(term)) <= 1 THEN 1
      WHEN regexp_full_match(trim(term), '[A-Za-z]{{1,2}}') THEN 2
      WHEN contains(definition, '原本') OR contains(definition, '通称') THEN 3
      WHEN hits < 3 THEN 4 WHEN contains(lower(coalesce(category, '')), 'other') THEN 5 ELSE 6 END AS stage FROM j)
SELECT n.stage::INT AS stage, n.stage_name, count(s.stage) AS terms
FROM (VALUES (0, 'original'), (1, 'not_in_negative'), (2, 'longer_than_one'), (3, 'not_short_latin'),
      (4, 'no_stop_phrase'), (5, 'min_hits'), (6, 'category_ok')) n(stage, stage_name)
LEFT JOIN s ON s.stage >= n.stage GROUP BY 1, 2""")
def lexicon_funnel(spark, d) -> DataFrame:
    return X.funnel(X.lexicon_with_stages(lexicon_of(spark, d), corpus_of(spark, d)))


@query("lexicon_cleaned", f"""WITH {sql_lexicon()}, {_SQL_CORPUS}, {_SQL_HITS}
SELECT term, definition, coalesce(category, '') AS category, hits FROM lex JOIN hits USING (term)
WHERE negative_hits = 0 AND length(trim(term)) > 1 AND NOT regexp_full_match(trim(term), '[A-Za-z]{{1,2}}')
  AND NOT contains(definition, '原本') AND NOT contains(definition, '通称') AND hits >= 1
  AND NOT contains(lower(coalesce(category, '')), 'other')""")
def lexicon_cleaned(spark, d) -> DataFrame:
    staged = X.lexicon_with_stages(lexicon_of(spark, d), corpus_of(spark, d), min_hits=1)
    return X.clean_lexicon(staged).select("term", "definition", F.coalesce("category", F.lit("")).alias("category"), "hits")


@query("lexicon_coverage", f"""WITH {sql_lexicon((3,))}, {_SQL_CORPUS},
  f AS (SELECT label, EXISTS (SELECT 1 FROM lex WHERE contains(sentence, term)) AS hit FROM corpus)
SELECT c.label, count(f.label) AS "rows", count(*) FILTER (f.hit) AS hits,
       round(coalesce(100.0::DOUBLE * count(*) FILTER (f.hit) / nullif(count(f.label), 0), 0.0), 6) AS pct
FROM (VALUES ('None'), ('Potentially')) c(label) LEFT JOIN f USING (label) GROUP BY c.label""")
def lexicon_coverage(spark, d) -> DataFrame:
    out = X.coverage(corpus_of(spark, d), "sentence", "label", lexicon_of(spark, d, (3,)), "doc_id")
    return out.withColumn("pct", F.round("pct", 6))


@query("hybrid_proba", f"""WITH {sql_lexicon((3,))},
  f AS (SELECT doc_id, ((doc_id * 37) % 101) / 100.0::DOUBLE AS p, EXISTS (SELECT 1 FROM lex WHERE contains(text, term)) AS hit FROM documents)
SELECT doc_id, hit::INT AS hit, (hit OR p >= 0.5)::INT AS prediction,
       round(CASE WHEN hit THEN greatest(p, 0.98) ELSE p END, 6) AS soft_prob1,
       round(1 - CASE WHEN hit THEN greatest(p, 0.98) ELSE p END, 6) AS soft_prob0,
       round(CASE WHEN hit THEN 1.0 ELSE p END, 6) AS hard_prob1,
       round(ln(least(greatest(CASE WHEN hit THEN 1.0 ELSE p END, 1e-12), 1 - 1e-12)
         / (1 - least(greatest(CASE WHEN hit THEN 1.0 ELSE p END, 1e-12), 1 - 1e-12))), 3) AS hard_logit
FROM f""")
def hybrid_proba(spark, d) -> DataFrame:
    from ..functions.vectors import logit

    docs = table(spark, d, "documents").select("doc_id", "text")
    flagged = flag_any_term(docs, "text", TermList(lexicon_of(spark, d, (3,))), "doc_id").select(
        "doc_id", "hit", (((F.col("doc_id") * 37) % 101) / F.lit(100.0)).alias("prob1"))
    soft = hybrid.hybrid_scores(flagged)
    both = hybrid.hybrid_scores(
        soft.withColumnsRenamed({"prob1": "soft_prob1", "prob0": "soft_prob0"})
        .withColumn("prob1", ((F.col("doc_id") * 37) % 101) / F.lit(100.0)), hard_override=True)
    return both.select("doc_id", "hit", "prediction", F.round("soft_prob1", 6).alias("soft_prob1"),
                       F.round("soft_prob0", 6).alias("soft_prob0"), F.round("prob1", 6).alias("hard_prob1"),
                       F.round(logit("prob1"), 3).alias("hard_logit"))


@query("usable_terms", """SELECT DISTINCT trim(w, ' ' || chr(10)) AS term FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)
WHERE trim(w, ' ' || chr(10)) <> ''""")
def usable_terms(spark, d) -> DataFrame:
    """Every distinct stripped word of the documents as a lexicon."""
    words = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("term"))
    return X.usable_terms(words)
