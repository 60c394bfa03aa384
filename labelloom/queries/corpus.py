"""Cleaning, label policies, record filters, fan-out, joins and unions over the document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import labels as L, text as X
from ..operators import joins, pivot, tasks
from ..operators.ranking import row_ordinal
from ..plans import corpora
from .base import query, sql_strip, table

RAW_LABELS = ("Potentially", "None", None, "", " potentially ", "NONE", "nan", "Possible", "TRUE", "false")


def raw_label(key: str) -> Column:
    """One of the ten spellings, by key."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(RAW_LABELS):
        out = F.when(F.col(key) % 10 == i, F.lit(v)).otherwise(out)
    return out


SQL_RAW = "CASE doc_id % 10 " + " ".join(
    f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(RAW_LABELS)
) + " END"


def _sql_sanitize(c: str) -> str:
    return sql_strip(f"replace(replace(replace(coalesce({c}, ''), chr(9), '\\t'), chr(13), '\\r'), chr(10), '\\n')")


_SQL_STRIPPED = sql_strip(sql_strip("q") + " || ' ' || " + sql_strip("coalesce(c, '')"))


@query("sanitize_documents", f"""
SELECT doc_id, md5({_sql_sanitize('text')}) AS text_md5, length({_sql_sanitize('text')}) AS text_len,
       {_sql_sanitize('lang')} AS lang, {_sql_sanitize('source')} AS source,
       md5({sql_strip("replace(text, chr(12288), ' ')")}) AS spaced_md5
FROM documents""")
def sanitize_documents(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    docs = docs.withColumn("spaced_md5", F.md5(X.normalize_spaces("text")))
    clean = X.sanitize_columns(docs, ["text", "lang", "source"])
    return clean.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("text_len"),
                        "lang", "source", "spaced_md5")


@query("compose_question", f"""
WITH x AS (SELECT d.doc_id, d.text AS q,
                  CASE WHEN l.toxic = 1 THEN '  ' || d.lang || chr(10) WHEN l.toxic = 0 THEN '' END AS c,
                  CASE WHEN l.quality = 1 THEN d.source WHEN l.quality = 0 THEN '' END AS s
           FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id,
       md5(array_to_string(list_filter([{_sql_sanitize('q')}, {_sql_sanitize('c')}, {_sql_sanitize('s')}],
                                       lambda p: p <> ''), ' ')) AS joined_md5,
       md5(q || ' ' || coalesce(c, '')) AS with_desc_md5,
       md5({_SQL_STRIPPED}) AS stripped_md5,
       md5(q || coalesce(c, '')) AS with_context_md5,
       coalesce(nullif(s, ''), nullif(c, ''), doc_id::VARCHAR) AS first_text
FROM x""")
def compose_question(spark, d) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    x = docs.join(labels, "doc_id", "left").select(
        "doc_id", F.col("text").alias("q"),
        F.when(F.col("toxic") == 1, F.concat(F.lit("  "), "lang", F.lit("\n")))
        .when(F.col("toxic") == 0, F.lit("")).alias("c"),
        F.when(F.col("quality") == 1, F.col("source")).when(F.col("quality") == 0, F.lit("")).alias("s"),
    )
    return x.select(
        "doc_id",
        F.md5(X.join_nonempty(["q", "c", "s"])).alias("joined_md5"),
        F.md5(X.question_with_desc("q", "c")).alias("with_desc_md5"),
        F.md5(X.question_with_desc_stripped("q", "c")).alias("stripped_md5"),
        F.md5(X.question_with_context("q", "c")).alias("with_context_md5"),
        X.first_text(x, ("s", "c")).alias("first_text"),
    )


@query("label_policies", f"""
WITH r AS (SELECT doc_id, {SQL_RAW} AS raw FROM labels),
     s AS (SELECT *, {sql_strip("coalesce(raw, '')")} AS st, lower({sql_strip("coalesce(raw, '')")}) AS low FROM r)
SELECT doc_id,
       (low = 'potentially')::INT AS strict_positive,
       (low NOT IN ('', 'none', 'nan'))::INT AS non_empty,
       (st NOT IN ('', 'None', 'none', 'nan', 'NaN'))::INT AS non_empty_cs,
       (low IN ('1', 'true', 'yes', 'y', 'potentially', 'pos', 'positive'))::INT AS truthy,
       (low NOT IN ('', 'none'))::INT AS roc,
       CASE WHEN low LIKE 'potential%' THEN 'Potentially' ELSE 'None' END AS prefix,
       CASE WHEN low IN ('', 'nan') THEN 'None' ELSE raw END AS fill_none,
       coalesce(CASE upper(raw) WHEN 'TRUE' THEN 'Potentially' WHEN 'FALSE' THEN 'None' END, '-') AS true_false,
       coalesce(CASE WHEN low NOT IN ('', 'none', 'nan', 'null', 'na', 'n/a') THEN raw END, '-') AS literal
FROM s""")
def label_policies(spark, d) -> DataFrame:
    r = table(spark, d, "labels").select("doc_id", raw_label("doc_id").alias("raw"))
    return r.select(
        "doc_id",
        *[L.normalize_label("raw", p).alias(p) for p in (*L.BINARY_POLICIES, "prefix", "fill_none")],
        F.coalesce(L.normalize_label("raw", "true_false"), F.lit("-")).alias("true_false"),
        F.coalesce(X.null_tokens("raw"), F.lit("-")).alias("literal"),
    )


@query("hateful_keys", """
WITH r AS (SELECT doc_id,
     CASE WHEN toxic = 1 THEN ' Hate' ELSE 'non-hate' END AS h1,
     CASE doc_id % 5 WHEN 0 THEN 'others' WHEN 1 THEN 'Sexism, others' WHEN 2 THEN 'Region' WHEN 3 THEN 'null ' END AS g1,
     CASE WHEN doc_id % 3 = 0 THEN 'hate' END AS h2, 'Racism, Sexism' AS g2,
     CASE WHEN quality = 0 THEN 'HATE' ELSE 'x' END AS h4 FROM labels),
  s AS (SELECT doc_id, (lower(trim(h1)) = 'hate' OR coalesce(h2, '') = 'hate' OR lower(h4) = 'hate') AS any_hate,
     coalesce(upper(trim(g1)) = 'NULL', false) AS has_null,
     (lower(trim(h1)) = 'hate' AND g1 IS NOT NULL
        AND NOT list_contains(list_transform(string_split(g1, ','), lambda t: lower(trim(t))), 'others'))
       OR coalesce(h2, '') = 'hate' AS named FROM r)
SELECT doc_id, any_hate::INT AS any_hateful, has_null::INT AS has_null, named::INT AS named_group,
       (NOT has_null AND named)::INT AS kept FROM s""")
def hateful_keys(spark, d) -> DataFrame:
    g1 = (F.when(F.col("doc_id") % 5 == 0, "others").when(F.col("doc_id") % 5 == 1, "Sexism, others")
          .when(F.col("doc_id") % 5 == 2, "Region").when(F.col("doc_id") % 5 == 3, "null "))
    entries = {
        "content": F.col("doc_id").cast("string"),
        "Q1 hateful": F.when(F.col("toxic") == 1, " Hate").otherwise("non-hate"), "Q1 Group": g1,
        "Q2 hateful": F.when(F.col("doc_id") % 3 == 0, "hate"), "Q2 Group": F.lit("Racism, Sexism"),
        "Q4  hateful": F.when(F.col("quality") == 0, "HATE").otherwise("x"),
    }
    rec = F.create_map(*[c for k, v in entries.items() for c in (F.lit(k), v)])
    r = table(spark, d, "labels").select("doc_id", rec.alias("record"))
    return r.select(
        "doc_id", L.any_hateful("record").alias("any_hateful"),
        L.has_null_token("record").cast("int").alias("has_null"),
        L.hate_with_named_group("record").cast("int").alias("named_group"),
        L.keep_span_record("record").cast("int").alias("kept"),
    )


@query("short_documents", """
SELECT doc_id, '' AS qid, '' AS category, lang || ':' || source AS title, '' AS "desc", md5(text) AS answer_md5
FROM documents WHERE length(text) < 1024 AND lower(lang) NOT IN ('', 'none', 'nan')""")
def short_documents(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").filter(~X.is_missing_title("lang") & (F.length("text") < 1024))
    return docs.select("doc_id", F.lit("").alias("qid"), F.lit("").alias("category"),
                       F.concat("lang", F.lit(":"), "source").alias("title"), F.lit("").alias("desc"),
                       F.md5("text").alias("answer_md5"))


@query("qid_extract", """
SELECT event_id, CASE event_id % 4 WHEN 2 THEN '' WHEN 3 THEN ''
       ELSE (props::JSON ->> '$.k') END AS qid FROM events""")
def qid_extract(spark, d) -> DataFrame:
    renamed = F.replace(F.col("props"), F.lit('"k"'), F.lit('"question_id"'))
    meta = (F.when(F.col("event_id") % 4 == 0, renamed)
            .when(F.col("event_id") % 4 == 1, F.replace(renamed, F.lit("}"), F.lit(".0}")))
            .when(F.col("event_id") % 4 == 2, F.lit("not json")).otherwise(F.lit("{}")))
    return table(spark, d, "events").select("event_id", X.extract_qid(meta).alias("qid"))


@query("task_fanout", """
WITH r AS (SELECT d.doc_id, d.text AS t,
     CASE WHEN l.quality = 1 THEN 'Yes' WHEN l.quality = 0 THEN 'No' END AS p,
     CASE WHEN l.toxic = 1 THEN 'No' WHEN doc_id % 2 = 0 THEN 'Yes' END AS e,
     CASE WHEN doc_id % 3 > 0 THEN d.lang ELSE '' END AS ps, CASE WHEN doc_id % 5 > 0 THEN d.source END AS es,
     CASE WHEN doc_id % 7 > 0 THEN 'Clear' END AS q, CASE WHEN doc_id % 4 > 0 THEN 'soon' END AS v
   FROM documents d LEFT JOIN labels l USING (doc_id)),
 f AS (SELECT doc_id, t, coalesce(p, 'No') AS p, coalesce(e, 'No') AS e, ps, coalesce(es, '') AS es,
              coalesce(q, 'N/A') AS q, v FROM r),
 six AS (
  SELECT doc_id, 'promise_status' AS task, t AS x, 'Yes' AS y FROM f WHERE p = 'Yes' AND ps <> ''
  UNION ALL SELECT doc_id, 'promise_status', ps, 'Yes' FROM f WHERE p = 'Yes' AND ps <> ''
  UNION ALL SELECT doc_id, 'promise_status', t, p FROM f WHERE p <> 'Yes'
  UNION ALL SELECT doc_id, 'promise_string', t, ps FROM f WHERE p = 'Yes' AND ps <> ''
  UNION ALL SELECT doc_id, 'evidence_status', t, 'Yes' FROM f WHERE p = 'Yes' AND e = 'Yes' AND es <> ''
  UNION ALL SELECT doc_id, 'evidence_status', es, 'Yes' FROM f WHERE p = 'Yes' AND e = 'Yes' AND es <> ''
  UNION ALL SELECT doc_id, 'evidence_status', t, e FROM f WHERE p = 'Yes' AND e <> 'Yes'
  UNION ALL SELECT doc_id, 'evidence_string', t, es FROM f WHERE p = 'Yes' AND e = 'Yes' AND es <> ''
  UNION ALL SELECT doc_id, 'evidence_quality', t, q FROM f WHERE p = 'Yes' AND e = 'Yes'
  UNION ALL SELECT doc_id, 'verification_timeline', t, coalesce(v, 'No') FROM f WHERE p = 'Yes'),
 four AS (
  SELECT doc_id, 'promise_status' AS task, t AS x, p AS y FROM f
  UNION ALL SELECT doc_id, 'evidence_status', t, e FROM f WHERE p = 'Yes'
  UNION ALL SELECT doc_id, 'evidence_quality', t, q FROM f WHERE p = 'Yes' AND e = 'Yes'
  UNION ALL SELECT doc_id, 'verification_timeline', t, coalesce(v, 'N/A') FROM f WHERE p = 'Yes')
SELECT 6 AS tasks, doc_id, task, md5(x) AS x_md5, y FROM six
UNION ALL SELECT 4, doc_id, task, md5(x), y FROM four""")
def task_fanout(spark, d) -> DataFrame:
    key = F.col("doc_id")
    rec = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(
        "doc_id", F.col("text").alias("extracted_text"), F.col("text").alias("data"),
        F.when(F.col("quality") == 1, "Yes").when(F.col("quality") == 0, "No").alias("promise_status"),
        F.when(F.col("toxic") == 1, "No").when(key % 2 == 0, "Yes").alias("evidence_status"),
        F.when(key % 3 > 0, F.col("lang")).otherwise("").alias("promise_string"),
        F.when(key % 5 > 0, F.col("source")).alias("evidence_string"),
        F.when(key % 7 > 0, "Clear").alias("evidence_quality"),
        F.when(key % 4 > 0, "soon").alias("verification_timeline"),
    )
    six = tasks.six_tasks(rec, "doc_id").withColumn("tasks", F.lit(6))
    four = tasks.four_tasks(rec, "doc_id").withColumn("tasks", F.lit(4))
    return six.unionByName(four).select("tasks", "doc_id", "task", F.md5("x").alias("x_md5"), "y")


@query("lookup_first", """
WITH r AS (SELECT source AS idx, doc_id AS row_index, text AS q, CASE WHEN doc_id % 2 = 0 THEN lang END AS c FROM documents),
     f AS (SELECT idx, min(row_index) AS row_index FROM r GROUP BY idx)
SELECT l.doc_id, 'src' || (l.doc_id % 25) AS idx, md5(r.q || coalesce(r.c, '')) AS text_md5
FROM labels l JOIN f ON f.idx = 'src' || (l.doc_id % 25) JOIN r ON r.idx = f.idx AND r.row_index = f.row_index""")
def lookup_first(spark, d) -> DataFrame:
    left = table(spark, d, "labels").select(
        "doc_id", F.concat(F.lit("src"), (F.col("doc_id") % 25).cast("string")).alias("idx"))
    right = table(spark, d, "documents").select(
        F.col("source").alias("idx"), F.col("doc_id").alias("row_index"),
        X.question_with_context("text", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).alias("text"))
    out = joins.lookup_first(left, right, "idx", "row_index")
    return out.select("doc_id", "idx", F.md5("text").alias("text_md5"))


@query("topic_gold", """
WITH g AS (SELECT doc_id::VARCHAR AS idx, quality AS a, toxic AS b, (doc_id % 3)::VARCHAR AS c,
                  CASE doc_id % 4 WHEN 0 THEN '1.0' WHEN 1 THEN 'x' WHEN 2 THEN '1.9' END AS e FROM labels)
SELECT g.idx, md5(d.text || CASE WHEN d.doc_id % 2 = 0 THEN d.lang ELSE '' END) AS text_md5,
       array_to_string(list_filter([CASE WHEN a = 1 THEN '4' END, CASE WHEN b = 1 THEN '7' END,
         CASE WHEN c = '1' THEN '0' END, CASE WHEN e IN ('1.0', '1.9') THEN 'w' END], lambda x: x IS NOT NULL), ',') AS groups
FROM g JOIN documents d ON d.doc_id::VARCHAR = g.idx""")
def topic_gold(spark, d) -> DataFrame:
    k = F.col("doc_id")
    flags = table(spark, d, "labels").select(
        k.alias("idx"), F.col("quality").alias("topics_地域"), F.col("toxic").alias("topics_性别"),
        (k % 3).cast("string").alias("topics_职业教育"),
        F.when(k % 4 == 0, "1.0").when(k % 4 == 1, "x").when(k % 4 == 2, "1.9").alias("topics_其他"))
    texts = table(spark, d, "documents").select(
        k.alias("idx"), k.alias("row_index"), F.col("text").alias("q"), F.when(k % 2 == 0, F.col("lang")).alias("c"))
    gold = joins.topic_gold(flags, texts)
    return gold.select("idx", F.md5("text").alias("text_md5"), F.array_join("groups", ",").alias("groups"))


@query("union_relabel", f"""
WITH u AS (SELECT doc_id, 'train' AS part, {SQL_RAW} AS raw FROM labels
   UNION ALL SELECT doc_id, 'new', CASE upper(CASE WHEN toxic = 1 THEN 'True' WHEN quality = 1 THEN 'false' ELSE 'maybe' END)
                                   WHEN 'TRUE' THEN 'Potentially' WHEN 'FALSE' THEN 'None' END FROM labels)
SELECT doc_id, part, CASE WHEN lower({sql_strip("coalesce(raw, '')")}) IN ('', 'nan') THEN 'None' ELSE raw END AS label FROM u""")
def union_relabel(spark, d) -> DataFrame:
    labels = table(spark, d, "labels")
    train = labels.select("doc_id", F.lit("train").alias("part"), raw_label("doc_id").alias("label"))
    new_raw = F.when(F.col("toxic") == 1, "True").when(F.col("quality") == 1, "false").otherwise("maybe")
    new = labels.select("doc_id", F.lit("new").alias("part"), L.normalize_label(new_raw, "true_false").alias("label"))
    return joins.union_relabelled([train, new], "label")


@query("exclusion_antijoin", """
WITH x AS (SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id::VARCHAR WHEN doc_id % 3 = 1 THEN (doc_id + 1)::VARCHAR || '.0'
                  ELSE 'bad' END AS row_index FROM labels WHERE toxic = 1),
     e AS (SELECT DISTINCT try_cast(try_cast(row_index AS DOUBLE) AS BIGINT) AS row_index FROM x)
SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT row_index FROM e WHERE row_index IS NOT NULL)""")
def exclusion_antijoin(spark, d) -> DataFrame:
    labels, k = table(spark, d, "labels"), F.col("doc_id")
    raw = (F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat((k + 1).cast("string"), F.lit(".0")))
           .otherwise("bad"))
    listed = labels.filter("toxic = 1").select(raw.try_cast("double").cast("long").alias("doc_id"))
    return joins.drop_listed(labels, listed.filter("doc_id is not null"), "doc_id").select("doc_id", "quality")


@query("row_ordinals", "SELECT doc_id, row_number() OVER () - 1 AS row_index FROM documents")
def row_ordinals(spark, d) -> DataFrame:
    return row_ordinal(table(spark, d, "documents")).select("doc_id", "row_index")


@query("dynamic_pivot", """
WITH m AS (SELECT user_id, event_type, round(sum(value), 4) AS v FROM events
           WHERE event_type <> 'signup' OR user_id % 2 = 0 GROUP BY 1, 2)
SELECT user_id,
       coalesce(max(v) FILTER (event_type = 'click'), -1) AS "click_and_x_y_confidence",
       coalesce(max(v) FILTER (event_type = 'error'), -1) AS "error_and_x_y_confidence",
       coalesce(max(v) FILTER (event_type = 'purchase'), -1) AS "purchase_and_x_y_confidence",
       coalesce(max(v) FILTER (event_type = 'signup'), -1) AS "signup_and_x_y_confidence",
       coalesce(max(v) FILTER (event_type = 'view'), -1) AS "view_and_x_y_confidence"
FROM m GROUP BY user_id""")
def dynamic_pivot(spark, d) -> DataFrame:
    ev = table(spark, d, "events").filter((F.col("event_type") != "signup") | (F.col("user_id") % 2 == 0))
    per_type = ev.groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("v"))
    key = F.concat("event_type", F.lit(" & x/y,"))
    rows = per_type.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct(key, "v"))).alias("scores"))
    names = pivot.categories_of(ev.select(F.create_map(key, F.col("value")).alias("scores")))
    wide = pivot.widen_scores(rows, categories=names)
    return wide.select("user_id", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in names])


@query("upsert_results", """
WITH e AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views
           FROM events WHERE event_type IN ('click', 'view') AND user_id % 3 > 0 GROUP BY 1),
     u AS (SELECT user_id, nullif(count(*) FILTER (event_type = 'click'), 1) * 10 AS clicks,
                  count(*) FILTER (event_type = 'purchase') AS buys
           FROM events WHERE user_id % 2 = 0 GROUP BY 1)
SELECT coalesce(e.user_id, u.user_id) AS user_id, coalesce(u.buys, -1) AS buys,
       coalesce(CASE WHEN u.user_id IS NOT NULL THEN u.clicks ELSE e.clicks END, -1) AS clicks,
       coalesce(e.views, -1) AS views
FROM e FULL JOIN u ON e.user_id = u.user_id""")
def upsert_results(spark, d) -> DataFrame:
    ev = table(spark, d, "events")
    is_type = {t: F.count_if(F.col("event_type") == t) for t in ("click", "view", "purchase")}
    existing = ev.filter(F.col("event_type").isin("click", "view") & (F.col("user_id") % 3 > 0)).groupBy("user_id").agg(
        is_type["click"].alias("clicks"), is_type["view"].alias("views"))
    updates = ev.filter(F.col("user_id") % 2 == 0).groupBy("user_id").agg(
        (F.nullif(is_type["click"], F.lit(1)) * 10).alias("clicks"), is_type["purchase"].alias("buys"))
    return joins.upsert(existing, updates, "user_id").fillna(-1)


@query("harmless_rows", """
SELECT md5(d.text) AS text_md5, 'None' AS label, count(*) AS n FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 0
GROUP BY 1, 2""")
def harmless_rows(spark, d) -> DataFrame:
    """Rows whose label is 0; the label arrives as a number in text."""
    recs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(
        "text", F.concat(F.col("toxic").cast("string"), F.lit(".0")).alias("label"))
    out = corpora.harmless_rows(recs)
    return out.groupBy(F.md5(corpora.TEXT).alias("text_md5"), F.col(corpora.LABEL).alias("label")).agg(F.count("*").alias("n"))


@query("instruction_records", """
SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id::VARCHAR ELSE '' END AS qid, '' AS category, lang AS title, '' AS "desc",
       md5(text) AS answer_md5, source AS "SOURCE", coalesce(upvotes, '-') AS upvotes
FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN n_chars::VARCHAR END AS upvotes FROM documents) WHERE length(text) < 1024""")
def instruction_records(spark, d) -> DataFrame:
    k = F.col("doc_id")
    meta = F.when(k % 3 == 0, F.concat(F.lit('{"question_id": '), k.cast("string"), F.lit(".0}"))).when(k % 3 == 1, "{}")
    raw = table(spark, d, "documents").select(
        F.col("lang").alias("INSTRUCTION"), F.col("text").alias("RESPONSE"), F.col("source").alias("SOURCE"),
        meta.alias("METADATA"), F.when(k % 2 == 0, F.col("n_chars").cast("string")).alias("upvotes"))
    out = corpora.instruction_records(raw)
    return out.select("qid", "category", "title", "desc", F.md5("answer").alias("answer_md5"), "SOURCE",
                      F.coalesce("upvotes", F.lit("-")).alias("upvotes"))


@query("span_table", """
WITH r AS (SELECT doc_id, toxic, quality FROM labels)
SELECT md5(d.text) AS text_md5, CASE WHEN toxic = 1 OR quality = 0 THEN 'Potentially' ELSE 'None' END AS label, count(*) AS n
FROM r JOIN documents d USING (doc_id) WHERE toxic = 1 AND d.lang NOT IN ('de', 'fr') GROUP BY 1, 2""")
def span_table(spark, d) -> DataFrame:
    """Span records built from the documents: pruned, then text and label."""
    entries = {
        "content": F.col("text"), "Q1 hateful": F.when(F.col("toxic") == 1, "HATE").otherwise("none"),
        "Q1 Group": F.when(F.col("lang") == "de", "Others").when(F.col("lang") == "fr", " NULL").otherwise("Region, x"),
        "Q9 hateful": F.when(F.col("quality") == 0, "hate").otherwise("none"),
    }
    rec = F.create_map(*[c for k, v in entries.items() for c in (F.lit(k), v)])
    recs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(rec.alias("record"))
    out = corpora.span_records_to_table(recs)
    return out.groupBy(F.md5(corpora.TEXT).alias("text_md5"), F.col(corpora.LABEL).alias("label")).agg(F.count("*").alias("n"))
