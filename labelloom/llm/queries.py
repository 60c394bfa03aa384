"""The registered queries of the subpackage: thin contracts over its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import byte_windows, conversations, decontamination, factorisation, html_text, merkle, mixing, quality, secrets, simhash, token_files, url_filter, word_windows
from .base import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


@query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("secrets")
    base = [k.name for k in secrets.BASE_KINDS]
    d = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(
        "doc_id", *(secrets.count_of(spans, k).alias(f"n_{k}") for k in base),
        F.sha2(secrets.spans_text(spans, base), 256).alias("base_sha256"),
        secrets.spans_text(spans).alias("spans"))


# The rules of the contract.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_RULE_CASES = [  # longest first
    ("example.net/en/", "(host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/')", "allow"),
    ("example.com/de/", "(host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/')", "block"),
    ("org/fr/", "(host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/')", "allow"),
    ("net/", "(host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/')", "block"),
]
_SQL_URLS = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT page_id, host, path,
  CASE {' '.join(f"WHEN {test} THEN '{rule}'" for rule, test, _ in _RULE_CASES)} END AS rule,
  CASE {' '.join(f"WHEN {test} THEN '{verdict}'" for _, test, verdict in _RULE_CASES)} ELSE 'allow' END AS verdict
FROM parts"""


@query("op2_url_filter", _SQL_URLS)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules).drop("url")


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    q = F.col("_quality")
    return d.select("doc_id", *(q[c].alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance",
        "word_distance")))


@query("op9_html_extraction")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = html_text.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return d.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op3_simhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_CONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0))),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hits AS (SELECT dw.doc_id, dw.k, dw.i, bw.item_id FROM dw JOIN bw USING (k, phrase)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query("op5_benchmark_decontamination", _SQL_CONTAMINATION)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                    F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def sql_mixture(docs: str) -> str:
    """The mixture of the rows of ``docs`` (doc_id, text, source) as SQL."""
    q, block = mixing.CYCLE, mixing.BLOCK_CHARS
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, length(coalesce(text, ''))::BIGINT AS chars,
    md5('{mixing.SEED}:' || doc_id::VARCHAR) AS h FROM {docs}),
w AS (SELECT source, greatest(floor(sqrt(sum(chars)::DOUBLE))::BIGINT, 1) AS w FROM d GROUP BY source),
base AS (SELECT source, w, greatest((w::HUGEINT * {q}) // (sum(w) OVER ()), 1)::BIGINT AS b, (sum(w) OVER ())::HUGEINT AS all_w FROM w),
ranked AS (
  SELECT source, b, {q} - sum(b) OVER () AS rest,
    row_number() OVER (ORDER BY w::HUGEINT * {q} - b * all_w DESC, source) AS r,
    row_number() OVER (ORDER BY b DESC, source) AS s FROM base),
slots AS (
  SELECT source, (b + CASE WHEN rest > 0 AND r <= rest THEN 1 WHEN rest < 0 AND s = 1 THEN rest ELSE 0 END)::BIGINT AS a,
    row_number() OVER (ORDER BY source) AS i FROM ranked),
edf AS (
  SELECT -1 AS t, list(0::BIGINT ORDER BY i) AS done, 0::BIGINT AS pick, list(a ORDER BY i) AS a FROM slots
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, i: x + (i = p)::BIGINT), p, a FROM (
    SELECT t, done, a, list_sort(list_transform(list_filter(range(1, len(a) + 1),
        lambda i: done[i] < a[i] AND (done[i] * {q}) // a[i] <= t + 1),
        lambda i: {{'deadline': ((done[i] + 1) * {q} + a[i] - 1) // a[i], 'i': i}}))[1].i AS p FROM edf)
  WHERE t + 1 < {q}),
turns AS (SELECT pick, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM edf WHERE t >= 0),
placed AS (
  SELECT doc_id, source, (sum(chars) OVER (PARTITION BY source ORDER BY h, chars, doc_id ROWS UNBOUNDED PRECEDING) - chars)::BIGINT AS start
  FROM d)
SELECT doc_id, p.source, start // {block} AS block, start,
  (start // {block} // a) * {q} + ((start // {block} % a) * {q}) // a AS release,
  (start // {block} // a) * {q} + (((start // {block} % a) + 1) * {q} + a - 1) // a AS deadline,
  (start // {block} // a) * {q} + turns.slot AS slot
FROM placed p JOIN slots ON slots.source = p.source JOIN turns ON turns.pick = slots.i AND turns.nth = start // {block} % a"""


@query("op7_source_mixing", sql_mixture("documents"))
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = factorisation.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return factorisation.score(docs, model).select(
        "doc_id", factorisation.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_substring_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = word_windows.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    r = F.col("_repeats")
    return d.select("doc_id", r["n_words"].alias("n_words"), r["n_removed"].alias("n_removed"),
                    F.sha2(r["kept"], 256).alias("kept_sha256"))


@query("op6_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = byte_windows.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    r = F.col("_repeats")
    return d.select("doc_id", r["n_bytes"].alias("n_bytes"), r["n_removed"].alias("n_removed"),
                    F.size(r["spans"]).cast("bigint").alias("n_spans"), F.sha2(r["kept"], 256).alias("kept_sha256"))


def sql_crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string as a DuckDB expression: one step for each byte and bit."""
    bit = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    eight = "list_reduce([xor(c, b)::UBIGINT, 0, 1, 2, 3, 4, 5, 6, 7]::UBIGINT[], lambda r, i: " + bit.format("r") + ")"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {codes}), lambda c, b: {eight}), 4294967295::UBIGINT)"


def _sql_field(c: str) -> str:
    return f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_sql_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


_SQL_MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_sql_leaf("n_chars")} AS leaf,
    CASE WHEN {sql_crc32("doc_id::VARCHAR")} % 7 = 0 AND n_chars IS NOT NULL THEN {_sql_leaf("n_chars + 1")} ELSE {_sql_leaf("n_chars")} END AS given
  FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS r FROM d),
nodes AS (
  SELECT lang, 0 AS k, list(leaf ORDER BY r) AS l FROM ranked GROUP BY lang
  UNION ALL
  SELECT lang, k + 1, list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], '')))
  FROM nodes WHERE len(l) > 1),
subroots AS (SELECT lang, l[1] AS subroot, k AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM nodes WHERE len(l) = 1),
tops AS (
  SELECT 0 AS k, list(subroot ORDER BY g) AS l FROM subroots HAVING count(*) > 0
  UNION ALL
  SELECT k + 1, list_transform(range(0, (len(l) + 1) // 2), lambda i: sha256(l[2 * i + 1] || coalesce(l[2 * i + 2], '')))
  FROM tops WHERE len(l) > 1),
roots AS (SELECT l[1] AS root FROM tops WHERE len(l) = 1),
steps AS (
  SELECT r.lang, r.r, n.k AS level, (r.r >> n.k) & 1 AS pos, coalesce(n.l[xor(r.r >> n.k, 1) + 1], '') AS sib
  FROM ranked r JOIN nodes n ON n.lang IS NOT DISTINCT FROM r.lang AND len(n.l) > 1
  UNION ALL
  SELECT r.lang, r.r, s.height + t.k, (s.g >> t.k) & 1, coalesce(t.l[xor(s.g >> t.k, 1) + 1], '')
  FROM ranked r JOIN subroots s ON s.lang IS NOT DISTINCT FROM r.lang JOIN tops t ON len(t.l) > 1),
proofs AS (SELECT lang, r, list({{'pos': pos, 'sib': sib}} ORDER BY level) AS p FROM steps GROUP BY lang, r),
folded AS (
  SELECT ranked.lang, ranked.r, 0 AS k, given AS h, coalesce(p, []) AS p FROM ranked
  LEFT JOIN proofs ON proofs.lang IS NOT DISTINCT FROM ranked.lang AND proofs.r = ranked.r
  UNION ALL
  SELECT lang, r, k + 1, CASE WHEN p[k + 1].pos = 0 THEN sha256(h || p[k + 1].sib) ELSE sha256(p[k + 1].sib || h) END, p
  FROM folded WHERE k < len(p))
SELECT d.doc_id, d.leaf, s.subroot, roots.root, sha256(array_to_string(list_transform(f.p, lambda x: x.sib), '')) AS proof_sha256,
  f.h AS folded_root, f.h = roots.root AS verified
FROM ranked d JOIN folded f ON f.lang IS NOT DISTINCT FROM d.lang AND f.r = d.r AND f.k = len(f.p)
JOIN subroots s ON s.lang IS NOT DISTINCT FROM d.lang CROSS JOIN roots"""


@query("op12_merkle_manifest", _SQL_MERKLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    one_more = merkle.leaf_hash(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in docs.columns))
    changed = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    d = merkle.manifest(docs, carry={"tampered": F.when(changed, one_more)})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    return d.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(merkle.siblings(F.col("proof")), ""), 256).alias("proof_sha256"),
                    folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage, by the checksum of a row's id and turn."""
    d = rows.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    ident = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    d = d.withColumn("_kind", (F.crc32(ident) % 20).cast("int")).filter("_kind != 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return d.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    times.alias("_times")).drop("_times")


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return conversations.Repair(damaged(given)).report(given)


@query("op11_token_files")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = token_files.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                      public_tokenizers.path("word_bpe_49k.json"), end=1, words=token_files.LATIN_WORDS)
    return token_files.read_tokens(spark, folder).select(
        F.col("key").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
