"""The registered queries opN_<name>, each over its whole table, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from partloom.llm import alignment, class_lm, decontamination, embedding_dups, exact_spans, fill_in_middle, html_text, language_id, packing, quality_ranker, simhash, url_filter
from partloom.llm.base import fold, table
from partloom.llm.quality_rules import quality_rules


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 3) == 1
    model = language_id.fit(docs.where(~held))
    return language_id.predict(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": held})


def url_list(pages):
    """The tables hold no URL list, so one is made by rule: hosts, their parent domains and first path segments get
    dated entries that hashes of their names choose, over the year in which pages count as fetched."""
    hosts = pages.select(url_filter.host(F.col("url")).alias("h")).where("h <> ''").distinct()
    names = hosts.select("h").union(hosts.select(F.substring_index("h", ".", -3).alias("h"))).distinct()
    part = lambda at: F.conv(F.substring(F.md5("h"), at, 4), 16, 10).cast("int")
    named = names.select("h", part(1).alias("a"), part(5).alias("b"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n).cast("timestamp").alias("since")
    rows = [
        named.where("a % 3 = 0").select(F.col("h").alias("scope"), day(F.col("a") % 200), F.lit("block").alias("action")),
        named.where("a % 6 = 0").select(F.col("h").alias("scope"), day(F.col("a") % 200 + 60), F.lit("clear").alias("action")),
        named.where("a % 12 = 0").select(F.col("h").alias("scope"), day(F.col("a") % 200 + 120), F.lit("block").alias("action")),
        named.where("b % 4 = 0").select(F.concat("h", F.lit("/en")).alias("scope"), day(F.col("b") % 300), F.lit("allow").alias("action")),
    ]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


def op2_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.timestamp_add("MINUTE", (F.col("page_id") * 7919 % 525600).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    out = url_filter.judge(pages.withColumn("fetched", fetched), url_list(pages))
    return out.select("page_id", "url", "rule_scope", F.date_format("rule_since", "yyyy-MM-dd").alias("rule_since"), "blocked")


OP2_SQL = r"""
WITH caps AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes(CAST(page_id * 7919 % 525600 AS BIGINT)) AS t,
         rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.') AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages),
hosts AS (SELECT DISTINCT host AS h FROM caps WHERE host <> ''),
names AS (SELECT h FROM hosts UNION SELECT array_to_string(list_slice(string_split(h, '.'), greatest(1, len(string_split(h, '.')) - 2), len(string_split(h, '.'))), '.') FROM hosts),
named AS (SELECT h, CAST('0x' || substr(md5(h), 1, 4) AS INT) AS a, CAST('0x' || substr(md5(h), 5, 4) AS INT) AS b FROM names),
list AS (
  SELECT h AS scope, DATE '2024-01-01' + CAST(a % 200 AS INT) AS since, 'block' AS action FROM named WHERE a % 3 = 0
  UNION ALL SELECT h, DATE '2024-01-01' + CAST(a % 200 + 60 AS INT), 'clear' FROM named WHERE a % 6 = 0
  UNION ALL SELECT h, DATE '2024-01-01' + CAST(a % 200 + 120 AS INT), 'block' FROM named WHERE a % 12 = 0
  UNION ALL SELECT h || '/en', DATE '2024-01-01' + CAST(b % 300 AS INT), 'allow' FROM named WHERE b % 4 = 0),
keys AS (
  SELECT DISTINCT url, t, unnest(list_concat(
    list_transform(range(1, greatest(len(string_split(host, '.')), 2)), lambda k: array_to_string(list_slice(string_split(host, '.'), k, len(string_split(host, '.'))), '.')),
    list_transform(range(1, least(len(parts), 2) + 1), lambda k: host || '/' || array_to_string(list_slice(parts, 1, k), '/')))) AS scope
  FROM caps WHERE host <> ''),
active AS (
  SELECT k.url, k.t, k.scope, max(l.since) AS since, arg_max(l.action, l.since) AS action
  FROM keys k JOIN list l ON l.scope = k.scope AND CAST(l.since AS TIMESTAMP) <= k.t GROUP BY ALL),
best AS (
  SELECT * FROM active WHERE action <> 'clear'
  QUALIFY row_number() OVER (PARTITION BY url, t ORDER BY length(scope) DESC, scope DESC) = 1)
SELECT c.page_id, c.url, b.scope AS rule_scope, strftime(b.since, '%Y-%m-%d') AS rule_since, coalesce(b.action = 'block', FALSE) AS blocked
FROM caps c LEFT JOIN best b ON b.url = c.url AND b.t = c.t
"""


def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words_in=4, radius=4, marks=False)


def op4_decontamination(spark, sf_dir):
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_exact_spans(spark, sf_dir):
    return exact_spans.remove(table(spark, sf_dir, "documents"), 400).withColumnRenamed("kept_text", "text")


def op6_quality_rules(spark, sf_dir):
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_bytes", "longest_repeat")


def op7_quality_ranker(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold(F.col("doc_id"), 3) == 1
    model = quality_ranker.fit(docs, labels, train=~held)
    return quality_ranker.score(docs, model, keep={"doc_id": F.col("doc_id"), "held_out": held})


def op8_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_class_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 7) == 2
    return class_lm.score(docs, class_lm.fit(docs.where(~held)), keep={"doc_id": F.col("doc_id"), "held_out": held})


def op11_fill_in_middle(spark, sf_dir):
    out = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    again = fill_in_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


OP11_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM t),
k AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


def op12_embedding_dups(spark, sf_dir):
    return embedding_dups.near_vectors(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(id, x) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.x),
c AS (SELECT id, min(x) AS component_id FROM r GROUP BY id), n AS (SELECT a AS id, count(*) AS n FROM l GROUP BY a)
SELECT c.id AS vec_id, coalesce(n.n, 0) AS n_links, component_id, c.id = component_id AS kept FROM c LEFT JOIN n USING (id)
"""


def op13_alignment(spark, sf_dir):
    return alignment.linked(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


NUMBERED = (
    op1_language_id, op2_url_filter, op3_simhash, op4_decontamination, op5_exact_spans, op6_quality_rules, op7_quality_ranker, op8_packing, op9_html_text, op10_class_lm, op11_fill_in_middle,
    op12_embedding_dups, op13_alignment,
)
QUERIES = {f.__name__: f for f in NUMBERED}
ORACLES: dict[str, str] = {"op2_url_filter": OP2_SQL, "op11_fill_in_middle": OP11_SQL, "op12_embedding_dups": OP12_SQL}
