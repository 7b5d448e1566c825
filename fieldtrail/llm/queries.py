"""The training-data queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrail.llm import decontaminate, dialogue, langid, licenses, linededup, maintext, neardup, packing, quality, substring, toxicity, urlfilter, whitening
from fieldtrail.llm.common import crc_mod, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabularies lie on this machine; every executor has the same files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.duplicate_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(table(spark, sf_dir, "pages"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_mod("doc_id", 5) != 0))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("lang_pred"), F.col("lang_score").alias("score"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dialogue.repair(dialogue.damaged(table(spark, sf_dir, "conversations")))
    return found.select(F.col("conv").alias("conv_id"), *dialogue.COUNTS, "audit", "repaired_sha256")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (op1_substring_dedup, op2_packing, op3_main_text, op4_decontamination, op5_url_filter, op6_licenses, op7_quality, op8_language, op9_near_duplicates, op10_toxicity,
                  op11_whitening, op12_conversation_repair, op13_line_dedup)
    }


#: DuckDB: every window of every document by its words' md5, and the least document that has it.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS pos FROM d WHERE len(w) >= 50)),
least AS (SELECT h, min(doc_id) AS src FROM win GROUP BY h),
dup AS (SELECT doc_id, pos FROM win JOIN least USING (h) WHERE src < doc_id),
word AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS pos FROM d WHERE doc_id IN (SELECT doc_id FROM dup)),
mark AS (SELECT word.doc_id, word.pos, word, count(dup.pos) OVER (PARTITION BY word.doc_id ORDER BY word.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM word LEFT JOIN dup ON word.doc_id = dup.doc_id AND word.pos = dup.pos),
cut AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept FROM mark GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept, sha256(array_to_string(w, ' '))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

#: DuckDB: addresses, the longest rule, and decisions spread over aliases by recursion.
OP5_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, coalesce(url, '') AS u,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
    regexp_extract(coalesce(html, ''), '(?is)<link\b[^>]*?\brel\s*=\s*["'']?canonical\b[^>]*>', 0) AS canon,
    regexp_extract(coalesce(html, ''), '(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0) AS fresh
  FROM pages),
rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
t AS (
  SELECT *, [replace(regexp_extract(fresh, '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1), '&amp;', '&'), replace(regexp_extract(canon, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1), '&amp;', '&')] AS targets,
    (SELECT max_by(struct_pack(rule := r.host || r.path, verdict := r.verdict), (length(r.host || r.path), length(r.host)))
     FROM rules r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS fit
  FROM p),
target AS (SELECT u, unnest(targets) AS target FROM t),
urls AS (SELECT u FROM t UNION SELECT target FROM target),
addresses AS (
  SELECT u,
    translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(u, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '(?s)^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z_]*|fbclid|gclid|ref|ref_src|mc_cid|mc_eid|igshid)(=|$)'))), '&') AS query
  FROM urls WHERE contains(u, '://')),
keyed AS (
  SELECT u, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(?:www|m)\.(.*\..*)$', '\1') || regexp_replace(regexp_replace(path, '\.html?$', ''), '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS key
  FROM addresses),
k AS (SELECT t.*, a.key AS key FROM t LEFT JOIN keyed a ON t.u = a.u),
link AS (SELECT a.key AS a, b.key AS b FROM target t JOIN keyed a ON t.u = a.u JOIN keyed b ON t.target = b.u),
edges AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT DISTINCT key, key FROM k WHERE key IS NOT NULL UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
said AS (
  SELECT r.a AS key, bool_or(k.fit.verdict = 'allow') AS allowed, bool_or(k.fit.verdict = 'block') AS blocked
  FROM reach r JOIN k ON k.key = r.b GROUP BY r.a)
SELECT k.page_id, k.host, k.path, k.fit.rule AS rule,
  coalesce(k.fit.verdict, CASE WHEN said.blocked AND NOT coalesce(said.allowed, false) THEN 'block' END, 'allow') AS verdict
FROM k LEFT JOIN said USING (key)
"""


#: DuckDB: crc32 by its bitwise rule; then the least (cost, audit) of each of four states, layer after layer, and the repaired rows from the audit.
OP12_SQL = r"""
WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN (c & 1) = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS code
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE code WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) FROM coded)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, rtrim(text, E' \t\n\x0b\x0c\r') AS bare FROM damaged),
faulty AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before_ini
  FROM numbered),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before_ini || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faulty GROUP BY conv_id),
walk(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, 0::BIGINT, {'c': 0::BIGINT, 'a': ''}, {'c': 1000000000::BIGINT, 'a': ''}, {'c': 1000000000::BIGINT, 'a': ''}, {'c': 1000000000::BIGINT, 'a': ''} FROM counts
  UNION ALL
  SELECT conv_id, i,
    {'c': s0.c + 4, 'a': s0.a || 'D'},
    list_min([{'c': s1.c + 4, 'a': s1.a || 'D'}, {'c': CASE WHEN keep AND ini = 's' THEN s0.c + extra ELSE 2000000000 END, 'a': s0.a || 'K'}]),
    list_min([{'c': s2.c + 4, 'a': s2.a || 'D'}, {'c': CASE WHEN keep THEN p.c + extra + CASE WHEN ini = 'u' THEN 0 ELSE 3 END ELSE 2000000000 END, 'a': p.a || CASE WHEN ini = 'u' THEN 'K' ELSE 'R' END}]),
    list_min([{'c': s3.c + 4, 'a': s3.a || 'D'}, {'c': CASE WHEN keep THEN s2.c + extra + CASE WHEN ini = 'a' THEN 0 ELSE 3 END ELSE 2000000000 END, 'a': s2.a || CASE WHEN ini = 'a' THEN 'K' ELSE 'R' END}])
  FROM (
    SELECT o.*, list_min([o.s0, o.s1, o.s3]) AS p, f.ini, f.fault NOT IN ('blank', 'duplicate') AS keep, CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END AS extra
    FROM (
      SELECT conv_id, i + 1 AS i, s0, s1, s2, list_min([s3, {'c': s2.c + 3, 'a': s2.a || 'I'}]) AS s3
      FROM (SELECT conv_id, i, s0, s1, s3, list_min([s2, {'c': s0.c + 3, 'a': s0.a || 'I'}, {'c': s1.c + 3, 'a': s1.a || 'I'}, {'c': s3.c + 3, 'a': s3.a || 'I'}]) AS s2 FROM walk)) o
    JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM o.conv_id AND f.i = o.i)),
ended AS (
  SELECT w.conv_id, list_min([s0, s3, {'c': s2.c + 3, 'a': s2.a || 'I'}, {'c': s0.c + 6, 'a': s0.a || 'II'}, {'c': s1.c + 6, 'a': s1.a || 'II'}]) AS best
  FROM walk w JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n),
letters AS (SELECT conv_id, p, best.a[p] AS letter FROM (SELECT conv_id, best, unnest(range(1, length(best.a) + 1)) AS p FROM ended)),
placed AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS q, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id) AS total FROM letters),
repaired AS (
  SELECT p.conv_id, string_agg(CASE WHEN letter = 'K' THEN f.role WHEN (q - total % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY p) AS body
  FROM placed p LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i WHERE letter <> 'D' GROUP BY p.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(e.best.c, 0) AS cost, coalesce(e.best.a, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""

#: DuckDB: lines, keys, distinct documents of a key, and the lines that stay.
OP13_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, r, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d),
k AS (SELECT *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, common.key IS NOT NULL AND k.doc_id <> common.last AS gone FROM k LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op5_url_filter": OP5_SQL, "op12_conversation_repair": OP12_SQL, "op13_line_dedup": OP13_SQL}
