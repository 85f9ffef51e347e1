"""The registered queries of the text operators, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from spheric.llm import bpe, decontaminate, pii, quality, shards, simhash, tokenbin, toxicity, urls, warc

OP1_SQL = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
  FROM items, unnest(range(1, greatest(1, len(w) - 8))) AS t(i) WHERE len(w) > 0
), docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM docs, (SELECT DISTINCT k FROM grams) AS s, unnest(range(1, greatest(1, len(w) - k + 2))) AS t(i)
), hits AS (
  SELECT doc_id, i, k, item_id FROM windows JOIN grams USING (k, gram)
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, k FROM hits), unnest(range(i, i + k)) AS t(p) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, unhex(sha1(coalesce(html, ''))) AS d FROM pages
), b AS (
  SELECT *, d::BIT::VARCHAR AS bits FROM p
), e AS (
  SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest
  FROM b
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS largest FROM e
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM m
"""

OP5_SQL = """
SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, length(coalesce(text, ''))::BIGINT AS n_chars, text IS NULL AS text_null,
       sha256(coalesce(lang, '') || '|' || coalesce(source, '') || '|' || coalesce(n_chars::VARCHAR, '')) AS rest_sha256, true AS merged
FROM documents
"""

OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM w, unnest(range(1, greatest(1, len(w) - 1))) AS t(i)
), twice AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT doc_id, i FROM grams WHERE n > 1), unnest([i, i + 1, i + 2]) AS t(p) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest_word, length(regexp_replace(array_to_string(w, ''), '[^\p{L}]+', '', 'g'))::BIGINT AS n_letters
  FROM w LEFT JOIN twice USING (doc_id)
), f AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (100 * n_dup_lines > 50 * n_lines)::BIGINT + 8 * (100 * n_symbols > 20 * n_words)::BIGINT
         + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::BIGINT + 32 * (longest_word > 1000)::BIGINT + 64 * (100 * n_letters < 60 * word_chars)::BIGINT AS failures
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) > 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""

OP8_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), c AS (
  SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') END AS form FROM p
), n AS (
  SELECT form FROM c WHERE form IS NOT NULL GROUP BY form HAVING count(*) > 1
), r AS (
  SELECT page_id, host, path, form, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM c
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN form IN (SELECT form FROM n) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

QUERIES = {
    "op1_decontamination": decontaminate.op1,
    "op2_toxicity": toxicity.op2,
    "op3_bpe": bpe.op3,
    "op4_warc": warc.op4,
    "op5_shards": shards.op5,
    "op6_tokenbin": tokenbin.op6,
    "op7_quality": quality.op7,
    "op8_urls": urls.op8,
    "op9_pii": pii.op9,
    "op10_simhash": simhash.op10,
}
ORACLES = {"op1_decontamination": OP1_SQL, "op4_warc": OP4_SQL, "op5_shards": OP5_SQL, "op7_quality": OP7_SQL, "op8_urls": OP8_SQL}
