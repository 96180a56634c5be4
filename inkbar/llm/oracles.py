"""SQL statements of the operators that SQL can express."""

from __future__ import annotations

from inkbar.llm.sharding import SHARDS, SLOTS, lookup_table

# base32 spells each five bits of the digest
WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, html, CAST(strlen(html) AS BIGINT) AS payload_bytes,
    max(page_id) OVER (PARTITION BY html) AS first_id,
    list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', substr(sha1(html), i, 1)) - 1), 4, '0')),
      'string_agg', '') AS bits
  FROM p
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(1, 6), lambda k: CAST(substr(bits, 5 * j + k, 1) AS INTEGER) * (1 << (5 - k))))::INTEGER, 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""

SHARDING = f"""
WITH t AS (SELECT {lookup_table([f"shard-{i}" for i in range(SHARDS)], SLOTS)} AS shards)
SELECT doc_id, shards[1 + CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % {SLOTS} AS INTEGER)] AS shard
FROM documents, t
"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, 2 * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3
      WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sizes
), tried AS (  -- a level is right if what all sources take under it is the whole budget
  SELECT r.cap / r.weight AS edge,
    (SELECT 1.5 * sum(source_size) FROM ranked)
      - (SELECT coalesce(sum(cap), 0) FROM ranked x WHERE x.cap / x.weight < r.cap / r.weight) AS rest,
    (SELECT sum(weight) FROM ranked x WHERE x.cap / x.weight >= r.cap / r.weight) AS open
  FROM ranked r
), level AS (SELECT max(rest / open) AS l FROM tried WHERE rest / open <= edge),
goals AS (
  SELECT source, source_size,
    CASE WHEN l IS NULL THEN cap ELSE least(cap, l * weight) END AS target
  FROM ranked, level
), placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CASE WHEN g.source_size > 0 THEN floor(floor(g.target) / g.source_size) ELSE 0 END AS epochs
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(epochs * size
    + greatest(0, least(size, floor(target) - epochs * source_size - before)) AS BIGINT) AS taken
FROM placed
"""

CONTENT = r"""
WITH n AS (
  SELECT doc_id, coalesce(length(text), 0) AS points,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept,
  text_sha256
FROM n
WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST)
"""

DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), found AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
c AS (
  SELECT f.lang, f.source, f.term, count(*) AS n FROM found f JOIN kept USING (lang, term)
  GROUP BY f.lang, f.source, f.term
), g AS (
  SELECT lang, source, coalesce(sum(c.n), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + v.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (v.n + v.v)::HUGEINT AS q
  FROM g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)
), pair_sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value
  FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

LEXICAL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), tf AS (SELECT r, doc_id, term, count(*) AS tf FROM d GROUP BY r, doc_id, term),
docs AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
whole AS (SELECT count(*) AS n, sum(n)::BIGINT AS l FROM docs),
m AS (SELECT r, 10 + (90 * docs.n * whole.n) // whole.l AS m FROM docs, whole),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * whole.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM tf, whole GROUP BY term, whole.n
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r)
  GROUP BY item_id, r, doc_id
), ranked AS (
  SELECT item_id, doc_id, score,
    CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLES: dict[str, str] = {
    "op1_warc": WARC,
    "op7_sharding": SHARDING,
    "op5_exact_dedup": CONTENT,
    "op8_mixing": MIXING,
    "op12_divergence": DIVERGENCE,
    "op13_lexical_search": LEXICAL,
}
