"""DuckDB statements for the queries that SQL can express, from the contracts alone."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(column: str) -> str:
    return f"translate({column}, '{_UPPER}', '{_LOWER}')"


_BLANK = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all({_lowered("text")}, '{_ALNUM}'), []) AS w FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         coalesce(regexp_extract_all({_lowered("text")}, '{_ALNUM}'), []) AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, w[i : i + 9] AS g FROM items, unnest(range(1, len(w) - 8)) AS u(i)
  UNION SELECT item, w FROM items WHERE len(w) BETWEEN 1 AND 9
), lengths AS (SELECT DISTINCT len(g) AS n FROM windows
), hits AS (
  SELECT r, i, n, item FROM (
    SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM docs, lengths) AS p
  JOIN windows ON windows.g = p.w[p.i : p.i + p.n - 1]
), covered AS (
  SELECT r, count(DISTINCT i + d) AS n_hit FROM (SELECT DISTINCT r, i, n FROM hits) AS h, unnest(range(0, n)) AS u(d) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) AS h GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

NGRAM_JACCARD = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(regexp_extract_all({_lowered("text")}, '{_BLANK}'), []) AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, w[i : i + 2] AS g FROM docs, unnest(range(1, len(w) - 1)) AS u(i)
  UNION SELECT doc_id, w FROM docs WHERE len(w) BETWEEN 1 AND 2
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM sets AS a JOIN sets AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM pairs JOIN sizes AS s ON s.doc_id = x JOIN sizes AS t ON t.doc_id = y
  WHERE 100 * shared >= 90 * (s.n + t.n - shared)
), reach(x, y) AS (
  SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT docs.doc_id, coalesce(any_value(n), 0) AS n_shingles, least(docs.doc_id, min(y)) AS component_id
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN reach ON reach.x = docs.doc_id GROUP BY docs.doc_id
"""


def _sharded(shards: int) -> str:
    scores = ", ".join(
        f"{{'s': -ln((CAST('0x' || md5(k || ':{i}')[1:13] AS BIGINT) + 0.5) / 4503599627370496.0), 'i': {i}}}"
        for i in range(shards)
    )
    return f"list_min([{scores}])['i']"


SHARDING = f"""
WITH bits AS (
  SELECT list(list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS crc
  FROM (SELECT unnest(range(256)) AS b)
), docs AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, hex(encode(coalesce(text, ''))) AS h FROM documents
), sized AS (
  SELECT doc_id, k, CAST(len(h) // 2 + 1 AS BIGINT) AS size,
         xor(list_reduce(
           list_transform(range(0, len(h), 2), lambda i: CAST('0x' || h[i + 1 : i + 2] AS BIGINT)),
           lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32
  FROM docs, bits
), placed AS (
  SELECT *, CAST({_sharded(8)} AS INTEGER) AS shard, CAST({_sharded(9)} AS INTEGER) AS grown_shard FROM sized
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY
         md5(concat_ws(':', CAST(doc_id AS VARCHAR), CAST(size AS VARCHAR), CAST(text_crc32 AS VARCHAR)))[1:3],
         doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
FROM placed
"""

MIXING = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k,
         octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents
), sizes AS (SELECT source, sum(size) AS size, 1.0::DOUBLE AS weight FROM docs GROUP BY source
), rates AS (
  SELECT source, 1.0::DOUBLE * sum(size) OVER () * weight / (sum(weight) OVER () * size) AS rate FROM sizes
), steps(source, mean, k, term, below) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT source, mean, k + 1, term * mean / (k + 1), below + term * mean / (k + 1) FROM steps
  WHERE k < ceil(mean + 12 * sqrt(mean)) + 40
), drawn AS (
  SELECT doc_id, source, k, CAST('0x' || md5('mix:1:' || k)[1:13] AS BIGINT)::DOUBLE / 4503599627370496.0 AS u FROM docs
), counted AS (
  SELECT d.doc_id, d.source, d.k, (SELECT count(*) FROM steps AS s WHERE s.source IS NOT DISTINCT FROM d.source AND d.u >= s.below) AS n
  FROM drawn AS d
), copies AS (
  SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, md5('mix:order:' || copy || ':' || k) AS place
  FROM counted, unnest(range(0, n)) AS u(copy)
)
SELECT doc_id, source, copy, row_number() OVER (ORDER BY place, copy, doc_id) - 1 AS position FROM copies
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || s[{5 * g + 1}:{5 * g + 5}] AS BIGINT) >> {shift}) & 31 AS INTEGER) + 1, 1)"
    for g in range(8)
    for shift in (15, 10, 5, 0)
)

WARC = f"""
WITH hashed AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
         sha1(coalesce(html, '')) AS s FROM pages
), best AS (SELECT *, max(page_id) OVER (PARTITION BY s, payload_bytes) AS first FROM hashed)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM best
"""

QUALITY = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         coalesce(regexp_extract_all(text, '{_BLANK}'), []) AS w FROM documents
), wide(n) AS (VALUES (3), (10), (101)
), grams AS (
  SELECT r, n, i, count(*) OVER (PARTITION BY r, n, g) AS times FROM (
    SELECT r, n, i, w[i : i + n - 1] AS g FROM (
      SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, wide) AS p) AS q
), spans AS (
  SELECT r, n, count(DISTINCT i + d) AS words FROM (SELECT r, n, i FROM grams WHERE times > 1) AS x, unnest(range(0, n)) AS u(d)
  GROUP BY r, n
), lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs) AS x
  WHERE regexp_matches(line, '{_BLANK}') GROUP BY r
), base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(dup, 0) AS n_dup_lines,
         coalesce((SELECT words FROM spans WHERE spans.r = docs.r AND n = 3), 0) AS n_repeat_words,
         coalesce((SELECT words FROM spans WHERE spans.r = docs.r AND n = 10), 0) AS n_covered_words,
         coalesce((SELECT words FROM spans WHERE spans.r = docs.r AND n = 101), 0) AS long_repeat
  FROM docs LEFT JOIN lines USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND n_covered_words <= 0.3 * n_words AND long_repeat = 0 AS kept
FROM base
"""

FILTER_AUDIT = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper,
         min(doc_id) OVER (PARTITION BY t) AS first FROM d
), f AS (
  SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * upper > 5 * length(t),
         regexp_matches(t, '[#$%&*|]'), coalesce(first < doc_id, false)] AS fails FROM w
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY ALL
), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o
  FROM letters AS a JOIN letters AS b ON b.x <> a.x JOIN letters AS c ON c.x NOT IN (a.x, b.x)
  JOIN letters AS d ON d.x NOT IN (a.x, b.x, c.x) JOIN letters AS e ON e.x NOT IN (a.x, b.x, c.x, d.x)
), steps AS (
  SELECT o, s, [instr('ABCDE', x) FOR x IN string_split(o, '')] AS k FROM orders, range(1, 6) AS r(s)
), outcomes AS (
  SELECT part, o, s, k[s] AS k, n, good, toxic, fails[k[s]] AS failed,
         len([i FOR i IN k[1 : s - 1] IF fails[i]]) > 0 AS gone,
         len([x FOR x IN fails IF x]) = 1 AS single
  FROM c, steps
), counted AS (
  SELECT part, o, s, k,
         sum(CASE WHEN NOT gone AND NOT failed THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT gone AND failed THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND failed THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failed AND single THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND failed AND good THEN n ELSE 0 END) AS good_lost,
         sum(CASE WHEN NOT gone AND failed AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM outcomes GROUP BY part, o, s, k
)
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM counted
"""

RANKED_SEARCH = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_lowered("text")}, '{_ALNUM}') AS w FROM documents
), sized AS (SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM docs WHERE len(w) > 0
), whole AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sized
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_lowered("text")}, '{_ALNUM}')) AS term FROM benchmark
), postings AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM sized) AS u
  WHERE term IN (SELECT term FROM wanted) GROUP BY r, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term) AS p, whole
), impacts AS (
  SELECT term, r, doc_id, weights.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // ll))) AS v
  FROM postings JOIN weights USING (term) JOIN sized USING (r), whole
), scores AS (
  SELECT item_id, r, doc_id, CAST(sum(v) AS BIGINT) AS score FROM wanted JOIN impacts USING (term) GROUP BY item_id, r, doc_id
), ranks AS (
  SELECT item_id, doc_id, score,
         row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranks WHERE rank <= 50
"""

STATEMENTS = {
    "op1_decontamination": DECONTAMINATION,
    "op2_ngram_jaccard": NGRAM_JACCARD,
    "op3_sharding": SHARDING,
    "op4_mixing": MIXING,
    "op6_warc": WARC,
    "op7_quality": QUALITY,
    "op12_filter_audit": FILTER_AUDIT,
    "op13_ranked_search": RANKED_SEARCH,
}
