"""DuckDB SQL with the same result as each registered query, written independently.

Shared steps are common table expressions (``_cte``); every statement is one SELECT.
"""

from __future__ import annotations

import hashlib

from ..constants import ENGLISH_STOP_WORDS

# The statements' own parameters; the queries state theirs elsewhere.
PRIME = 2147483647
BLOOM_BITS, BLOOM_HASHES = 32768, 3
HASH_BUCKETS, JOB_HASH_BUCKETS = 32768, 262144
SIGNATURE_HASHES = 128
BAND_HASHES, ROWS_PER_BAND = 512, 2
NUM_HASH_TABLES, K_VALUES = [128, 250], [50, 100, 150, 200]
FRACTIONS = [0.2, 0.4, 0.6, 0.8, 1.0]
THRESHOLD = 0.9
NEAR_THRESHOLD = 0.5
TOP_WORDS, PATTERN_COLUMNS, SEQUENCES, SEQUENCE_LENGTH = 300, 20000, 600, 3
FOREST_DEPTH = 4
FOREST_AROUND = 50
PLATFORM_STOP_WORDS = ["rt", "amp", "https", "http", "co", "im"]
EXTENDED_STOP_WORDS = ENGLISH_STOP_WORDS + PLATFORM_STOP_WORDS
CUSTOM_STOP_WORDS = ["the", "of", "and", "to", "in", "that", "is", "que", "de", "la", "und", "der"]
MATCH_PATTERN = r"[a-zA-ZÀ-ÿ0-9#@']+"
SCENARIOS = {
    "unigram": "scenario1_unigram",
    "bigram": "scenario2_bigram",
    "patterns": "scenario3_patterns",
    "all": "scenario4_all",
}


def coefficients(count: int) -> tuple[list[int], list[int]]:
    """Pairs (a, b) of the MinHash family: numbers from an MD5 of seed, name and place."""
    drawn = {
        kind: [int(hashlib.md5(f"42:{kind}:{j}".encode()).hexdigest()[:8], 16) for j in range(count)]
        for kind in "ab"
    }
    return [1 + x % (PRIME - 1) for x in drawn["a"]], [x % PRIME for x in drawn["b"]]


RAW = "CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 4 WHEN l.quality = 0 THEN 2 END"
WORD = f"CASE {RAW} WHEN 0 THEN 'Negative' WHEN 2 THEN 'neutral' WHEN 4 THEN 'POSITIVE' END"
INNER = "documents d JOIN labels l ON d.doc_id = l.doc_id"
LEFT = "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(words) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


def _replace(expr: str, steps) -> str:
    for pattern, new in steps:
        expr = f"regexp_replace({expr}, {_q(pattern)}, {_q(new)}, 'g')"
    return expr


def _letters(col: str) -> str:
    steps = [(r"http\S+|www\.\S+", " "), (r"[^a-z\s]", " "), (r"\s+", " ")]
    return f"trim({_replace(f'lower({col})', steps)})"


def _alnum(col: str) -> str:
    steps = [(r"http\S+|www\.\S+", " "), (r"[^a-z0-9\s]", " "), (r"\s+", " ")]
    return f"trim({_replace(f'lower({col})', steps)})"


def _social(col: str) -> str:
    steps = [
        (r"(?i)\b(?:https?://|www\.)\S+\b", " "),
        (r"&amp;", " and "),
        (r"&quot;|&lt;|&gt;", " "),
        (r"&#39;", "'"),
        (r"(?i)^\s*rt\s+", " "),
        (r"@[A-Za-z0-9_]+", " "),
        (r"#(\w+)", r"\1"),
        (r"[^a-z0-9_'\s]", " "),
        (r"\s+", " "),
    ]
    return f"trim({_replace(f'lower({col})', steps)})"


def _ascii(col: str) -> str:
    steps = [(r"https?://\S+", " "), (r"&\w+;", " "), (r"[^\x00-\x7F]+", " ")]
    return _replace(f"lower({col})", steps)


def _gaps(expr: str) -> str:
    pattern = _q(r"[^\w#@']+")
    return f"list_filter(string_split_regex(lower({expr}), {pattern}), lambda t: t <> '')"


def _drop(expr: str, words) -> str:
    return f"list_filter({expr}, lambda t: NOT list_contains({_words(words)}, t))"


def _social_tokens(col: str) -> str:
    return _drop(_gaps(_social(col)), EXTENDED_STOP_WORDS)


def _match(col: str, words) -> str:
    found = f"regexp_extract_all({_ascii(col)}, {_q(MATCH_PATTERN)})"
    bare = f"list_transform({found}, lambda t: trim(t, ''''))"
    return (
        f"list_filter({bare}, lambda t: t <> '' AND NOT list_contains({_words(words)}, t) "
        "AND NOT regexp_full_match(t, '[0-9]+'))"
    )


def _ordered_distinct(source: str, key: str = "id") -> str:
    """First occurrences, in order, of the list column ``t`` of ``source``."""
    return f"""
        SELECT {key}, list(w ORDER BY p) AS t FROM (
          SELECT {key}, w, min(p) AS p FROM (
            SELECT {key}, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM {source}
          ) GROUP BY {key}, w
        ) GROUP BY {key}"""


def _grams(col: str, n: int, sep: str) -> str:
    return (
        f"list_transform(range(1, greatest(len({col}) - {n - 1}, 0) + 1), "
        f"lambda i: array_to_string(list_slice({col}, i, i + {n - 1}), {_q(sep)}))"
    )


def _joined(col: str, sep: str = " ") -> str:
    return f"coalesce(array_to_string({col}, {_q(sep)}), '')"


def _listing(expr: str) -> str:
    return f"""SELECT id, {_joined('t')} AS tokens, len(t) AS n_tokens
        FROM (SELECT doc_id AS id, {expr} AS t FROM documents)"""


def _is_test(key: str) -> str:
    return f"(('0x' || substr(md5('42:' || {key}), 1, 8))::BIGINT % 10000) < 2000"


# ------------------------------------------------------------------ shared steps

def _engine(label: str = "l.quality") -> str:
    return f"""
  eng_clean AS (
    SELECT * FROM (SELECT d.doc_id AS id, {label} AS label, {_social('d.text')} AS tc FROM {INNER})
    WHERE label IS NOT NULL
  ), eng_kept AS (
    SELECT id, label, tc FROM (
      SELECT *, row_number() OVER (PARTITION BY tc ORDER BY id) AS rn FROM eng_clean
    ) WHERE rn = 1
  ), eng AS (
    SELECT id, label, {_is_test('id')} AS is_test,
           {_drop(_gaps('tc'), EXTENDED_STOP_WORDS)} AS tokens
    FROM eng_kept
  )"""


ENGINE = _engine()
BINARY = f"CASE {RAW} WHEN 0 THEN 0 WHEN 4 THEN 1 END"
TERNARY = f"CASE {RAW} WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 END"


def _feature_rows(scenario: int) -> str:
    """``feat(id, label, is_test, f)`` of an engine scenario, from ``eng``."""
    unigrams = "list_distinct(tokens)"
    bigrams = f"list_distinct({_grams('tokens', 2, ' ')})"
    tag = lambda expr, mark: f"list_transform({expr}, lambda t: '{mark}' || t)"
    if scenario == 1:
        return f"feat AS (SELECT id, label, is_test, {unigrams} AS f FROM eng WHERE len(tokens) > 0)"
    if scenario == 2:
        return f"feat AS (SELECT id, label, is_test, {bigrams} AS f FROM eng WHERE len(tokens) > 1)"
    patterns = f"""
      {_pattern_ctes("(SELECT id, tokens AS t FROM eng)", "(SELECT tokens AS t FROM eng WHERE NOT is_test)")},
      pvoc AS (
        SELECT pattern FROM pats JOIN eng USING (id) WHERE NOT is_test
        GROUP BY pattern ORDER BY count(*) DESC, pattern LIMIT {PATTERN_COLUMNS}
      ), kept AS (
        SELECT id, list(pattern) AS p FROM pats JOIN pvoc USING (pattern) GROUP BY id
      )"""
    if scenario == 3:
        return f"""{patterns}, feat AS (
          SELECT id, label, is_test, p AS f FROM eng JOIN kept USING (id))"""
    return f"""{patterns}, feat AS (
      SELECT * FROM (
        SELECT id, label, is_test, list_concat(list_concat({tag(unigrams, 'u:')},
          {tag(bigrams, 'b:')}), {tag('coalesce(p, [])', 'p:')}) AS f
        FROM eng LEFT JOIN kept USING (id)
      ) WHERE len(f) > 0)"""


def _pattern_ctes(rows: str, fit: str) -> str:
    """``pats(id, n, pos, pattern)``: first patterns of each row, in order."""
    windows = " UNION ALL ".join(
        f"""SELECT id, {n} AS n, unnest(range(1, greatest(len(m) - {n - 1}, 0) + 1)) AS pos, m FROM masked"""
        for n in range(3, 7)
    )
    return f"""hfw AS (
        SELECT w FROM (SELECT unnest(t) AS w FROM {fit}) GROUP BY w
        ORDER BY count(*) DESC, w LIMIT {TOP_WORDS}
      ), hfw_list AS (SELECT list(w) AS ws FROM hfw
      ), masked AS (
        SELECT id, list(CASE WHEN h.w IS NULL THEN '*' ELSE x.w END ORDER BY p) AS m
        FROM (SELECT id, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM {rows}) x
        LEFT JOIN hfw h ON x.w = h.w GROUP BY id
      ), wins AS (
        SELECT id, n, pos, list_slice(m, pos, pos + n - 1) AS win FROM ({windows})
      ), pats AS (
        SELECT id, min(n) AS n, min(pos) FILTER (n = least_n) AS pos, pattern FROM (
          SELECT id, n, pos, array_to_string(win, '_') AS pattern,
                 min(n) OVER (PARTITION BY id, array_to_string(win, '_')) AS least_n
          FROM wins WHERE len(list_filter(win, lambda w: w <> '*')) >= 2
        ) GROUP BY id, pattern
      )"""


def _pairs(threshold: float = THRESHOLD) -> str:
    return f"""
      tok AS (SELECT id, label, is_test, len(f) AS n, unnest(f) AS t FROM feat),
      near AS (
        SELECT test_id, test_label, train_id, train_label, overlap, na + nb - overlap AS union_size,
               (na + nb - overlap - overlap) / (na + nb - overlap) AS distance
        FROM (
          SELECT a.id AS test_id, b.id AS train_id, a.label AS test_label, b.label AS train_label,
                 a.n AS na, b.n AS nb, count(*) AS overlap
          FROM tok a JOIN tok b ON a.t = b.t
          WHERE a.is_test AND NOT b.is_test GROUP BY ALL
        ) WHERE (na + nb - overlap - overlap) / (na + nb - overlap) < {threshold}::DOUBLE
      )"""


def _topk(k: int = 50) -> str:
    return f"""
      top AS (
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY distance, train_id)::INT AS rank
          FROM near
        ) WHERE rank <= {k}
      )"""


NEIGHBORS = f"WITH {ENGINE}, {_feature_rows(1)}, {_pairs()}, {_topk()}"

VOTES = """
  votes AS (
    SELECT test_id, test_label, train_label, count(*) AS votes FROM top GROUP BY ALL
  ), winner AS (
    SELECT test_id, train_label AS prediction FROM (
      SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY votes DESC, train_label) AS r
      FROM votes
    ) WHERE r = 1
  )"""

PREDICTIONS = """
  major AS (
    SELECT label FROM feat WHERE NOT is_test GROUP BY label ORDER BY count(*) DESC, label LIMIT 1
  ), preds AS (
    SELECT f.id AS test_id, f.label AS test_label,
           coalesce(w.prediction, (SELECT label FROM major)) AS prediction,
           w.prediction IS NULL AS is_fallback
    FROM feat f LEFT JOIN winner w ON f.id = w.test_id WHERE f.is_test
  )"""

CELL = """cell AS (
    SELECT 50 AS k, count(*) FILTER (prediction = test_label) / count(*) AS accuracy,
           (SELECT count(*) FROM top) / count(*) AS avg_candidates,
           (SELECT count(*) FROM top) AS neighbor_pairs,
           count(*) FILTER (is_fallback) AS n_fallback, count(*) AS test_size,
           (SELECT count(*) FROM feat WHERE NOT is_test) AS train_size
    FROM preds)"""

EVALUATED = f"{NEIGHBORS}, {VOTES}, {PREDICTIONS}, {CELL}"


# Spark ML's term hash: MurmurHash3, 32 bits, seed 42, over UTF-8 bytes, as a signed number
_M = "4294967295::UBIGINT"
_ROT = lambda x, n: f"((({x} << {n}) | ({x} >> {32 - n})) & {_M})"


def _murmur(words: str, buckets: int) -> str:
    """``hashed_terms(w, i)``: the bucket of each distinct term ``w`` of the rows ``words``."""
    octet = lambda at: f"('0x' || substr(h, 2 * ({at}) + 1, 2))::UBIGINT"
    block = " + ".join(f"{octet(f'4 * b + {j}')} * {256 ** j}" for j in range(4))
    tail = " + ".join(
        f"CASE WHEN size % 4 > {j} THEN {octet(f'size - size % 4 + {j}')} * {256 ** j} ELSE 0 END" for j in range(3)
    )
    mixed = lambda k: f"(({_ROT(f'(({k} * 3432918353::UBIGINT) & {_M})', 15)} * 461845907::UBIGINT) & {_M})"
    joined = lambda h, k: f"(({_ROT(f'xor({h}, {k})', 13)} * 5::UBIGINT + 3864292196::UBIGINT) & {_M})"
    return f"""murmur_terms AS (
        SELECT w, hex(encode(w)) AS h, octet_length(encode(w))::BIGINT AS size FROM (SELECT DISTINCT w FROM {words})
      ), murmur_blocks AS (
        SELECT w, size, list_transform(range(0, size // 4), lambda b: {mixed(f'({block})')}) AS ks,
               {mixed(f'(({tail})::UBIGINT)')} AS rest
        FROM murmur_terms
      ), murmur_body AS (
        SELECT w, xor(xor(list_reduce(ks, lambda h, k: {joined('h', 'k')}, 42::UBIGINT), rest), size::UBIGINT) AS a
        FROM murmur_blocks
      ), murmur_mid AS (
        SELECT w, ((xor(a, a >> 16)) * 2246822507::UBIGINT) & {_M} AS a FROM murmur_body
      ), murmur_end AS (
        SELECT w, ((xor(a, a >> 13)) * 3266489909::UBIGINT) & {_M} AS a FROM murmur_mid
      ), hashed_terms AS (
        SELECT w, (xor(a, a >> 16) & {_M})::BIGINT AS v FROM murmur_end
      ), hashed_buckets AS (
        SELECT w, (CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END % {buckets} + {buckets}) % {buckets} AS i
        FROM hashed_terms
      )"""


def _entries(source: str) -> str:
    """``listed(id, entries)``: ``index:value`` pairs of (id, i, n) rows, joined in order."""
    return f"""listed AS (
        SELECT id, string_agg(i || ':' || n, ',' ORDER BY i) AS entries
        FROM (SELECT id, i, sum(n)::BIGINT AS n FROM {source} GROUP BY id, i) GROUP BY id)"""


def _coefficient_rows(count: int) -> str:
    a, b = coefficients(count)
    rows = ", ".join(f"({j}, {x}::BIGINT, {y}::BIGINT)" for j, (x, y) in enumerate(zip(a, b)))
    return f"coef(j, a, b) AS (VALUES {rows})"


def _signatures(rows: str, count: int, keys: str = "id") -> str:
    """``sig(keys, j, v)`` of the list column ``f`` of ``rows``."""
    return f"""{_coefficient_rows(count)},
      hashed AS (
        SELECT {keys}, ('0x' || substr(md5(t), 1, 8))::BIGINT AS x
        FROM (SELECT {keys}, unnest(f) AS t FROM {rows})
      ), sig AS (
        SELECT {keys}, j, min(((1 + x) * a + b) % {PRIME}) AS v FROM hashed, coef GROUP BY {keys}, j
      )"""


def _forest(counts: list[int], k: int, runs: str = "") -> str:
    """``forest(num_hash_tables, runs, test_id, ..., rank)``: the places of all rows in every tree."""
    r = f"{runs}, " if runs else ""
    half = FOREST_AROUND // 2
    listed = ", ".join(f"({n}, {n // FOREST_DEPTH})" for n in counts)
    return f"""
      trees AS (
        SELECT {r}id, j // {FOREST_DEPTH} AS tree, list(v ORDER BY j) AS vs FROM sig
        WHERE j < {max(counts) // FOREST_DEPTH * FOREST_DEPTH} GROUP BY ALL
      ), places AS (
        SELECT {r}id, tree, is_test, coalesce(count(*) FILTER (NOT is_test) OVER (
          PARTITION BY {r}tree ORDER BY vs, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
        FROM trees JOIN feat USING ({r}id)
      ), around AS (
        SELECT {r}id, tree, unnest(range(place - {half}, place + {half})) AS place FROM places WHERE is_test
      ), offered AS (
        SELECT {r}a.id AS test_id, b.id AS train_id, min(tree) AS first_tree
        FROM around a JOIN (SELECT * FROM places WHERE NOT is_test) b USING ({r}tree, place) GROUP BY ALL
      ), judged AS (
        SELECT {r}test_id, a.label AS test_label, train_id, b.label AS train_label, first_tree,
               len(list_intersect(a.f, b.f)) AS overlap,
               len(a.f) + len(b.f) - len(list_intersect(a.f, b.f)) AS union_size
        FROM offered
        JOIN (SELECT {r}id AS test_id, label, f FROM feat) a USING ({r}test_id)
        JOIN (SELECT {r}id AS train_id, label, f FROM feat) b USING ({r}train_id)
      ), forest AS (
        SELECT * FROM (
          SELECT num_hash_tables, judged.*, (union_size - overlap) / union_size AS distance,
                 row_number() OVER (PARTITION BY {r}num_hash_tables, test_id
                   ORDER BY (union_size - overlap) / union_size, train_id)::INT AS rank
          FROM judged JOIN (VALUES {listed}) AS c(num_hash_tables, trees) ON first_tree < trees
          WHERE overlap > 0
        ) WHERE rank <= {k}
      )"""


def _grid(scenario: int, neutral: int) -> str:
    """One SELECT with the cells of an engine scenario, for two classes or three."""
    tables = max(NUM_HASH_TABLES)
    counts = ", ".join(f"({n})" for n in NUM_HASH_TABLES)
    ks = ", ".join(f"({k})" for k in K_VALUES)
    return f"""WITH {_engine(TERNARY if neutral else BINARY)}, {_feature_rows(scenario)}, {_pairs()},
      {_signatures('feat', tables)},
      agree AS (
        SELECT n.test_id, n.train_id, min(a.j) + 1 AS first_table
        FROM near n JOIN sig a ON a.id = n.test_id
        JOIN sig b ON b.id = n.train_id AND a.j = b.j AND a.v = b.v GROUP BY ALL
      ), counts(num_hash_tables) AS (VALUES {counts}), ks(k) AS (VALUES {ks}),
      ranked AS (
        SELECT num_hash_tables, n.*, row_number() OVER (
          PARTITION BY num_hash_tables, test_id ORDER BY distance, train_id) AS rank
        FROM near n JOIN agree USING (test_id, train_id) JOIN counts ON first_table <= num_hash_tables
      ), top AS (SELECT k, ranked.* FROM ranked JOIN ks ON rank <= k),
      votes AS (
        SELECT num_hash_tables, k, test_id, train_label, count(*) AS votes FROM top GROUP BY ALL
      ), winner AS (
        SELECT * FROM (
          SELECT *, row_number() OVER (
            PARTITION BY num_hash_tables, k, test_id ORDER BY votes DESC, train_label) AS r
          FROM votes
        ) WHERE r = 1
      ), major AS (
        SELECT label FROM feat WHERE NOT is_test GROUP BY label ORDER BY count(*) DESC, label LIMIT 1
      ), preds AS (
        SELECT num_hash_tables, k, f.id, f.label, w.train_label IS NULL AS is_fallback,
               coalesce(w.train_label, (SELECT label FROM major)) AS prediction
        FROM (SELECT * FROM feat, counts, ks WHERE is_test) f
        LEFT JOIN (SELECT num_hash_tables, k, test_id AS id, train_label FROM winner) w
        USING (num_hash_tables, k, id)
      ), found AS (SELECT num_hash_tables, k, count(*) AS n FROM top GROUP BY ALL)
      SELECT {scenario} AS scenario, num_hash_tables, k,
             count(*) FILTER (prediction = label) / count(*) AS accuracy,
             coalesce(any_value(n), 0) / count(*) AS avg_candidates,
             coalesce(any_value(n), 0) AS neighbor_pairs,
             count(*) FILTER (is_fallback) AS n_fallback, count(*) AS test_size,
             (SELECT count(*) FROM feat WHERE NOT is_test) AS train_size, {neutral} AS use_neutral
      FROM preds LEFT JOIN found USING (num_hash_tables, k) GROUP BY num_hash_tables, k"""


HARNESS_WORDS = CUSTOM_STOP_WORDS + PLATFORM_STOP_WORDS
HARNESS = f"""
  raw AS (
    SELECT id, label, text FROM (
      SELECT d.doc_id AS id, l.quality AS label, d.text,
             row_number() OVER (PARTITION BY d.text ORDER BY d.doc_id) AS rn FROM {INNER}
    ) WHERE rn = 1
  ), listed AS (SELECT id, {_match('text', HARNESS_WORDS)} AS t FROM raw),
  deduped AS ({_ordered_distinct('listed')}),
  harness AS (SELECT id, label, t AS tokens FROM raw JOIN deduped USING (id))"""


def _sweep() -> str:
    """One SELECT with the cells of the fraction sweep."""
    fractions = ", ".join(f"({f}::DOUBLE)" for f in FRACTIONS)
    ks = ", ".join(f"({k})" for k in K_VALUES)
    tables = ", ".join(f"({n})" for n in NUM_HASH_TABLES)
    bigrams, sequences = _grams("tokens", 2, "_"), _grams("tokens", SEQUENCE_LENGTH, "_")
    runs = "scenario, fraction"
    return f"""WITH {HARNESS}, fractions(fraction) AS (VALUES {fractions}),
      ordered AS (
        SELECT *, row_number() OVER (ORDER BY md5('42:' || id), id) AS pos,
               count(*) OVER () AS base FROM harness
      ), samples AS (
        SELECT fraction, id, label, tokens FROM ordered, fractions
        WHERE pos <= greatest(1, round_even(base * fraction, 0))
      ), split AS (
        SELECT fraction, id, label, tokens,
               row_number() OVER (PARTITION BY fraction, label ORDER BY md5('42:' || id), id)
                 <= floor(count(*) OVER (PARTITION BY fraction, label) * 0.2::DOUBLE + 0.5) AS is_test
        FROM samples
      ), vocab AS (
        SELECT fraction, gram FROM (
          SELECT *, row_number() OVER (PARTITION BY fraction ORDER BY n DESC, gram) AS r FROM (
            SELECT fraction, gram, count(*) AS n FROM (
              SELECT fraction, unnest({sequences}) AS gram FROM split WHERE NOT is_test
            ) GROUP BY ALL
          )
        ) WHERE r <= {SEQUENCES}
      ), uni AS (SELECT fraction, id, unnest(tokens) AS t FROM split),
      bi AS (SELECT fraction, id, unnest({bigrams}) AS t FROM split),
      pat AS (
        SELECT DISTINCT fraction, id, t FROM (
          SELECT fraction, id, unnest({sequences}) AS t FROM split
        ) s JOIN vocab v USING (fraction) WHERE v.gram = s.t
      ), items AS (
        SELECT 'unigram' AS scenario, * FROM uni UNION ALL SELECT 'bigram', * FROM bi
        UNION ALL SELECT 'patterns', * FROM pat
        UNION ALL (SELECT 'all', * FROM uni UNION SELECT 'all', * FROM bi UNION SELECT 'all', * FROM pat)
      ), feat AS (
        SELECT i.scenario, fraction, id, any_value(label) AS label, any_value(is_test) AS is_test,
               list_distinct(list(t)) AS f
        FROM items i JOIN split USING (fraction, id) GROUP BY i.scenario, fraction, id
      ), {_signatures('feat', max(NUM_HASH_TABLES), f'{runs}, id')}, {_forest(NUM_HASH_TABLES, max(K_VALUES), runs)},
      ks(k) AS (VALUES {ks}), top AS (SELECT k, forest.* FROM forest JOIN ks ON rank <= k),
      votes AS (
        SELECT {runs}, num_hash_tables, k, test_id, train_label, sum(
          CASE WHEN overlap > 0 THEN (overlap * 1000000000000::BIGINT) // union_size
               ELSE 1000000 END) AS votes FROM top GROUP BY ALL
      ), winner AS (
        SELECT * FROM (
          SELECT *, row_number() OVER (
            PARTITION BY {runs}, num_hash_tables, k, test_id ORDER BY votes DESC, train_label) AS r FROM votes
        ) WHERE r = 1
      ), trained AS (
        SELECT {runs}, label AS fallback, train_size FROM (
          SELECT *, row_number() OVER (PARTITION BY {runs} ORDER BY n DESC, label) AS r,
                 sum(n) OVER (PARTITION BY {runs})::BIGINT AS train_size
          FROM (SELECT {runs}, label, count(*) AS n FROM feat WHERE NOT is_test GROUP BY ALL)
        ) WHERE r = 1
      ), preds AS (
        SELECT f.scenario, f.fraction, f.k, f.num_hash_tables, f.label, w.train_label IS NULL AS is_fallback,
               coalesce(w.train_label, t.fallback) AS prediction, t.train_size
        FROM (SELECT * FROM feat, ks, (VALUES {tables}) AS c(num_hash_tables) WHERE is_test) f
        LEFT JOIN trained t ON f.scenario = t.scenario AND f.fraction = t.fraction
        LEFT JOIN winner w ON w.scenario = f.scenario AND w.fraction = f.fraction
          AND w.k = f.k AND w.num_hash_tables = f.num_hash_tables AND w.test_id = f.id
      ), found AS (SELECT {runs}, num_hash_tables, k, count(*) AS n FROM top GROUP BY ALL),
      cells AS (
        SELECT {runs}, k, count(*) FILTER (prediction = label) / count(*) AS accuracy,
               coalesce(any_value(n), 0) / count(*) AS avg_candidates,
               coalesce(any_value(n), 0) AS neighbor_pairs,
               count(*) FILTER (is_fallback) AS n_fallback, count(*) AS test_size,
               any_value(train_size) AS train_size, num_hash_tables
        FROM preds LEFT JOIN found USING ({runs}, num_hash_tables, k) GROUP BY {runs}, num_hash_tables, k
      ) SELECT * FROM cells"""


def _swept() -> str:
    """CTEs ``cells`` (all table counts), ``timed``, ``best`` and ``summary``."""
    runs = "scenario, fraction"
    cells = f"SELECT * FROM ({_sweep()})"
    return f"""WITH {HARNESS}, cells AS ({cells}
      ), timed AS (
        SELECT *, train_size / 1e6::DOUBLE AS train_rows_m, neighbor_pairs / 1e6::DOUBLE AS pairs_m
        FROM cells
      ), best AS (
        SELECT * FROM (
          SELECT *, train_rows_m + pairs_m AS total_m,
                 row_number() OVER (PARTITION BY {runs} ORDER BY accuracy DESC,
                   train_rows_m + pairs_m, num_hash_tables, k) AS r
          FROM timed
        ) WHERE r = 1
      ), total AS (SELECT count(*) AS base FROM harness),
      summary AS (
        SELECT CASE scenario {' '.join(f"WHEN '{s}' THEN '{n}'" for s, n in SCENARIOS.items())} END
                 AS scenario_label, scenario, fraction AS fraction_requested,
               greatest(1, round_even(base * fraction, 0))::BIGINT / base AS fraction_actual,
               greatest(1, round_even(base * fraction, 0))::BIGINT AS sample_size,
               num_hash_tables, k, accuracy, train_rows_m, pairs_m, total_m
        FROM best, total
      )"""


def _cut(rows: str, quota: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT *, row_number() OVER ({part} ORDER BY md5('42:' || id), id)
        <= {quota.replace('{total}', f'count(*) OVER ({part})')} AS chosen FROM {rows}"""


def _unrolled_crc() -> str:
    """CRC-32 table from its rule: eight shift-and-xor steps per byte value."""
    step = "lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END"
    return f"""crc_table AS (
        SELECT list(v ORDER BY n) AS tab FROM (
          SELECT n, list_reduce(list_prepend(n, range(8)), {step}) AS v FROM range(256) x(n)
        )
      )"""


def _bloom_sums(words: str) -> str:
    """``sums(w, crc, lo, hi)``: CRC-32 and the halves of Adler-32 of each distinct word."""
    return f"""octets AS (
        SELECT w, list_transform(range(1, len(hex(w::BLOB)) // 2 + 1),
          lambda i: ('0x' || substr(hex(w::BLOB), 2 * i - 1, 2))::BIGINT) AS o
        FROM (SELECT DISTINCT w FROM {words})
      ), sums AS (
        SELECT w, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, o),
          lambda c, x: xor(c // 256, tab[xor(c % 256, x) + 1]))) AS crc,
          (1 + list_sum(o)) % 65521 AS lo,
          (len(o) + list_sum(list_transform(o, lambda x, i: x * (len(o) - i + 1)))) % 65521 AS hi
        FROM octets, crc_table
      )"""


def oracle_statements() -> dict[str, str]:
    sql: dict[str, str] = {}

    # sources
    sql["src_csv_fixed"] = f"""SELECT CASE {RAW} WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 END AS label,
        d.text FROM {INNER}"""
    sql["src_csv_header"] = sql["src_csv_fixed"]
    sql["src_named_columns"] = "SELECT role AS label, text FROM conversations"
    sql["src_pair_dropna"] = f"""SELECT d.doc_id::VARCHAR AS "textID", d.text,
        list_max(list_transform(string_split(d.text, chr(10)), lambda x: {{'n': length(x), 'line': x}}))['line']
          AS selected_text, {WORD} AS sentiment, part
        FROM {INNER}, (VALUES ('train'), ('test')) p(part) WHERE {RAW} <> 2"""
    sql["src_skip_malformed"] = f"SELECT {RAW} AS label, d.text FROM {INNER} WHERE {RAW} <> 2"
    sql["src_quarantine"] = f"""WITH lines AS (SELECT {RAW} AS raw, d.text FROM {LEFT})
      SELECT 'kept' AS outcome, raw::INT AS label_raw, coalesce(text, '') AS text, 1::BIGINT AS n_rows FROM lines WHERE raw = 4
      UNION ALL SELECT CASE WHEN raw IS NULL THEN 'missing fields' WHEN raw = 0 THEN 'surplus fields' ELSE 'bad value' END,
        NULL, NULL, count(*) FROM lines WHERE raw IS DISTINCT FROM 4 GROUP BY 1"""
    sql["src_row_cap"] = f"""SELECT id, CASE raw WHEN 0 THEN 0 ELSE 1 END AS label, text FROM (
        SELECT d.doc_id AS id, {RAW} AS raw, d.text FROM {INNER} ORDER BY d.doc_id LIMIT 100
      ) WHERE raw IN (0, 4)"""

    # sinks
    sql["sink_csv_roundtrip"] = f"SELECT doc_id AS id, {_alnum('text')} AS text FROM documents"

    sql["sink_csv_single_file"] = f"""SELECT d.doc_id AS id, {_alnum('d.text')} AS text, l.quality AS label,
        1 AS n_files FROM {INNER}"""
    job_words = _drop(f"string_split_regex({_letters('d.text')}, '\\s')", ENGLISH_STOP_WORDS)
    job = f"""jobs AS (SELECT d.doc_id AS id, l.quality AS label, {job_words} AS t FROM {INNER}),
      one AS (SELECT id, unnest(t) AS w FROM jobs),
      two AS (SELECT id, unnest({_grams('t', 2, ' ')}) AS w FROM jobs),
      terms AS (SELECT w FROM one UNION ALL SELECT w FROM two), {_murmur('terms', JOB_HASH_BUCKETS)},
      counted AS (SELECT id, i, 1 AS n FROM one JOIN hashed_buckets USING (w)
        UNION ALL SELECT id, i + {JOB_HASH_BUCKETS}, 1 FROM two JOIN hashed_buckets USING (w)),
      {_entries('counted')}"""
    sql["hashing_tf_counts"] = f"""WITH {job} SELECT id, label, coalesce(entries, '') AS entries
      FROM jobs LEFT JOIN listed USING (id)"""
    sql["project_features"] = f"""WITH {job} SELECT id AS row_id, label, coalesce(entries, '') AS entries
      FROM jobs LEFT JOIN listed USING (id)"""
    sql["sink_parquet_roundtrip"] = f"""WITH {job} SELECT label, coalesce(entries, '') AS entries
      FROM jobs LEFT JOIN listed USING (id)"""

    # projections and filters
    sql["project_label_text"] = f"SELECT d.doc_id AS id, {WORD} AS label, d.text FROM {INNER}"
    binary = f"""SELECT * FROM (SELECT d.doc_id AS id, CASE {RAW} WHEN 0 THEN 0 WHEN 4 THEN 1 END AS label
        FROM {LEFT}) WHERE label IS NOT NULL"""
    ternary = f"""SELECT * FROM (SELECT d.doc_id AS id,
        CASE {RAW} WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 END AS label
        FROM {LEFT}) WHERE label IS NOT NULL"""
    sql["recode_numeric_binary"] = sql["recode_word_binary"] = binary
    sql["recode_numeric_ternary"] = sql["recode_word_ternary"] = ternary
    sql["recode_keep_unmapped"] = f"""SELECT d.doc_id AS id,
        CASE {RAW} WHEN 4 THEN 1 ELSE {RAW} END AS label FROM {LEFT}"""
    sql["drop_null_subset"] = f"SELECT d.doc_id AS id, {WORD} AS word_label FROM {INNER}"
    sql["filter_nonempty_features"] = f"""SELECT id, len(t) - 2 AS n_features FROM (
        SELECT doc_id AS id, {_social_tokens('text')} AS t FROM documents) WHERE len(t) >= 3"""
    sql["check_two_classes"] = f"""SELECT count(DISTINCT {RAW}) AS n_classes,
        count(DISTINCT {RAW}) >= 2 AS has_two_classes FROM {INNER}"""

    # text and tokens
    for name, cleaner in (
        ("letters", _letters),
        ("social", _social),
        ("alnum", _alnum),
        ("ascii", _ascii),
    ):
        sql[f"clean_{name}"] = f"SELECT doc_id AS id, {cleaner('text')} AS text_clean FROM documents"
    letters_split = f"string_split_regex({_letters('text')}, '\\s')"
    sql["tokenize_ws"] = _listing(letters_split)
    sql["tokenize_regex"] = _listing(_gaps(_social("text")))
    sql["tokenize_match"] = _listing(_match("text", PLATFORM_STOP_WORDS))
    sql["stopwords_default"] = _listing(_drop(letters_split, ENGLISH_STOP_WORDS))
    sql["stopwords_extended"] = _listing(_social_tokens("text"))
    sql["stopwords_custom"] = _listing(_match("text", HARNESS_WORDS))
    sql["tokens_dedupe"] = f"""WITH a AS (SELECT doc_id AS id, {_gaps(_social('text'))} AS t FROM documents),
      b AS ({_ordered_distinct('a')})
      SELECT a.id, {_joined('b.t')} AS tokens, coalesce(len(b.t), 0) AS n_tokens
      FROM a LEFT JOIN b USING (id)"""
    for name, n, sep in (("ngram_bigram", 2, " "), ("ngram_n", 4, "_")):
        sql[name] = f"""SELECT id, {_joined('g', '|')} AS tokens, len(g) AS n_tokens FROM (
            SELECT id, {_grams('t', n, sep)} AS g FROM (
              SELECT doc_id AS id, {_social_tokens('text')} AS t FROM documents))"""
    doc_tokens = f"doc_tokens AS (SELECT doc_id AS id, {_social_tokens('text')} AS t FROM documents)"
    sql["mask_rare_words"] = f"""WITH {doc_tokens}, top AS (
        SELECT list(w) AS ws FROM (SELECT w FROM (SELECT unnest(t) AS w FROM doc_tokens)
          GROUP BY w ORDER BY count(*) DESC, w LIMIT {TOP_WORDS})
      ), masked AS (
        SELECT id, list_transform(t, lambda x: CASE WHEN list_contains(ws, x) THEN x ELSE '*' END) AS t
        FROM doc_tokens, top)
      SELECT id, {_joined('t')} AS tokens, len(t) AS n_tokens FROM masked"""
    sql["hfw_patterns"] = f"""WITH {doc_tokens}, {_pattern_ctes('doc_tokens', 'doc_tokens')}
      SELECT id, coalesce(string_agg(pattern, ' ' ORDER BY n, pos), '') AS patterns,
             count(pattern) AS n_patterns
      FROM doc_tokens LEFT JOIN pats USING (id) GROUP BY id"""
    sql["pattern_vocab_filter"] = f"""WITH {doc_tokens},
      flat AS (SELECT id, unnest(gs) AS g, generate_subscripts(gs, 1) AS p
               FROM (SELECT id, {_grams('t', 2, '_')} AS gs FROM doc_tokens)),
      vocab AS (SELECT g FROM flat GROUP BY g ORDER BY count(*) DESC, g LIMIT {SEQUENCES}),
      kept AS (SELECT id, string_agg(g, ' ' ORDER BY p) AS tokens FROM flat JOIN vocab USING (g) GROUP BY id)
      SELECT id, coalesce(tokens, '') AS tokens FROM doc_tokens LEFT JOIN kept USING (id)"""
    match_ctes = f"""listed AS (SELECT doc_id AS id, {_match('text', PLATFORM_STOP_WORDS)} AS t
        FROM documents), once AS ({_ordered_distinct('listed')}),
      toks AS (SELECT l.id, coalesce(o.t, []) AS t FROM listed l LEFT JOIN once o USING (id))"""
    bigrams, sequences = _grams("t", 2, "_"), _grams("t", SEQUENCE_LENGTH, "_")
    scenario_sql = {
        "unigram": "SELECT id, 1 AS b, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM toks",
        "bigram": f"""SELECT id, 2 AS b, unnest(g) AS w, generate_subscripts(g, 1) AS p
            FROM (SELECT id, {bigrams} AS g FROM toks)""",
        "patterns": """SELECT id, 3 AS b, s.w, s.p FROM seqs s JOIN vocab v ON s.w = v.w""",
    }
    scenario_sql["all"] = " UNION ALL ".join(scenario_sql.values())
    for scenario, items in scenario_sql.items():
        sql[f"features_{scenario}"] = f"""WITH {match_ctes},
          seqs AS (SELECT id, unnest(g) AS w, generate_subscripts(g, 1) AS p
                   FROM (SELECT id, {sequences} AS g FROM toks)),
          vocab AS (SELECT w FROM seqs GROUP BY w ORDER BY count(*) DESC, w LIMIT {SEQUENCES}),
          firsts AS (SELECT id, w, min(b * 1000000000::BIGINT + p) AS place FROM ({items}) GROUP BY id, w),
          feats AS (SELECT id, string_agg(w, ' ' ORDER BY place) AS f, count(*) AS n FROM firsts GROUP BY id)
          SELECT id, coalesce(f, '') AS features, coalesce(n, 0) AS n_features
          FROM toks LEFT JOIN feats USING (id)"""

    sql["jaccard_pair"] = f"""WITH t AS (
        SELECT conv_id, turn, list_distinct({_gaps('text')}) AS t FROM conversations)
      SELECT a.conv_id, a.turn, CASE WHEN len(a.t) + len(b.t) = 0 THEN 0.0 ELSE
        len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))
        END AS similarity
      FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""

    # vectors
    def ranked_terms(source: str, size: int) -> str:
        return f"""SELECT w, row_number() OVER (ORDER BY n DESC, w) - 1 AS i FROM (
            SELECT w, count(*) AS n FROM {source} GROUP BY w ORDER BY n DESC, w LIMIT {size})"""

    sql["count_vectorizer"] = f"""WITH {doc_tokens}, flat AS (SELECT id, unnest(t) AS w FROM doc_tokens),
      vocab AS ({ranked_terms('flat', PATTERN_COLUMNS)}),
      hits AS (SELECT DISTINCT id, i FROM flat JOIN vocab USING (w)),
      lists AS (SELECT id, string_agg(i::VARCHAR, ',' ORDER BY i) AS x FROM hits GROUP BY id)
      SELECT id, coalesce(x, '') AS indices FROM doc_tokens LEFT JOIN lists USING (id)"""
    def all_terms(source: str) -> str:
        return f"""SELECT w, row_number() OVER (ORDER BY n DESC, w) - 1 AS i FROM (
            SELECT w, count(*) AS n FROM {source} GROUP BY w)"""

    sql["assemble_blocks"] = f"""WITH {doc_tokens}, one AS (SELECT id, unnest(t) AS w FROM doc_tokens),
      two AS (SELECT id, unnest({_grams('t', 2, ' ')}) AS w FROM doc_tokens),
      v1 AS ({all_terms('one')}), v2 AS ({all_terms('two')}), width AS (SELECT count(*) AS n FROM v1),
      hits AS (SELECT DISTINCT id, i FROM one JOIN v1 USING (w)
               UNION ALL SELECT DISTINCT id, i + n FROM two JOIN v2 USING (w), width),
      lists AS (SELECT id, string_agg(i::VARCHAR, ',' ORDER BY i) AS x FROM hits GROUP BY id)
      SELECT id, coalesce(x, '') AS indices FROM doc_tokens LEFT JOIN lists USING (id)"""
    sql["hashing_tf_binary"] = f"""WITH eng AS (
        SELECT d.doc_id AS id, l.quality AS label, {_social_tokens('d.text')} AS tokens FROM {INNER}
      ), one AS (SELECT id, unnest(list_distinct(tokens)) AS w FROM eng), {_murmur('one', HASH_BUCKETS)},
      counted AS (SELECT DISTINCT id, i, 1 AS n FROM one JOIN hashed_buckets USING (w)), {_entries('counted')}
      SELECT id, label, coalesce(entries, '') AS entries FROM eng LEFT JOIN listed USING (id)"""
    split_rows = f"""eng AS (
        SELECT d.doc_id AS id, l.quality AS label, {_is_test('d.doc_id')} AS is_test,
               {_social_tokens('d.text')} AS tokens FROM {INNER})"""
    uni = "one AS (SELECT id, unnest(list_distinct(tokens)) AS w FROM eng)"
    bi = f"two AS (SELECT id, unnest(list_distinct({_grams('tokens', 2, ' ')})) AS w FROM eng)"
    learnt = f"""{_pattern_ctes("(SELECT id, tokens AS t FROM eng)", "(SELECT tokens AS t FROM eng WHERE NOT is_test)")},
      pvoc AS (SELECT pattern, row_number() OVER (ORDER BY n DESC, pattern) - 1 AS i FROM (
        SELECT pattern, count(*) AS n FROM pats JOIN eng USING (id) WHERE NOT is_test
        GROUP BY pattern ORDER BY n DESC, pattern LIMIT {PATTERN_COLUMNS})),
      three AS (SELECT id, i FROM pats JOIN pvoc USING (pattern))"""
    murmur_all = f"terms AS (SELECT w FROM one UNION ALL SELECT w FROM two), {_murmur('terms', HASH_BUCKETS)}"
    hits = {
        1: f"{uni}, {_murmur('one', HASH_BUCKETS)}, counted AS (SELECT DISTINCT id, i, 1 AS n FROM one JOIN hashed_buckets USING (w))",
        2: f"{bi}, {_murmur('two', HASH_BUCKETS)}, counted AS (SELECT DISTINCT id, i, 1 AS n FROM two JOIN hashed_buckets USING (w))",
        3: f"{learnt}, counted AS (SELECT id, i, 1 AS n FROM three)",
        4: f"""{uni}, {bi}, {murmur_all}, {learnt}, counted AS (
          SELECT DISTINCT id, i, 1 AS n FROM one JOIN hashed_buckets USING (w)
          UNION ALL SELECT DISTINCT id, i + {HASH_BUCKETS}, 1 FROM two JOIN hashed_buckets USING (w)
          UNION ALL SELECT id, i + {2 * HASH_BUCKETS}, 1 FROM three)""",
    }
    for scenario, steps in hits.items():
        sql[f"pipeline_scenario_{scenario}"] = f"""WITH {split_rows}, {steps}, {_entries('counted')}
          SELECT id, label, is_test, entries FROM eng JOIN listed USING (id)"""
    hashed_feat = f"""{ENGINE}, one AS (SELECT id, unnest(list_distinct(tokens)) AS w FROM eng),
      {_murmur('one', HASH_BUCKETS)}, feat AS (
        SELECT id, any_value(label) AS label, any_value(is_test) AS is_test, list_distinct(list(i)) AS f
        FROM one JOIN hashed_buckets USING (w) JOIN eng USING (id) GROUP BY id)"""
    sql["lsh_join_hashed"] = f"""WITH {hashed_feat}, {_pairs()},
      strings AS (SELECT id, list_transform(f, lambda i: i::VARCHAR) AS f FROM feat),
      {_signatures('strings', BAND_HASHES)},
      bands AS (SELECT id, j // {ROWS_PER_BAND} AS band, list(v ORDER BY j) AS vs FROM sig GROUP BY ALL)
      SELECT n.test_id, n.train_id, any_value(distance) AS distance, (min(a.band) + 1)::INT AS first_band
      FROM near n JOIN bands a ON a.id = n.test_id
      JOIN bands b ON b.id = n.train_id AND a.band = b.band AND a.vs = b.vs GROUP BY n.test_id, n.train_id"""
    sql["lsh_join_hashed_tables"] = f"""WITH {hashed_feat}, {_pairs()},
      strings AS (SELECT id, list_transform(f, lambda i: i::VARCHAR) AS f FROM feat),
      {_signatures('strings', SIGNATURE_HASHES)}
      SELECT n.test_id, n.train_id, any_value(distance) AS distance, (min(a.j) + 1)::INT AS first_table
      FROM near n JOIN sig a ON a.id = n.test_id
      JOIN sig b ON b.id = n.train_id AND a.j = b.j AND a.v = b.v GROUP BY n.test_id, n.train_id"""
    sql["bloom_indices"] = f"""WITH {doc_tokens}, {_unrolled_crc()},
      flat AS (SELECT id, unnest(t) AS w FROM doc_tokens),
      {_bloom_sums('flat')}, bits AS (
        SELECT DISTINCT id, ((crc + i * (hi * 65536 + lo)) % {BLOOM_BITS})::BIGINT AS b
        FROM flat JOIN sums USING (w), range({BLOOM_HASHES}) r(i)
      ), lists AS (SELECT id, string_agg(b::VARCHAR, ',' ORDER BY b) AS x FROM bits GROUP BY id)
      SELECT id, coalesce(x, '') AS indices FROM doc_tokens LEFT JOIN lists USING (id)"""

    # aggregations
    sql["count_rows"] = f"""WITH s AS (SELECT {_is_test('d.doc_id')} AS is_test FROM {INNER})
      SELECT 'documents' AS part, count(*) AS n_rows FROM documents
      UNION ALL SELECT 'labelled', count(*) FROM s
      UNION ALL SELECT 'train', count(*) FROM s WHERE NOT is_test
      UNION ALL SELECT 'test', count(*) FROM s WHERE is_test"""
    sql["count_per_class"] = f"SELECT {RAW} AS raw_label, count(*) AS n_rows FROM {INNER} GROUP BY 1"
    sql["hfw_top_words"] = f"""SELECT term, count(*) AS n_uses FROM (
        SELECT unnest({_social_tokens('text')}) AS term FROM documents)
      GROUP BY term ORDER BY n_uses DESC, term LIMIT {TOP_WORDS}"""
    sql["pattern_vocab_topn"] = f"""WITH {match_ctes} SELECT term, count(*) AS n_uses FROM (
        SELECT unnest({bigrams}) AS term FROM toks)
      GROUP BY term ORDER BY n_uses DESC, term LIMIT {SEQUENCES}"""
    sql["majority_label"] = f"""SELECT {RAW} AS majority_label, count(*) AS n_rows FROM {INNER}
      GROUP BY 1 ORDER BY n_rows DESC, 1 LIMIT 1"""
    sql["dedupe_clean_text"] = f"""SELECT min(doc_id) AS id, tc AS text_clean FROM (
        SELECT doc_id, {_social('text')} AS tc FROM documents) GROUP BY tc"""
    sql["dedupe_raw_text"] = "SELECT min(doc_id) AS id, text FROM documents GROUP BY text"
    sequences3 = _grams("tokens", SEQUENCE_LENGTH, "_")
    sql["retained_pct"] = f"""WITH {HARNESS},
      seqs AS (SELECT id, unnest({sequences3}) AS w FROM harness),
      vocab AS (SELECT w FROM seqs GROUP BY w ORDER BY count(*) DESC, w LIMIT {SEQUENCES}),
      known AS (SELECT DISTINCT id FROM seqs JOIN vocab USING (w)),
      marks AS (
        SELECT len(tokens) > 0 AS unigram, len(tokens) > 1 AS bigram, known.id IS NOT NULL AS patterns
        FROM harness LEFT JOIN known USING (id)),
      kept AS (
        SELECT 'unigram' AS scenario, unigram AS k FROM marks UNION ALL SELECT 'bigram', bigram FROM marks
        UNION ALL SELECT 'patterns', patterns FROM marks
        UNION ALL SELECT 'all', unigram OR bigram OR patterns FROM marks)
      SELECT count(*) AS n_rows, scenario, count(*) FILTER (k) AS n_kept,
             count(*) FILTER (k) * 100 / count(*) AS retained_pct FROM kept GROUP BY scenario"""
    sql["first_n_per_class"] = f"""SELECT * FROM (
        SELECT d.doc_id AS id, {RAW} AS label,
               row_number() OVER (PARTITION BY {RAW} ORDER BY d.doc_id)::INT AS rank FROM {INNER}
      ) WHERE rank <= 3"""
    sql["union_by_name"] = f"""SELECT {WORD} AS label, d.text FROM {INNER}
      UNION ALL SELECT role, text FROM conversations"""
    sql["preview_features"] = f"""SELECT doc_id AS id, {_joined(_social_tokens('text'))} AS tokens
      FROM documents ORDER BY doc_id LIMIT 5"""

    # neighbours and votes
    sql["jaccard_threshold_join"] = f"""{NEIGHBORS} SELECT test_id, test_label, train_id, train_label,
        distance, overlap, union_size FROM near"""
    sql["jaccard_prefix_join"] = f"""WITH {ENGINE}, {_feature_rows(1)}, {_pairs(NEAR_THRESHOLD)}
      SELECT test_id, test_label, train_id, train_label, distance, overlap, union_size FROM near"""
    sql["pairs_distinct"] = f"{NEIGHBORS} SELECT DISTINCT test_id, train_id FROM near"
    sql["lsh_similarity_join"] = f"""WITH {ENGINE}, {_feature_rows(1)}, {_pairs()},
        {_signatures('feat', SIGNATURE_HASHES)}
      SELECT n.test_id, n.train_id, any_value(distance) AS distance, (min(a.j) + 1)::INT AS first_table
      FROM near n JOIN sig a ON a.id = n.test_id
      JOIN sig b ON b.id = n.train_id AND a.j = b.j AND a.v = b.v GROUP BY n.test_id, n.train_id"""
    sql["knn_topk"] = f"{NEIGHBORS} SELECT test_id, train_id, train_label, distance, rank FROM top"
    sql["vote_counts"] = f"{NEIGHBORS}, {VOTES} SELECT * FROM votes"
    sql["vote_winner"] = f"{NEIGHBORS}, {VOTES} SELECT * FROM winner"
    weighted = VOTES.replace(
        "count(*) AS votes", "sum((overlap * 1000000000000::BIGINT) // union_size)::BIGINT AS votes"
    )
    sql["vote_weighted"] = f"""{NEIGHBORS}, {weighted}
      SELECT test_id, test_label, train_label, votes, prediction FROM votes JOIN winner USING (test_id)"""
    sql["predict_with_fallback"] = f"{NEIGHBORS}, {VOTES}, {PREDICTIONS} SELECT * FROM preds"
    sql["accuracy"] = f"""{NEIGHBORS}, {VOTES}, {PREDICTIONS}
      SELECT count(*) FILTER (prediction = test_label) AS n_correct, count(*) AS test_size,
             count(*) FILTER (is_fallback) AS n_fallback,
             count(*) FILTER (prediction = test_label) / count(*) AS accuracy FROM preds"""
    sql["avg_neighbors"] = f"{EVALUATED} SELECT avg_candidates, neighbor_pairs, test_size FROM cell"
    sql["minhash_signature"] = f"""WITH rows AS (
        SELECT doc_id AS id, list_distinct({_social_tokens('text')}) AS f FROM documents),
      {_signatures('rows', SIGNATURE_HASHES)},
      lists AS (SELECT id, string_agg(v::VARCHAR, ',' ORDER BY j) AS s FROM sig GROUP BY id)
      SELECT id, coalesce(s, '') AS signature FROM rows LEFT JOIN lists USING (id)"""
    sql["sink_signature_sample"] = f"""WITH {HARNESS}, first AS (
        SELECT * FROM (SELECT id, label, tokens AS f,
          row_number() OVER (PARTITION BY label ORDER BY id) AS r FROM harness) WHERE r <= 3),
      {_signatures('first', SIGNATURE_HASHES)}
      SELECT label, id AS key, {_joined('any_value(f)')} AS tokens,
             string_agg(v::VARCHAR, ',' ORDER BY j) AS signature
      FROM first JOIN sig USING (id) GROUP BY label, id"""
    sql["lsh_banded_topk"] = f"""WITH {ENGINE}, {_feature_rows(1)}, {_signatures('feat', SIGNATURE_HASHES)},
      {_forest([SIGNATURE_HASHES], 50)} SELECT test_id, train_id, distance, rank FROM forest"""

    # samples and splits
    raw_rows = f"(SELECT d.doc_id AS id, {RAW} AS label FROM {INNER})"
    sql["sample_balanced"] = f"""SELECT id, label FROM ({_cut(raw_rows, '40', 'label')}) WHERE chosen"""
    sql["sample_fractions"] = f"""SELECT label, count(*) AS n_rows,
        least(1.0::DOUBLE, 100 / count(*)) AS fraction FROM {raw_rows} GROUP BY label"""
    sql["sample_uniform"] = f"""SELECT id FROM (
        {_cut('(SELECT doc_id AS id FROM documents)', '500')}) WHERE chosen"""
    sql["split_random"] = f"SELECT doc_id AS id, {_is_test('doc_id')} AS is_test FROM documents"
    sql["split_stratified"] = f"""SELECT id, label, chosen AS is_test FROM (
        {_cut(raw_rows, 'floor({total} * 0.2::DOUBLE + 0.5)', 'label')})"""

    sql["row_key"] = f"""SELECT doc_id AS id, ('0x' || substr(md5({_social('text')}), 1, 15))::BIGINT AS row_id
      FROM documents"""

    # experiments
    sql["knn_evaluate"] = f"{EVALUATED} SELECT * FROM cell"
    ternary = f"WITH {_engine(TERNARY)}, {_feature_rows(1)}, {_pairs()}, {_topk()}, {VOTES}, {PREDICTIONS}, {CELL}"
    sql["knn_evaluate_ternary"] = f"{ternary} SELECT * FROM cell"
    judged = f"{_pairs()}, {_topk()}, {VOTES}, {PREDICTIONS}, {CELL}"
    bloom_feat = f"""{ENGINE}, {_unrolled_crc()}, flat AS (SELECT id, unnest(list_distinct(tokens)) AS w FROM eng),
      {_bloom_sums('flat')}, bits AS (
        SELECT DISTINCT id, ((crc + i * (hi * 65536 + lo)) % {HASH_BUCKETS})::BIGINT AS b
        FROM flat JOIN sums USING (w), range({BLOOM_HASHES}) r(i)
      ), feat AS (SELECT id, any_value(label) AS label, any_value(is_test) AS is_test, list(b) AS f
                  FROM bits JOIN eng USING (id) GROUP BY id)"""
    sql["bloom_vs_hashing"] = f"""SELECT *, 'hashing' AS kind FROM (WITH {hashed_feat}, {judged} SELECT * FROM cell)
      UNION ALL SELECT *, 'bloom' FROM (WITH {bloom_feat}, {judged} SELECT * FROM cell)"""
    grid = " UNION ALL ".join(f"SELECT * FROM ({_grid(s, n)})" for n in (0, 1) for s in (1, 2, 3, 4))
    order = "use_neutral, scenario, num_hash_tables, k"
    sql["knn_grid"] = sql["sink_results"] = grid
    sql["results_sorted"] = f"SELECT * FROM ({grid}) ORDER BY {order}"
    sql["best_config"] = f"SELECT {order}, accuracy FROM ({grid}) ORDER BY accuracy DESC, {order} LIMIT 1"
    sweep = _swept()
    sql["fraction_sweep"] = f"{sweep} SELECT * FROM cells"
    sql["src_results_partitioned"] = (
        f"{sweep} SELECT * REPLACE (fraction::VARCHAR AS fraction) FROM timed"
    )
    sql["best_per_run"] = f"""{sweep} SELECT scenario, fraction, num_hash_tables, k, accuracy,
        total_m FROM best"""
    sql["sweep_summary"] = f"{sweep} SELECT * FROM summary"
    columns = ", ".join(
        f"coalesce(max(v) FILTER (scenario = '{s}'), 0) AS \"{s}\"" for s in SCENARIOS
    )
    sql["sweep_pivot"] = f"""{sweep}, measured AS (
        SELECT 'train_rows_m' AS measure, fraction_actual AS fraction, scenario, train_rows_m AS v FROM summary
        UNION ALL SELECT 'total_m', fraction_actual, scenario, total_m FROM summary)
      SELECT measure, fraction, {columns} FROM measured GROUP BY 1, 2 ORDER BY 1, 2"""
    return sql
