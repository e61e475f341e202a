"""SQL counterparts of the text queries that SQL can express, written from the rules and not from the operators."""

from __future__ import annotations

from phenoweave.llm import quality_rules, secrets

TOPK = """
WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS vector FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.vector, c.vector) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, both_ways.y FROM reach JOIN both_ways ON reach.b = both_ways.x
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = d.doc_id
"""


SEARCH = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), q AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark
), asked AS (SELECT i, item_id, unnest(ts) AS t FROM q),
word AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM d),
tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM word GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
every AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS tokens FROM d WHERE len(ts) > 0),
scored AS (
  SELECT i, item_id, r, doc_id, CAST(sum(CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // tokens)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (t) JOIN df USING (t), every GROUP BY ALL
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

LINES = r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS pos FROM t),
keyed AS (SELECT *, translate(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
shared AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
told AS (SELECT k.*, (s.key IS NOT NULL AND k.doc_id <> s.keeper) AS gone FROM keyed k LEFT JOIN shared s ON s.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""

TRIE = r"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
    {'r': coalesce(role, ''), 't': coalesce(text, '')} AS u FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT c, list(u ORDER BY k) AS us FROM turns GROUP BY c),
heads AS (
  SELECT *, (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) % 6 AS h FROM own
), rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.us, [])[1:a.h], a.us[a.h + 1:]) AS us FROM heads a LEFT JOIN own b ON b.c = a.c - a.c % 100
), members AS (SELECT c, len(us) AS l, unnest(range(len(us) + 1)) AS d, us FROM rebuilt),
nodes AS (
  SELECT d, us[1:d] AS path, min(c) AS conv_id, count(*) AS n, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE l = d) AS ends FROM members GROUP BY d, us[1:d]
), children AS (SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
known AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children, (n - 1) * CASE WHEN nodes.d > 0 THEN length(nodes.path[-1].t) ELSE 0 END AS own
  FROM nodes LEFT JOIN children ON children.d = nodes.d AND children.path = nodes.path
), below AS (SELECT unnest(range(d + 1)) AS a, path, n_children, own FROM known),
sums AS (SELECT a AS d, path[1:a] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own) AS saved FROM below GROUP BY a, path[1:a])
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(k.n AS BIGINT) AS n_convs, CAST(k.n_children AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(k.ends, '')) AS ends_sha256
FROM known k JOIN sums s ON s.d = k.d AND s.path = k.path LEFT JOIN nodes up ON up.d = k.d - 1 AND up.path = k.path[1:k.d - 1]
"""


def _secrets_sql() -> str:
    parts = []
    for place, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, '{rule.kind}' AS kind, {place} AS place, unnest(string_split_regex(text, '{pattern}')) AS gap, "
            f"unnest(regexp_extract_all(text, '{pattern}')) AS hit, unnest(regexp_extract_all(text, '{pattern}', {rule.group})) AS judged, "
            f"{rule.least} AS least, unnest(range(len(string_split_regex(text, '{pattern}')))) AS pos FROM t"
        )
    base = len(secrets.BASE_RULES)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS ({" UNION ALL ".join(parts)}),
placed AS (
  SELECT *, CAST(sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id, place ORDER BY pos) AS BIGINT) AS stop FROM cut
), found AS (SELECT doc_id, kind, place, stop - length(hit) AS start, stop FROM placed WHERE hit IS NOT NULL AND length(judged) >= least),
folded AS (
  SELECT doc_id,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (WHERE place < {base}) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans,
    {", ".join(f"count(*) FILTER (WHERE place = {k}) AS n_{rule.kind}" for k, rule in enumerate(secrets.BASE_RULES))}
  FROM found GROUP BY doc_id
)
SELECT t.doc_id, {", ".join(f"CAST(coalesce(n_{rule.kind}, 0) AS BIGINT) AS n_{rule.kind}" for rule in secrets.BASE_RULES)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN folded USING (doc_id)
"""


def _rules_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
    ratio = lambda part, whole: f"CASE WHEN {whole} > 0 THEN {part}::DOUBLE / {whole} ELSE 0 END"
    measures = {
        "n_words": "n_words",
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "n_words"),
        "stop_words": "n_stop_words",
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "bullet_line_ratio": ratio("n_bullet_lines", "n_lines"),
        "ellipsis_line_ratio": ratio("n_ellipsis_lines", "n_lines"),
    }
    passed = []
    for rule in quality_rules.RULES:
        passed += [f"{measures[rule.measure]} >= {rule.least}"] if rule.least is not None else []
        passed += [f"{measures[rule.measure]} <= {rule.most}"] if rule.most is not None else []
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM t),
word AS (SELECT doc_id, unnest(w) AS a, unnest(range(len(w))) AS pos FROM words),
per_word AS (
  SELECT doc_id, count(*) AS n_words, sum(length(a)) AS word_chars, count(DISTINCT lower(a)) FILTER (WHERE lower(a) IN ({stops})) AS n_stop_words FROM word GROUP BY doc_id
), windows AS (
  SELECT doc_id, pos, a, lead(a) OVER w AS b, lead(a, 2) OVER w AS c FROM word WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), again AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows WHERE c IS NOT NULL),
covered AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM again WHERE n > 1),
per_window AS (SELECT doc_id, count(*) AS n_repeat_words FROM covered GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t),
per_line AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines,
    count(*) FILTER (WHERE regexp_matches(l, '^[\x20\x09-\x0D]*[-*•]')) AS n_bullet_lines,
    count(*) FILTER (WHERE regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS n_ellipsis_lines
  FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counted AS (
  SELECT t.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_bullet_lines, 0) AS n_bullet_lines, coalesce(n_ellipsis_lines, 0) AS n_ellipsis_lines
  FROM t LEFT JOIN per_word USING (doc_id) LEFT JOIN per_window USING (doc_id) LEFT JOIN per_line USING (doc_id)
), judged AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {" AND ".join(passed)}) AS kept FROM judged
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_topk": TOPK,
        "op6_ngram_jaccard": JACCARD,
        "op9_secret_scans": _secrets_sql(),
        "op10_quality_rules": _rules_sql(),
        "op11_lexical_search": SEARCH,
        "op12_line_dedup": LINES,
        "op13_prefix_trie": TRIE,
    }
