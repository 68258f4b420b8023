"""Comparison SQL of the operators that SQL can express."""

from __future__ import annotations

from itertools import permutations

SQL: dict[str, str] = {}

_RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("google", "AIza[0-9A-Za-z_-]{35}", 0, 1),
    ("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
]


def _secrets() -> str:
    def found(i, kind, pattern, group, least):
        return f"""list_filter(list_transform(range(1, len(m{i}) + 1), lambda k: {{
            'start': list_sum(list_transform(p{i}[1:k], lambda x: length(x)))::BIGINT
                + coalesce(list_sum(list_transform(m{i}[1:k - 1], lambda x: length(x))), 0)::BIGINT,
            'o': {i}, 'n': length(m{i}[k]), 'g': length(g{i}[k]), 'kind': '{kind}'}}),
            lambda s: s.g >= {least})"""

    rules = [(i, k, p.replace("'", "''"), g, n) for i, (k, p, g, n) in enumerate(_RULES)]
    parts = ", ".join(
        f"regexp_extract_all(t, '{p}', 0) AS m{i}, regexp_extract_all(t, '{p}', {g}) AS g{i}, "
        f"regexp_split_to_array(t, '{p}') AS p{i}"
        for i, _, p, g, _ in rules
    )
    text = "array_to_string(list_transform({}, lambda s: s.kind || ':' || s.start || ':' || (s.start + s.n)), ',')"
    counts = ", ".join(f"len(list_filter(spans, lambda s: s.kind = '{r[1]}')) AS n_{r[1]}" for r in rules[:3])
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (SELECT doc_id, {parts} FROM texts),
s AS (SELECT doc_id, list_sort(list_concat({", ".join(found(*r) for r in rules)})) AS spans FROM parts)
SELECT doc_id, {counts},
       sha256({text.format("list_filter(spans, lambda s: s.o < 3)")}) AS base_sha256, {text.format("spans")} AS spans
FROM s"""


SQL["op2_secrets"] = _secrets()

SQL["op8_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""

SQL["op11_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
),
i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
),
t AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d),
f AS (SELECT word, count(*) AS n FROM t GROUP BY word),
w AS (
  SELECT DISTINCT item_id, words[k + 1:k + 10] AS terms
  FROM (SELECT *, unnest(range(greatest(len(words) - 10, 0) + 1)) AS k FROM i WHERE len(words) > 0)
),
win AS (SELECT terms, row_number() OVER () AS win FROM (SELECT DISTINCT terms FROM w)),
pr AS (
  SELECT *, row_number() OVER (PARTITION BY win ORDER BY n, word, off) AS k, count(*) OVER (PARTITION BY win) AS c
  FROM (SELECT win, len(terms) AS size, unnest(terms) AS word, unnest(range(len(terms))) AS off FROM win) JOIN f USING (word)
),
g AS (
  SELECT r, pos, n, words[pos + 1:pos + n] AS terms
  FROM (SELECT r, words, n, unnest(range(len(words) - n + 1)) AS pos
        FROM d, (SELECT DISTINCT len(terms) AS n FROM win) WHERE len(words) >= n)
),
hit AS (SELECT r, pos, n, win FROM g JOIN win USING (terms)),
n_hit AS (
  SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(pos, pos + n)) AS pos FROM hit) GROUP BY r
),
items AS (
  SELECT r, list_sort(list(DISTINCT item_id)) AS items
  FROM (SELECT DISTINCT r, win FROM hit) JOIN win USING (win) JOIN w USING (terms) GROUP BY r
),
near1 AS (SELECT win, size, r, pos - off AS start FROM pr JOIN t USING (word) WHERE k = 1 AND c = size),
near2 AS (
  SELECT DISTINCT near1.* FROM near1 JOIN pr ON pr.win = near1.win AND pr.k = 2
  JOIN t ON t.r = near1.r AND t.word = pr.word AND abs(t.pos - start - off) <= 2
  UNION ALL SELECT * FROM near1 WHERE size < 2
),
near3 AS (
  SELECT DISTINCT near2.* FROM near2 JOIN pr ON pr.win = near2.win AND pr.k = 3
  JOIN t ON t.r = near2.r AND t.word = pr.word AND abs(t.pos - start - off) <= 2
  UNION ALL SELECT * FROM near2 WHERE size < 3
),
near AS (
  SELECT r, count(DISTINCT item_id) AS n_near_items
  FROM (SELECT DISTINCT r, win FROM near3) JOIN win USING (win) JOIN w USING (terms) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near_items, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN items USING (r) LEFT JOIN near USING (r)"""


def _filter_audit() -> str:
    orders = [
        (order, step, "ABCDE".index(letter), sum(1 << "ABCDE".index(c) for c in order[: step - 1]))
        for order in map("".join, permutations("ABCDE")) for step, letter in enumerate(order, 1)
    ]
    steps = ", ".join(f"('{o}', {s}, {f}, {b})" for o, s, f, b in orders)
    return f"""
WITH steps(filter_order, step, f, before) AS (VALUES {steps}),
t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
),
d AS (
  SELECT doc_id, part,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS failed
  FROM t
),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
),
c AS (
  SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM d LEFT JOIN l USING (doc_id) GROUP BY part, failed
),
s AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN failed & (before | (1 << f)) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN failed & before = 0 AND failed >> f & 1 = 1 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN failed & before <> 0 AND failed >> f & 1 = 1 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN failed = 1 << f THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN failed & before = 0 AND failed >> f & 1 = 1 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN failed & before = 0 AND failed >> f & 1 = 1 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, steps GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM s"""


SQL["op12_filter_audit"] = _filter_audit()

SQL["op13_spelling"] = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY b) AS crcs FROM (
    SELECT b, list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) t(b))
),
runs AS (
  SELECT id, run, length(run) AS size, count(*) AS times FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(
      unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents)
  WHERE length(run) >= 6 GROUP BY id, run
),
bytes AS (
  SELECT run, size, times, list_transform(
    string_split_regex(regexp_replace(hex(encode(id || ':' || run)), '(..)', '\1 ', 'g'), ' ')[:-2],
    lambda x: ('0x' || x)::BIGINT) AS b
  FROM runs
),
hashed AS (
  SELECT run, size, times, xor(4294967295, list_reduce([4294967295::BIGINT] || b,
    lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1]))) AS h
  FROM bytes, crc_table
),
w AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % size)::BIGINT) || substr(run, (h % size)::BIGINT + 2) ELSE run END AS word
    FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
),
cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
),
near AS (
  SELECT DISTINCT * FROM (
    SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION ALL SELECT cut.word, w.word, w.n FROM cut JOIN w ON cut.rest = w.word
    UNION ALL SELECT w.word, cut.word, cut.n FROM cut JOIN w ON cut.rest = w.word)
),
best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word
),
formed AS (
  SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form,
         CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
  FROM w LEFT JOIN best USING (word)
),
way AS (
  SELECT word, word AS root FROM formed
  UNION ALL SELECT way.word, f.form FROM way JOIN formed f ON f.word = way.root WHERE f.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n
FROM formed JOIN (
  SELECT way.word, way.root FROM way JOIN formed f ON f.word = way.root WHERE f.form IS NULL
) USING (word)"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
