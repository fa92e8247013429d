"""SQL for DuckDB that gives the rows of those numbered queries that SQL can express."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

WORD = r"[^\x20\x09-\x0D]+"

OP1 = f"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{WORD}') AS w FROM documents),
sets AS (SELECT r, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
shingles AS (SELECT r, unnest(s) AS h FROM sets),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.h = b.h AND a.r < b.r GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sets x ON x.r = a JOIN sets y ON y.r = b WHERE 100 * c >= 75 * (len(x.s) + len(y.s) - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(r, t) AS (SELECT r, r FROM sets UNION SELECT reach.r, edges.b FROM reach JOIN edges ON edges.a = reach.t),
found AS (SELECT reach.r, min(sets.doc_id) AS component_id FROM reach JOIN sets ON sets.r = reach.t GROUP BY reach.r)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM sets JOIN found USING (r)
"""

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(5), lambda j: CAST(substr(bits, i * 5 + j + 1, 1) AS INTEGER) * (16 >> CAST(j AS INTEGER)))) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM d
"""

OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""

#: Fixed values of the quality rules, as in the operator: measure, slack.
MEASURES = (("word_length", 1200), ("symbols", 150), ("dup_lines", 500), ("repeats", 300))


def fences(keys: str) -> str:
    """Quartiles and fences of each measure for groups of keys."""
    by = f"{keys}, " if keys else ""
    return f"""(SELECT {by}m, max(n_all) AS docs, min(value) FILTER (4 * upto >= n_all) AS q1, min(value) FILTER (4 * upto >= 3 * n_all) AS q3 FROM
      (SELECT {by}m, sum(n) OVER (PARTITION BY {by}m ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {by}m) AS n_all,
        CASE WHEN b < 32 THEN b ELSE (b - 16 * ((b - 16) // 16)) << ((b - 16) // 16) END AS value
       FROM (SELECT {by}m, b, count(*) AS n FROM buckets GROUP BY ALL)) GROUP BY {by}m)"""


OP6 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, lang, source FROM documents),
words AS (SELECT r, regexp_extract_all(text, '{WORD}') AS w FROM docs),
windows AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS h FROM words WHERE len(w) >= 8),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, h) > 1),
covered AS (SELECT r, count(*) AS n_repeat_words FROM (SELECT DISTINCT r, i + unnest(range(8)) AS word FROM twice) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
filled AS (SELECT r, row_number() OVER (PARTITION BY r, line ORDER BY pos) > 1 AS again FROM lines WHERE regexp_matches(line, '{WORD}')),
by_line AS (SELECT r, count(*) AS n_lines, count(*) FILTER (again) AS n_dup_lines FROM filled GROUP BY r),
base AS (SELECT r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM docs JOIN words USING (r) LEFT JOIN covered USING (r) LEFT JOIN by_line USING (r)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
measured AS (SELECT r, lang, source, base_failed, unnest(range(4)) AS m, unnest([coalesce(word_chars * 1000 // nullif(n_words, 0), 0), coalesce(n_symbols * 1000 // nullif(n_words, 0), 0), coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0), coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0)]) AS x FROM judged),
buckets AS (SELECT r, lang, source, m, CASE WHEN x < 32 THEN x ELSE 16 * (length(bin(x)) - 5) + (x >> (length(bin(x)) - 5)) END AS b FROM measured WHERE NOT base_failed),
own AS {fences("lang, source")}, by_lang AS {fences("lang")}, whole AS {fences("")},
chosen AS (SELECT o.lang, o.source, o.m, CASE WHEN o.docs >= 100 THEN o.q1 WHEN l.docs >= 100 THEN l.q1 ELSE w.q1 END AS q1, CASE WHEN o.docs >= 100 THEN o.q3 WHEN l.docs >= 100 THEN l.q3 ELSE w.q3 END AS q3
  FROM own o LEFT JOIN by_lang l ON o.lang IS NOT DISTINCT FROM l.lang AND o.m = l.m JOIN whole w ON o.m = w.m),
fenced AS (SELECT *, 4 * (q3 - q1) + [{", ".join(str(s) for _, s in MEASURES)}][m + 1] AS spread FROM chosen),
verdicts AS (SELECT r, bool_and(x.x <= q3 + spread AND (x.m > 0 OR x.x >= q1 - spread)) AS inside FROM measured x JOIN fenced f ON x.m = f.m AND x.lang IS NOT DISTINCT FROM f.lang AND x.source IS NOT DISTINCT FROM f.source GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(inside, true) AS kept FROM judged LEFT JOIN verdicts USING (r)
"""

OP7 = f"""
WITH texts AS (SELECT text, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY text),
lines AS (SELECT text, first_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM texts),
tokens AS (SELECT text, first_id, k, list_transform(regexp_extract_all(line, '{WORD}'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN NULL ELSE x END) AS w FROM lines),
leaves AS (SELECT *, len(w) AS n, w[1:3] AS head FROM tokens WHERE len(w) >= 3),
often AS (SELECT n, head FROM leaves GROUP BY n, head HAVING count(DISTINCT text) >= 10),
held AS (SELECT l.* FROM leaves l SEMI JOIN often o ON l.n = o.n AND l.head = o.head),
each AS (SELECT text, first_id, k, n, head, unnest(w) AS token, generate_subscripts(w, 1) AS p FROM held),
columns_ AS (SELECT n, head, p, token FROM each WHERE token IS NOT NULL GROUP BY ALL HAVING count(DISTINCT text) >= 10),
marked AS (SELECT e.text, e.first_id, e.k, e.n, e.head, e.p, c.token AS fixed FROM each e LEFT JOIN columns_ c ON e.n = c.n AND e.head = c.head AND e.p = c.p AND e.token = c.token),
templates AS (SELECT text, first_id, k, n, head, list(fixed ORDER BY p) AS t FROM marked GROUP BY text, first_id, k, n, head HAVING 100 * count(fixed) >= 60 * n),
recurring AS (SELECT n, head, t, min(first_id) AS first_id FROM templates GROUP BY n, head, t HAVING count(DISTINCT text) >= 10),
gone AS (SELECT x.text, list(x.k) AS ks FROM templates x JOIN recurring r ON x.n = r.n AND x.head = r.head AND x.t = r.t AND x.first_id <> r.first_id GROUP BY x.text),
split AS (SELECT d.doc_id, coalesce(d.text, '') AS text, string_split(coalesce(d.text, ''), chr(10)) AS parts, coalesce(g.ks, []) AS ks FROM documents d LEFT JOIN gone g ON d.text = g.text)
SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_lines, CAST(len(ks) AS BIGINT) AS n_dropped,
  sha256(array_to_string(list_transform(list_filter(range(1, len(parts) + 1), lambda i: NOT list_contains(ks, i)), lambda i: parts[i]), chr(10))) AS kept_sha256 FROM split
"""


def op13(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The rounds one after another, each with all distances."""
    steps = [f"""
kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, vec_id, part, len(v) // {parts} AS w, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS x FROM kept CROSS JOIN (SELECT unnest(range({parts})) AS part)),
first AS (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS entry FROM kept QUALIFY entry < {entries}),
book0 AS MATERIALIZED (SELECT part, entry, x AS c FROM parts JOIN first USING (r))"""]
    for t in range(rounds + 1):
        steps.append(f"""
near{t} AS MATERIALIZED (SELECT r, part, any_value(x) AS x, min({entries} * CAST(list_sum(list_transform(range(1, w + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT) + entry) AS best FROM parts JOIN book{t} USING (part) GROUP BY r, part)""")
        if t < rounds:
            steps.append(f"""
sums{t} AS (SELECT part, entry, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, best % {entries} AS entry, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM near{t}) GROUP BY ALL),
means{t} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM sums{t} GROUP BY part, entry),
book{t + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{t} b LEFT JOIN means{t} m ON b.part = m.part AND b.entry = m.entry)""")
    return f"""WITH {",".join(steps)},
coded AS (SELECT r, string_agg(format('{{:02x}}', best % {entries}), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM near{rounds} GROUP BY r),
digest AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(c) AS y, generate_subscripts(c, 1) AS i FROM book{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r) CROSS JOIN digest
"""


OP13 = op13()
