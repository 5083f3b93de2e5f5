"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import licenses

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8 = r"""
WITH w AS (
  SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, i, hash(list_slice(ws, i, i + 7)) AS h
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, h) AS c FROM g) WHERE c > 1),
cover AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM twice) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN cover USING (doc_id)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT)::DOUBLE AS failed FROM j GROUP BY source),
t AS (SELECT sum(n)::DOUBLE AS n, sum(failed) / sum(n) AS m, count(*)::DOUBLE AS h, sum(failed * failed / n) / sum(n) AS q FROM hosts),
b AS (SELECT n, h, m, greatest(q - m * m - m * (1 - m) * h / n, 0) AS v FROM t),
k AS (SELECT m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE n / h END, 2), greatest(n / h, 2)) AS w FROM b),
bad AS (
  SELECT source, (failed + greatest(m * w, 0.01)) / (n + greatest(m * w, 0.01) + greatest((1 - m) * w, 0.01)) > 0.9 AS rejected
  FROM hosts, k)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM j JOIN bad ON j.source IS NOT DISTINCT FROM bad.source
"""

OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(len(w), 13) AS n FROM b WHERE len(w) > 0),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
met AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN iw USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM met) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""



OP2 = r"""
WITH r AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM r),
s AS (SELECT *, length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<:]', 'xx', 'g')) + 15 AS n FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns, sum(n) AS formatted_chars,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss
  FROM s GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM g
"""

OP3 = rf"""
WITH u AS (
  SELECT page_id, {LOWER.format("regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(i, verdict, h, p) AS (VALUES (1, 'block', 'com', '/en/'), (2, 'allow', 'example.com', '/en/7'), (3, 'allow', 'net', '/de/'), (4, 'block', 'example.net', '/de/8'), (5, 'block', 'org', '/es/')),
m AS (
  SELECT page_id, arg_min(h || p, (-length(h || p), i)) AS rule, arg_min(verdict, (-length(h || p), i)) AS verdict
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""

OP5 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS i FROM w WHERE len(ws) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common m JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * m.n >= 80 * (x.n + y.n - m.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, w.doc_id <= coalesce(m, w.doc_id) AS kept
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN least_of ON a = w.doc_id
"""

_NOTICES = [(i, q, word, len(text.split()), label) for i, (text, label) in enumerate(licenses.NOTICES) for q, word in enumerate(text.split())]

OP7 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') AS w FROM documents),
spread AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
runs_of AS (
  SELECT doc_id, p, word || ' ' || lead(word) OVER x AS two, word || ' ' || lead(word) OVER x || ' ' || lead(word, 2) OVER x AS three,
         word || ' ' || lead(word) OVER x || ' ' || lead(word, 2) OVER x || ' ' || lead(word, 3) OVER x AS four
  FROM spread WINDOW x AS (PARTITION BY doc_id ORDER BY p)),
phrases(phrase, label) AS (VALUES {", ".join(f"('{text}', '{label}')" for text, label in licenses.PHRASES)}),
base AS (SELECT doc_id, p, label FROM (SELECT doc_id, p, unnest([two, three, four]) AS said FROM runs_of) JOIN phrases ON said = phrase),
words(t, q, word, size, label) AS (VALUES {", ".join(str(x) for x in _NOTICES)}),
three AS (
  SELECT a.t, a.q, a.size, a.label, a.word || ' ' || b.word || ' ' || c.word AS g
  FROM words a JOIN words b ON b.t = a.t AND b.q = a.q + 1 JOIN words c ON c.t = a.t AND c.q = a.q + 2),
met AS (SELECT doc_id, t, size, label, q, p - q AS diagonal FROM runs_of JOIN three ON runs_of.three = g),
bands AS (SELECT doc_id, t, size, label, q, unnest([floor(diagonal / size), floor(diagonal / size) - 1]) AS band FROM met),
covered AS (
  SELECT doc_id, t, size, label, band, count(DISTINCT place) / size AS share
  FROM (SELECT *, unnest([q, q + 1, q + 2]) AS place FROM bands) GROUP BY doc_id, t, size, label, band),
found AS (SELECT doc_id, label, 1.0::DOUBLE AS share, p FROM base UNION ALL SELECT doc_id, label, share, NULL FROM covered WHERE share >= {licenses.AGREE}),
g AS (
  SELECT doc_id, count(p) AS n_base, min(p) AS first_word, max(p) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (p IS NOT NULL) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(round(share, 4)) AS score
  FROM found GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN g USING (doc_id)
"""

def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds of assigning and averaging, one after the other, over rows of (vector, part, component)."""
    steps = [f"""
v0 AS (SELECT vec_id, label, row_number() OVER () AS r, embedding FROM embeddings
       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, list_transform(embedding, lambda x: floor(4096::DOUBLE * x))) AS n FROM v0),
x AS MATERIALIZED (
  SELECT r, n, (i - 1) // w AS p, (i - 1) % w AS j, floor(4096::DOUBLE * embedding[i])::BIGINT AS x
  FROM (SELECT r, n, embedding, len(embedding) // {parts} AS w, unnest(generate_series(1, len(embedding))) AS i FROM v)),
b0 AS MATERIALIZED (SELECT p, n - 1 AS e, j, x AS c FROM x WHERE n <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT r, p, min((d, e)) AS best
  FROM (SELECT r, p, e, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN b{k} USING (p, j) GROUP BY r, p, e) GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""
m{k} AS (SELECT p, best[2] AS e, j, floor(sum(x)::DOUBLE / count(*))::BIGINT AS c FROM x JOIN a{k} USING (r, p) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT p, e, j, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (p, e, j))""")
    return "WITH" + ",".join(steps) + f""",
codes AS (SELECT r, string_agg(lpad(lower(hex(best[2])), 2, '0'), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM a{rounds} GROUP BY r),
s AS (SELECT label, sum(error)::BIGINT AS label_error FROM v JOIN codes USING (r) GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(c, ',' ORDER BY p, e, j)) FROM b{rounds}) AS codebooks_sha256
FROM v JOIN codes USING (r) JOIN s ON v.label IS NOT DISTINCT FROM s.label
"""


OP12 = _vector_codes()


def oracle_sql() -> dict[str, str]:
    """By query name. Token ids (op4, op9), bytes of UTF-8 texts (op6) and crc32 (op10) are beyond SQL, and so are the draws of op11; tests hold those against brute force."""
    return {
        "op1_decontamination": OP1, "op2_chat_formatting": OP2, "op3_url_filters": OP3, "op5_minhash_near_dedup": OP5,
        "op7_license_scan": OP7, "op8_quality_rules": OP8, "op12_vector_codes": OP12,
    }
