"""DuckDB SQL for the queries of this package that SQL can express, over the same whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Characters of a word: letters, digits and all that isn't ASCII.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_WORDS = f"""texts AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER} AS text FROM documents),
split AS (SELECT r, regexp_extract_all(text, '{_WORD}') AS w FROM texts),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split)"""

_LM = f"""WITH {_WORDS},
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
docs AS (SELECT r, doc_id, doc_id IS NOT NULL AND doc_id IN (SELECT doc_id FROM good WHERE doc_id IS NOT NULL) AS t FROM texts),
tokens AS (SELECT r, t, word, coalesce(lag(word) OVER (PARTITION BY r ORDER BY i), '') AS prev FROM words JOIN docs USING (r)),
pairs AS (SELECT prev, word, count(*) AS n, count(*) FILTER (t) AS nt FROM tokens GROUP BY ALL),
heads AS (SELECT word, count(*) AS n, count(*) FILTER (t) AS nt FROM tokens GROUP BY ALL),
befores AS (SELECT prev, count(*) AS n, count(*) FILTER (t) AS nt FROM tokens GROUP BY ALL),
totals AS (SELECT count(*) AS n, count(*) FILTER (t) AS nt, greatest(65534, count(DISTINCT word)) + 2 AS places FROM tokens),
own AS (SELECT *, count(*) OVER (PARTITION BY r, prev, word) AS op, count(*) OVER (PARTITION BY r, word) AS ow,
  count(*) OVER (PARTITION BY r, prev) AS ob, count(*) OVER (PARTITION BY r) AS size, CAST(t AS INT) AS f FROM tokens),
shares AS (SELECT o.*, p.n AS pn, p.nt AS pt, b.n AS bn, b.nt AS bt, greatest(z.nt / z.n, 1e-6) AS part,
  (h.n - ow + 1) / (z.n - size + places) AS share,
  (h.nt - f * ow + greatest(z.nt / z.n, 1e-6)) / (z.nt - f * size + greatest(z.nt / z.n, 1e-6) * places) AS share_t
  FROM own o JOIN pairs p USING (prev, word) JOIN heads h USING (word) JOIN befores b USING (prev), totals z),
losses AS (SELECT r, -ln((pn - op + 50 * share) / (bn - ob + 50)) AS back,
  -ln((pt - f * op + part * 50 * share_t) / (bt - f * ob + part * 50)) AS target FROM shares),
scores AS (SELECT r, count(*) AS n, avg(target) AS target, avg(back) AS back, avg(target - back) AS score FROM losses GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_tokens, round(coalesce(target, 0), 6) AS target_loss, round(coalesce(back, 0), 6) AS background_loss,
  round(coalesce(score, 0), 6) AS score, t AS is_target
FROM docs LEFT JOIN scores USING (r)"""

_LEAKS = f"""WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER} AS text FROM documents),
split AS (SELECT r, regexp_extract_all(text, '{_WORD}|{_GAP}') AS w FROM texts),
tokens AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
placed AS (SELECT r, i, word, sum(length(word)) OVER (PARTITION BY r ORDER BY i) AS z FROM tokens),
words AS (SELECT r, word, row_number() OVER (PARTITION BY r ORDER BY i) AS i, z - length(word) AS a, z FROM placed WHERE regexp_full_match(word, '{_WORD}')),
counts AS (SELECT r, count(*) AS n_words FROM words GROUP BY r),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(8, len(w)) AS n, array_to_string(w[a : a + least(8, len(w)) - 1], ' ') AS line
  FROM (SELECT item, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS a FROM items WHERE len(w) > 0)),
grown AS (SELECT r, i, n, array_to_string(g[: n], ' ') AS line FROM
  (SELECT r, i, array_agg(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g FROM words)
  JOIN (SELECT DISTINCT n FROM windows) ON len(g) >= n),
found AS (SELECT r, i, n, item FROM grown JOIN windows USING (n, line)),
hit AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS i FROM found),
runs AS (SELECT r, min(a) AS a, max(z) AS z, count(*) AS n FROM
  (SELECT r, i, a, z, i - row_number() OVER (PARTITION BY r ORDER BY i) AS run FROM hit JOIN words USING (r, i)) GROUP BY r, run),
spans AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_hit, string_agg(CAST(a AS BIGINT) || ':' || CAST(z AS BIGINT), ',' ORDER BY a) AS spans FROM runs GROUP BY r),
leaks AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated, coalesce(spans, '') AS spans
FROM texts LEFT JOIN counts USING (r) LEFT JOIN spans USING (r) LEFT JOIN leaks USING (r)"""

#: A text is escaped where it has a mark, or looks escaped already.
_CHAT = r"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, n, role, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS probe(n, role)),
sized AS (SELECT *, length(role) + len(regexp_extract_all(role, '[\\\n<]')) + length(text)
  + CASE WHEN regexp_matches(text, '<\|im_start\|>|<\|im_end\|>\n|<\\+\|') THEN len(regexp_extract_all(text, '<\\*\|')) ELSE 0 END
  + length('<|im_start|>' || chr(10) || '<|im_end|>' || chr(10)) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

_NEAR = rf"""WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts),
grown AS (SELECT doc_id, n, i, array_agg(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS g FROM words),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(g, ' ') AS line FROM grown WHERE len(g) = least(n, 4) AND (n >= 4 OR i = 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b USING (line) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM common c JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c.n >= 80 * (a.n + b.n - c.n)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sizes UNION SELECT reach.x, b.y FROM reach JOIN both_ways b ON b.x = reach.y),
named AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM texts LEFT JOIN sizes USING (doc_id) LEFT JOIN named USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {
    "op1_lm_scoring": _LM,
    "op4_decontamination": _LEAKS,
    "op5_chat_format": _CHAT,
    "op10_near_dedup": _NEAR,
}
