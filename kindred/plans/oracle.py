"""What DuckDB says to the same questions.

Of a name of two words without stopwords the whole generator comes down to closed forms: shares
a / (a + b); the sorted pair with weight 1, the word with the larger share, and the other if its
share is over 0.8 of that; the first must be found if the other's share is under 0.85 of its own.
"""

from __future__ import annotations

_NORMAL = r"regexp_replace(regexp_replace(replace(replace(replace(replace(lower(translate(coalesce(text, ''), '#@();./+-_!,?:''', '          ')), 'ß', 'ss'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), '([A-Za-z]{2,}|\s|^)(\d{2,})', '\1 \2 ', 'g'), '^\s+|\s+$', '', 'g')"

_WORDS = f"""doc_words AS (SELECT doc_id, unnest(string_split({_NORMAL}, ' ')) AS word FROM documents),
used AS (SELECT doc_id, word FROM doc_words WHERE word <> ''),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM used GROUP BY word),
total AS (SELECT count(*) AS n FROM documents),
terms AS (SELECT word, CAST(round(1000 * log2(n / df)) AS BIGINT) AS rel FROM df, total),
stops AS (SELECT word FROM df ORDER BY df DESC, word LIMIT 20),
item_lists AS (SELECT item_id, list_filter(string_split({_NORMAL}, ' '), lambda w: w <> '') AS ws FROM benchmark),
items AS (SELECT item_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM item_lists),
rels AS (SELECT i.item_id, i.pos, i.word, coalesce(t.rel, 6666) AS rel FROM items i LEFT JOIN terms t USING (word))"""

_LINE = """lines AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 1 THEN 'qe:' || p_name WHEN 2 THEN p_partkey || ':url:' || p_name WHEN 3 THEN '"q:' || p_name || '"' || chr(9) || 'rest'
WHEN 4 THEN 'a:b:c:' || p_name WHEN 5 THEN '"' || p_name ELSE p_name END AS line FROM part),
fields AS (SELECT p_partkey, string_split(trim(split_part(line, chr(9), 1), '"'), ':') AS f FROM lines),
parsed AS (SELECT p_partkey, CASE len(f) WHEN 1 THEN 'qe' WHEN 2 THEN f[1] WHEN 3 THEN f[2] END AS type, CASE WHEN len(f) <= 3 THEN f[len(f)] END AS query, len(f) > 3 AS parse_error FROM fields)"""

_NAMES = """names AS (SELECT min(p_partkey) AS query_id, p_name AS query FROM part GROUP BY p_name HAVING split_part(p_name, ' ', 1) <> split_part(p_name, ' ', 2)),
vocab AS (SELECT word, row_number() OVER (ORDER BY word) AS k, 1000 + 397 * (row_number() OVER (ORDER BY word) - 1) AS rel FROM (SELECT DISTINCT unnest(string_split(query, ' ')) AS word FROM names)),
mixed AS (SELECT query_id AS qid, split_part(query, ' ', 2) || ' ' || split_part(lead(query) OVER (ORDER BY query_id), ' ', 1) AS query FROM names),
asked AS (SELECT qid, query FROM mixed WHERE query IS NOT NULL AND split_part(query, ' ', 1) <> split_part(query, ' ', 2))"""


def _sides(name: str, source: str, key: str) -> str:
    """Top and other word of two, with their shares."""
    return f"""{name}0 AS (SELECT t.{key} AS id, split_part(t.query, ' ', 1) AS a, split_part(t.query, ' ', 2) AS b, u.rel AS ra, v.rel AS rb FROM {source} t JOIN vocab u ON u.word = split_part(t.query, ' ', 1) JOIN vocab v ON v.word = split_part(t.query, ' ', 2)),
{name} AS (SELECT id, a, b, CASE WHEN ra >= rb THEN a ELSE b END AS w0, CASE WHEN ra >= rb THEN b ELSE a END AS w1, greatest(ra, rb) / (ra + rb) AS s0, least(ra, rb) / (ra + rb) AS s1 FROM {name}0),
{name}_grams AS (SELECT id, least(a, b) || ' ' || greatest(a, b) AS ngram, 1.0::DOUBLE AS rel, 0 AS pos, [w0, w1] AS ws FROM {name} UNION ALL SELECT id, w0, s0, 1, [w0] FROM {name} UNION ALL SELECT id, w1, s1, 2, [w1] FROM {name} WHERE s1 > 0.8 * s0)"""


def _search(tfidf: bool) -> str:
    weight = "CASE WHEN g.rel > 0 THEN least(p.score / 100.0::DOUBLE, g.rel) / g.rel ELSE 0 END" if tfidf else "1.0::DOUBLE"
    return f"""{_NAMES}, {_sides("stored", "names", "query_id")}, {_sides("mine", "asked", "qid")},
postings AS (SELECT id AS query_id, ngram, least(round(100 * rel), 255) AS score FROM stored_grams),
hits AS (SELECT g.id AS qid, p.query_id, unnest(g.ws) AS word, {weight} AS w, g.pos FROM mine_grams g JOIN postings p USING (ngram)),
covered AS (SELECT qid, query_id, word, arg_min(w, pos) AS w FROM hits WHERE w > 0 GROUP BY ALL),
sums AS (SELECT c.qid, c.query_id, greatest(0, 1 - sum(c.w * CASE WHEN c.word = m.w0 THEN m.s0 ELSE m.s1 END)) AS keyword, bool_or(c.word = m.w0) OR any_value(m.s1 >= 0.85 * m.s0) AS complete FROM covered c JOIN mine m ON m.id = c.qid GROUP BY c.qid, c.query_id),
found AS (SELECT qid, query_id, keyword, row_number() OVER (PARTITION BY qid ORDER BY keyword, query_id) AS rank FROM sums WHERE complete AND keyword < 0.951)"""


_PAIRS = f"""{_NAMES}, pairs AS (SELECT a.qid, n.query_id AS cand_id, string_split(a.query, ' ') AS q, string_split(n.query, ' ') AS c FROM asked a, names n)"""


def _set(expression: str) -> str:
    return f"array_to_string(list_sort({expression}), ' ')"


_VECTORS = "word_vecs AS (SELECT v.word, e.embedding AS vec FROM vocab v JOIN embeddings e ON e.vec_id = v.k WHERE v.k % 7 <> 0)"

_COMBINED = f"""{_NAMES}, {_VECTORS},
own AS (SELECT n.query_id, v.word, v.rel, w.vec FROM (SELECT query_id, unnest(string_split(query, ' ')) AS word FROM names) n JOIN vocab v USING (word) LEFT JOIN word_vecs w USING (word)),
flat AS (SELECT query_id, word, unnest(range(len(vec))) AS place, unnest(vec)::DOUBLE * rel AS x FROM own WHERE vec IS NOT NULL),
combined AS (SELECT query_id, place, sum(x) AS x FROM flat GROUP BY ALL)"""

_OVERLAP = """shares AS (SELECT p.qid, p.cand_id, p.q, p.c, a.rel / (a.rel + b.rel) AS qa, b.rel / (a.rel + b.rel) AS qb, x.rel / (x.rel + y.rel) AS ca, y.rel / (x.rel + y.rel) AS cb
FROM pairs p JOIN vocab a ON a.word = q[1] JOIN vocab b ON b.word = q[2] JOIN vocab x ON x.word = c[1] JOIN vocab y ON y.word = c[2]),
near AS (SELECT qid, cand_id, q, c, greatest(0, 1 - (CASE WHEN c[1] = q[1] THEN least(ca, qa) WHEN c[1] = q[2] THEN least(ca, qb) ELSE 0 END + CASE WHEN c[2] = q[1] THEN least(cb, qa) WHEN c[2] = q[2] THEN least(cb, qb) ELSE 0 END)) AS keyword FROM shares)"""

_VEC = "coalesce((SELECT list(s ORDER BY place) FROM (SELECT place, sum(x) AS s FROM (SELECT unnest(range(64)) AS place, unnest(w.vec)::DOUBLE * v.rel AS x FROM word_vecs w JOIN vocab v USING (word) WHERE list_contains({0}, w.word)) GROUP BY place)), list_transform(range(64), lambda i: 0.0::DOUBLE))"


def _cos(a: str, b: str) -> str:
    size = f"sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))"
    return f"CASE WHEN {size} > 0 THEN 1 - greatest(0, least(1, list_dot_product({a}, {b}) / ({size}))) END"


def _rerank(near: str, last: str = "") -> str:
    """Cosine distances of what ``near`` has: qid, cand_id, q, c, keyword."""
    return f"""{near}, {_VECTORS},
sets AS (SELECT qid, cand_id, keyword AS k, q, c, list_filter(q, lambda w: list_contains(c, w)) AS m, list_filter(q, lambda w: NOT list_contains(c, w)) AS s, list_filter(c, lambda w: NOT list_contains(q, w)) AS x FROM near),
known AS (SELECT list(word) AS ws FROM word_vecs),
lone AS (SELECT DISTINCT l FROM (SELECT unnest([q, c, m, s, x]) AS l FROM sets)),
vecs AS (SELECT l, len(list_filter(l, lambda w: NOT list_contains(ws, w))) AS u, {_VEC.format("l")} AS v FROM lone, known),
facts AS (SELECT z.qid, z.cand_id, z.k, len(z.m) AS m, len(z.s) AS s, len(z.x) AS x, vm.u AS um, vs.u AS us, vx.u AS ux, vq.u AS uq, vc.u AS uc, {_cos("vq.v", "vc.v")} AS c0, {_cos("vx.v", "vs.v")} AS apart,
list_transform(range(64), lambda i: vm.v[i + 1] - vs.v[i + 1]) AS l, list_transform(range(64), lambda i: vm.v[i + 1] - vx.v[i + 1]) AS r
FROM sets z JOIN vecs vq ON vq.l = z.q JOIN vecs vc ON vc.l = z.c JOIN vecs vm ON vm.l = z.m JOIN vecs vs ON vs.l = z.s JOIN vecs vx ON vx.l = z.x),
terms2 AS (SELECT *, CASE WHEN uq < 2 AND uc < 2 THEN c0 END AS c, {_cos("l", "r")} AS turned FROM facts),
bounds AS (SELECT *, turned AS t, greatest(0, apart - CASE WHEN s > 1 THEN CASE WHEN x < 2 THEN 0.5 ELSE 0.45 END ELSE CASE WHEN x < 2 THEN 0.55 ELSE 0.65 END END) AS extra FROM terms2)
SELECT qid, cand_id, round(k, 6) AS keyword, round(CASE WHEN s = 0 AND x = 0 THEN 0.0
WHEN um = m AND (us = s OR ux = x) THEN NULL
WHEN um = m THEN CASE WHEN s > m OR x > m THEN least(apart * (1 + k), 1) ELSE apart END
WHEN us = s AND ux = x THEN NULL
WHEN us = s THEN CASE WHEN c IS NULL THEN NULL WHEN m >= 2 AND s = 0 AND x < 2 AND k < 0.3 THEN c * k WHEN m >= 2 AND m > s AND m > x AND k < 0.45 AND ux + um + us <= 1 THEN c * k / (k + c) ELSE least(c + (ux + um + us) * k / (s + x), 1) END
WHEN ux = x THEN CASE WHEN c IS NULL THEN NULL WHEN m >= 2 AND s < 2 AND x = 0 AND k < 0.3 THEN c * k WHEN m >= 2 AND m > s AND m > x AND k < 0.45 AND ux + um + us <= 1 THEN c * k / (k + c) ELSE least(c + (ux + um + us) * k / (s + x), 1) END
WHEN x >= 1 AND s >= 1 AND m <= 2 AND k > 0.45 THEN 1.3 * t + extra WHEN x <= 2 AND s <= 2 AND m > x AND k <= 0.45 THEN 0.75 * t + extra ELSE t + extra END, 6) AS cosine{last} FROM bounds"""

_FOUND_PAIRS = f"""{_search(False)}, near AS (SELECT f.qid, f.query_id AS cand_id, string_split(a.query, ' ') AS q, string_split(n.query, ' ') AS c, f.keyword FROM found f JOIN asked a USING (qid) JOIN names n USING (query_id))"""

#: Names with a third word; of three words without stopwords all pairs are n-grams, those of neighbours
#: with their whole share, and the first of them, and the second from 0.8 of it on.
_THREE = f"""{_NAMES}, three AS (SELECT query_id, split_part(query, ' ', 1) AS a, split_part(query, ' ', 2) AS b, v.word AS c FROM names JOIN vocab v ON v.k = query_id % 16 + 1
WHERE v.word NOT IN (split_part(query, ' ', 1), split_part(query, ' ', 2)) AND greatest(length(split_part(query, ' ', 1)), length(split_part(query, ' ', 2)), length(v.word)) > 4)"""

_THREE_SHARES = f"""{_THREE}, placed AS (SELECT query_id, unnest([a, b, c]) AS word, unnest([0, 1, 2]) AS place FROM three),
shares AS (SELECT query_id, p.word, place, rel / sum(rel) OVER (PARTITION BY query_id)::DOUBLE AS share, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, place) AS nth FROM placed p JOIN vocab USING (word)),
ranked AS (SELECT query_id, max(word) FILTER (WHERE nth = 1) AS w0, max(word) FILTER (WHERE nth = 2) AS w1, max(share) FILTER (WHERE nth = 1) AS s0, max(share) FILTER (WHERE nth = 2) AS s1, min(share) AS s2 FROM shares GROUP BY query_id)"""

_THREE_NGRAMS = f"""WITH {_THREE_SHARES}
SELECT x.query_id, least(x.word, y.word) || ' ' || greatest(x.word, y.word) AS ngram, round((1 - (y.place - x.place - 1) / 100::DOUBLE) * (x.share + y.share), 6) AS rel, x.place + y.place - 1 AS pos FROM shares x JOIN shares y ON x.query_id = y.query_id AND x.place < y.place
UNION ALL SELECT query_id, w0, round(s0, 6), 3 FROM ranked UNION ALL SELECT query_id, w1, round(s1, 6), 4 FROM ranked WHERE s1 > 0.8 * s0"""

#: The stopword counts half and stands with the word after it, at the end with the one before; between
#: two words with the latter, unless the former is four times as long.
_STOP_UNITS = f"""WITH {_THREE}, stopped AS (SELECT t.*, query_id % 3 AS spot FROM three t WHERE c IN (SELECT word FROM vocab WHERE k % 5 = 0) AND a NOT IN (SELECT word FROM vocab WHERE k % 5 = 0) AND b NOT IN (SELECT word FROM vocab WHERE k % 5 = 0)),
sums AS (SELECT s.*, u.rel::DOUBLE AS ra, v.rel::DOUBLE AS rb, w.rel / 2.0::DOUBLE AS rc, spot = 0 OR spot = 1 AND length(a) >= 4 * length(b) AS with_a FROM stopped s JOIN vocab u ON u.word = a JOIN vocab v ON v.word = b JOIN vocab w ON w.word = c),
units AS (SELECT *, ra + rb + rc AS total, CASE WHEN with_a THEN a ELSE b END AS mate, CASE WHEN with_a THEN b ELSE a END AS other, CASE WHEN with_a THEN ra ELSE rb END + rc AS own FROM sums),
texts AS (SELECT *, least(c, mate) || ' ' || greatest(c, mate) AS unit FROM units),
ranks AS (SELECT query_id, word, r / total AS share, row_number() OVER (PARTITION BY query_id ORDER BY r DESC) AS nth FROM (SELECT query_id, total, unnest([a, b, c]) AS word, unnest([ra, rb, rc]) AS r FROM texts)),
best AS (SELECT x.query_id, x.word AS w0, x.share AS s0, y.word AS w1, y.share AS s1 FROM ranks x JOIN ranks y ON x.query_id = y.query_id AND x.nth = 1 AND y.nth = 2)
SELECT query_id, ngram, round(rel, 6) AS rel FROM (SELECT query_id, unit AS ngram, own / total AS rel, 0 AS k FROM texts WHERE own / total > 0.6
UNION ALL SELECT query_id, least(unit, other) || ' ' || greatest(unit, other), 1.0, 1 FROM texts
UNION ALL SELECT query_id, w0, s0, 2 FROM best UNION ALL SELECT query_id, w1, s1, 3 FROM best WHERE s1 > 0.8 * s0
UNION ALL SELECT query_id, least(w0, w1) || ' ' || greatest(w0, w1), s0 + s1, 4 FROM best) QUALIFY row_number() OVER (PARTITION BY query_id, ngram ORDER BY k) = 1"""

_NAME_POSTINGS = f"{_NAMES}, {_sides('stored', 'names', 'query_id')}, own_postings AS (SELECT ngram, id AS query_id, CAST(least(round(100 * rel), 255) AS BIGINT) AS score FROM stored_grams)"

_DOC_POSTINGS = f"""{_WORDS}, counted AS (SELECT word AS ngram, doc_id AS query_id, least(count(*), 255) AS score FROM used GROUP BY ALL),
capped AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY ngram ORDER BY score DESC, query_id DESC) <= 50)"""

ORACLE_SQL: dict[str, str] = {
    "normalize_text": f"SELECT doc_id, {_NORMAL} AS normal FROM documents",
    "tokenize_filter": f"""WITH t AS (SELECT conv_id, turn, string_split({_NORMAL}, ' ') AS p FROM conversations),
w AS (SELECT conv_id, turn, list_slice(list_filter(p, lambda w, i: strlen(w) > 1 OR regexp_full_match(w, '[0-9]') OR (i = 1 AND strlen(w) = 1)), 1, 15) AS ws FROM t)
SELECT conv_id, turn, array_to_string(ws, ' ') AS words, len(ws) AS n_words FROM w""",
    "parse_line": f"WITH {_LINE} SELECT *, CASE WHEN type IN ('q', 'qe') THEN 'Q' ELSE 'TUW' END AS kind FROM parsed",
    "query_type_prefix_filter": f"WITH {_LINE} SELECT p_partkey, type, query FROM parsed WHERE type IN ('q', 'qe')",
    "global_ordinal": "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS query_id, o_orderkey FROM orders",
    "term_df_idf": f"WITH {_WORDS} SELECT word, df, round(log2(n / df), 6) AS idf FROM df, total",
    "term_relevance": f"WITH {_WORDS} SELECT word, rel FROM terms",
    "stop_flag": f"WITH {_WORDS} SELECT DISTINCT word, word IN (SELECT word FROM stops) AS stop FROM items",
    "stopword_semi": f"WITH {_WORDS} SELECT DISTINCT item_id, word FROM items WHERE EXISTS (SELECT 1 FROM stops s WHERE s.word = items.word)",
    "stopword_anti": f"WITH {_WORDS} SELECT DISTINCT item_id, word FROM items WHERE NOT EXISTS (SELECT 1 FROM stops s WHERE s.word = items.word)",
    "relevance_lookup_default": f"WITH {_WORDS} SELECT DISTINCT word, rel FROM rels",
    "word_weights": f"""WITH {_WORDS}, f AS (SELECT item_id, rel, word IN (SELECT word FROM stops) OR strlen(word) = 1 AS stop, row_number() OVER (PARTITION BY item_id, word ORDER BY pos) = 1 AS first FROM rels)
SELECT item_id, sum(CASE WHEN stop THEN rel * 0.5::DOUBLE WHEN first THEN rel * 1.0::DOUBLE ELSE 0 END) AS norm, count(*) AS n_words FROM f GROUP BY item_id""",
    "argmin_argmax_word": f"""WITH {_WORDS} SELECT item_id, first(word ORDER BY rel DESC, pos) AS most, first(word ORDER BY rel, pos) AS least,
first(word ORDER BY rel DESC, pos) FILTER (WHERE regexp_matches(word, '\\p{{N}}')) AS number FROM rels GROUP BY item_id""",
    "bow2_pairs": f"""WITH {_WORDS}, p AS (SELECT least(a.word, b.word) || ' ' || greatest(a.word, b.word) AS pair, 1 - (b.pos - a.pos - 1) / 100 AS part FROM items a JOIN items b ON a.item_id = b.item_id AND b.pos - a.pos BETWEEN 1 AND 3)
SELECT pair, count(*) AS n, round(sum(part), 6) AS weight FROM p GROUP BY pair""",
    "bow3_top": f"""WITH {_WORDS}, t AS (SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY rel DESC, pos) AS k FROM rels),
w AS (SELECT item_id, max(word) FILTER (WHERE k = 1) AS a, max(word) FILTER (WHERE k = 2) AS b, max(word) FILTER (WHERE k = 3) AS c FROM t GROUP BY item_id)
SELECT item_id, CASE WHEN a = b AND b < c THEN c || ' ' || a || ' ' || b ELSE array_to_string(list_sort([a, b, c]), ' ') END AS ngram FROM w WHERE c IS NOT NULL""",
    "ngram_rel_quantized": "SELECT p_partkey, CAST(least(greatest(round(p_retailprice / 700 * 100), 0), 255) AS BIGINT) AS score FROM part",
    "inverted_index_capped": f"WITH {_DOC_POSTINGS} SELECT ngram, query_id, score FROM capped",
    "posting_lengths": f"WITH {_DOC_POSTINGS} SELECT ngram, count(*) AS len FROM capped GROUP BY ngram",
    "dictionary_union": f"WITH {_DOC_POSTINGS} SELECT ngram, 0 AS shard, count(*) AS len FROM counted GROUP BY ngram UNION ALL SELECT word, 1, count(DISTINCT item_id) FROM items GROUP BY word",
    "elegant_pair_roundtrip": """WITH z AS (SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_orderkey >= l_linenumber THEN CAST(l_orderkey AS BIGINT) * l_orderkey + l_orderkey + l_linenumber ELSE CAST(l_linenumber AS BIGINT) * l_linenumber + l_orderkey END AS z FROM lineitem),
r AS (SELECT *, CAST(floor(sqrt(z)) AS BIGINT) AS f FROM z) SELECT l_orderkey, l_linenumber, z, CASE WHEN z - f * f >= f THEN f ELSE z - f * f END AS x, CASE WHEN z - f * f >= f THEN z - f * f - f ELSE f END AS y FROM r""",
    "id_split_roundtrip": "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(o_orderkey // 64 AS BIGINT) AS local, CAST(o_orderkey % 64 AS BIGINT) AS rest, CAST(o_orderkey // 64 * 64 + o_orderkey % 64 AS BIGINT) AS back FROM orders",
    "jump_hash_buckets": """WITH RECURSIVE s AS (SELECT p_partkey, CAST(p_partkey AS HUGEINT) AS k, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j FROM part
UNION ALL SELECT p_partkey, n, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST(n // 8589934592 + 1 AS DOUBLE))) AS BIGINT) FROM (SELECT p_partkey, (k * 2862933555777941757 + 1) % 18446744073709551616::HUGEINT AS n, j FROM s WHERE j < 32))
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, b AS bucket FROM s WHERE j >= 32""",
    "name_ngrams": f"WITH {_NAMES}, {_sides('stored', 'names', 'query_id')} SELECT ngram, id AS query_id, CAST(least(round(100 * rel), 255) AS BIGINT) AS score FROM stored_grams",
    "keyword_search": f"WITH {_search(False)} SELECT qid, query_id, round(keyword, 6) AS keyword FROM found",
    "keyword_search_tfidf": f"WITH {_search(True)} SELECT qid, query_id, round(keyword, 6) AS keyword FROM found",
    "must_have_filter": f"WITH {_NAMES}, {_sides('mine', 'asked', 'qid')} SELECT id AS qid, CASE WHEN s1 < 0.85 * s0 THEN w0 ELSE '' END AS must FROM mine",
    "search_with_text": f"WITH {_search(False)} SELECT qid, query_id, round(keyword, 6) AS keyword, query, rank FROM found JOIN names USING (query_id) WHERE rank <= 100",
    "search_topk": f"WITH {_search(True)} SELECT qid, query_id, round(keyword, 6) AS keyword, rank FROM found WHERE rank <= 3",
    "search_overfetch": f"WITH {_search(False)} SELECT qid, query_id, rank FROM found WHERE rank <= 2",
    "search_json": f"WITH {_search(False)} SELECT qid, string_agg(query_id || '=' || query, ';' ORDER BY rank) AS found FROM found JOIN names USING (query_id) WHERE rank <= 2 GROUP BY qid",
    "match_miss_excess": f"WITH {_PAIRS} SELECT qid, cand_id, {_set('list_filter(q, lambda w: list_contains(c, w))')} AS match, {_set('list_filter(q, lambda w: NOT list_contains(c, w))')} AS miss, {_set('list_filter(c, lambda w: NOT list_contains(q, w))')} AS excess FROM pairs",
    "synonym_substitution": f"""WITH {_PAIRS}, used AS (SELECT *, NOT list_contains(c, q[1]) AS swap FROM pairs),
m AS (SELECT *, list_filter(q, lambda w: list_contains(c, w) OR (swap AND w = q[1])) AS mw, CASE WHEN swap THEN list_filter(c, lambda w: w <> c[2]) ELSE c END AS cw FROM used)
SELECT qid, cand_id, {_set("mw")} AS match, {_set("list_filter(q, lambda w: NOT list_contains(mw, w))")} AS miss, {_set("list_filter(cw, lambda w: NOT list_contains(mw, w))")} AS excess FROM m""",
    "excess_refund": f"""WITH {_PAIRS}, r AS (SELECT qid, cand_id, CASE WHEN c[1] = q[1] THEN 0.25 WHEN c[1] = q[2] THEN 0.75 ELSE 0 END + 0.25 AS back FROM pairs)
SELECT qid, cand_id, round(greatest(0, 0.9::DOUBLE - 0.9::DOUBLE * back), 6) AS keyword FROM r""",
    "vec_combined": f"WITH {_COMBINED} SELECT query_id, place, round(x, 3) AS x FROM combined",
    "vec_oov": f"WITH {_COMBINED} SELECT query_id, count(DISTINCT word) FILTER (WHERE vec IS NULL) AS unknown FROM own GROUP BY query_id",
    "vec_cosine": f"""WITH {_COMBINED}, v AS (SELECT query_id, list(x ORDER BY place) AS v FROM combined GROUP BY query_id)
SELECT a.query_id, b.query_id AS other_id, round({_cos("a.v", "b.v")}, 6) AS cosine FROM v a, v b""",
    "pair_distances": f"WITH {_PAIRS}, {_OVERLAP} SELECT qid, cand_id, round(keyword, 6) AS keyword FROM near",
    "vec_diff_rerank": f"WITH {_rerank(f'{_PAIRS}, {_OVERLAP}')}",
    "synonym_variants": f"""WITH {_NAMES}, {_sides("stored", "names", "query_id")}, alt AS (SELECT word, 'alt' || word AS synonym, k FROM vocab WHERE k % 3 = 0),
two AS (SELECT t.query_id AS id, split_part(query, ' ', 1) AS a, split_part(query, ' ', 2) AS b FROM names t),
full0 AS (SELECT two.*, x.synonym AS sa, y.synonym AS sb, CASE WHEN x.word IS NULL THEN u.rel ELSE greatest(u.rel, 6666) END AS ra, CASE WHEN y.word IS NULL THEN v.rel ELSE greatest(v.rel, 6666) END AS rb
FROM two JOIN vocab u ON u.word = a JOIN vocab v ON v.word = b LEFT JOIN alt x ON x.word = a LEFT JOIN alt y ON y.word = b),
ranked AS (SELECT *, ra / (ra + rb) AS qa, rb / (ra + rb) AS qb, ra >= rb AS a_first FROM full0),
grams AS (SELECT id, least(a, b) || ' ' || greatest(a, b) AS ngram, qa + qb AS rel FROM ranked
UNION ALL SELECT id, least(sa, b) || ' ' || greatest(sa, b), qa + qb FROM ranked WHERE sa IS NOT NULL UNION ALL SELECT id, least(a, sb) || ' ' || greatest(a, sb), qa + qb FROM ranked WHERE sb IS NOT NULL
UNION ALL SELECT id, a, qa FROM ranked WHERE a_first OR qa > 0.8 * qb UNION ALL SELECT id, b, qb FROM ranked WHERE NOT a_first OR qb > 0.8 * qa
UNION ALL SELECT id, sa, qa FROM ranked WHERE sa IS NOT NULL AND (a_first OR qa > 0.8 * qb) UNION ALL SELECT id, sb, qb FROM ranked WHERE sb IS NOT NULL AND (NOT a_first OR qb > 0.8 * qa))
SELECT id AS query_id, ngram, round(rel, 6) AS rel FROM grams""",
    "toponym_must_have": f"""WITH {_NAMES}, {_sides("stored", "names", "query_id")}, places AS (SELECT word FROM vocab WHERE k % 4 = 1),
p AS (SELECT *, CASE WHEN w0 IN (SELECT word FROM places) THEN w0 WHEN w1 IN (SELECT word FROM places) THEN w1 END AS place FROM stored)
SELECT id AS query_id, CASE WHEN s0 > 0.6 OR place IS NOT NULL OR s1 < 0.85 * s0 THEN array_to_string(list_sort(list_distinct(list_filter([w0, place], lambda w: w IS NOT NULL))), ' ') ELSE '' END AS must FROM p""",
    "search_reranked": f"WITH {_rerank(_FOUND_PAIRS, ', TRUE AS ordered')}".replace("SELECT qid, cand_id, round(k, 6)", "SELECT qid, cand_id AS query_id, round(k, 6)"),
    "item_idf": f"WITH {_WORDS} SELECT DISTINCT i.word, round(log2(n / coalesce(df, 1)), 6) AS idf FROM items i LEFT JOIN df USING (word), total",
    "three_word_ngrams": _THREE_NGRAMS,
    "joined_dimensions": _THREE_NGRAMS,
    "three_word_must": f"WITH {_THREE_SHARES} SELECT query_id, CASE WHEN s0 > 0.5 OR s1 < 0.85 * s0 THEN w0 ELSE '' END AS must FROM ranked",
    "stop_unit_ngrams": _STOP_UNITS,
    "word_relevances": f"WITH {_NAMES}, {_sides('stored', 'names', 'query_id')} SELECT id AS query_id, w0 AS word, round(s0, 6) AS share FROM stored UNION ALL SELECT id, w1, round(s1, 6) FROM stored",
    "stop_weight_vectors": f"""WITH {_NAMES}, {_VECTORS}, own AS (SELECT n.query_id, v.rel * CASE WHEN v.k % 5 = 0 THEN 0.25::DOUBLE ELSE 1 END AS w, x.vec FROM (SELECT query_id, unnest(string_split(query, ' ')) AS word FROM names) n JOIN vocab v USING (word) JOIN word_vecs x USING (word)),
flat AS (SELECT query_id, unnest(range(len(vec))) AS place, unnest(vec)::DOUBLE * w AS x FROM own) SELECT query_id, place, round(sum(x), 3) AS x FROM flat GROUP BY ALL""",
    "gzip_lines": f"WITH {_LINE} SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS query_id, type, query, parse_error FROM parsed",
    "corpus_file": f"WITH {_LINE} SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS query_id, coalesce(query, '') AS query FROM parsed",
    "stopwords_file": f"WITH {_WORDS} SELECT word FROM stops",
    "toponyms_file": "SELECT lower(n_name) AS word FROM nation UNION SELECT lower(r_name) FROM region",
    "synonyms_file": f"WITH {_NAMES} SELECT word, 'alt' || word AS synonym FROM vocab WHERE k % 3 = 0",
    "terms_file": f"WITH {_NAMES} SELECT word, rel FROM vocab",
    "vectors_file": f"WITH {_NAMES}, {_VECTORS} SELECT word, unnest(range(len(vec))) AS place, round(unnest(vec)::DOUBLE, 5) AS x FROM word_vecs",
    "vector_lookup": f"WITH {_NAMES}, {_VECTORS} SELECT word, (SELECT count(*) FROM word_vecs) AS n_words, len(vec) AS size, round(vec[1]::DOUBLE, 5) AS x FROM word_vecs ORDER BY word LIMIT 1",
    "ngram_rows_file": f"WITH {_NAME_POSTINGS} SELECT ngram, query_id, score FROM own_postings",
    "index_round_trip": f"WITH {_NAME_POSTINGS} SELECT ngram, query_id, score FROM own_postings",
    "index_shard_ranges": f"WITH {_NAME_POSTINGS} SELECT ngram, query_id, score FROM own_postings",
    "loaded_search": f"WITH {_search(False)} SELECT qid, query_id, round(keyword, 6) AS keyword FROM found",
    "posting_lookup": f"WITH {_NAME_POSTINGS}, one AS (SELECT query FROM names ORDER BY query_id LIMIT 1) SELECT ngram, query_id, score FROM own_postings, one WHERE ngram IN (split_part(query, ' ', 1), split_part(query, ' ', 2))",
    "merged_dictionary_file": f"WITH {_NAME_POSTINGS} SELECT ngram, count(*) AS len FROM own_postings GROUP BY ngram",
    "index_counters": f"WITH {_NAME_POSTINGS}, lens AS (SELECT count(*) AS len FROM own_postings GROUP BY ngram) SELECT (SELECT count(*) FROM names) AS n_queries, CAST(sum(len) AS BIGINT) AS n_postings, count(*) AS n_ngrams, max(len) AS longest FROM lens",
    "streamed_postings": f"WITH {_NAME_POSTINGS} SELECT ngram, query_id, score FROM own_postings",
    "settings_file": "SELECT FALSE AS use_word_vectors, 8::BIGINT AS nr_shards, 250000000::BIGINT AS shard_size, 500::BIGINT AS bucket_size, 6::BIGINT AS id_size",
    "command_line": f"WITH {_NAME_POSTINGS}, lens AS (SELECT ngram, count(*) AS len FROM own_postings GROUP BY ngram) SELECT ngram, query, score, len FROM own_postings JOIN names USING (query_id) JOIN lens USING (ngram)",
}
