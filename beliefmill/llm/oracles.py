"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from .secrets import RULES


def _secrets() -> str:
    per_kind = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        per_kind.append(f"""
  SELECT doc_id, {i} AS o, '{r.kind}' AS kind, {str(r.base).lower()} AS base,
         list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0) AS s, length(found[i]) AS n
  FROM (SELECT doc_id, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}', 0) AS found, regexp_extract_all(t, '{p}', {r.group}) AS vals FROM d), unnest(range(1, len(found) + 1)) AS u(i)
  WHERE length(vals[i]) >= {r.least}""")
    return "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (" + " UNION ALL ".join(per_kind) + """
), a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(concat_ws(':', kind, s::BIGINT, (s + n)::BIGINT), ',' ORDER BY s, o) FILTER (base) AS b, string_agg(concat_ws(':', kind, s::BIGINT, (s + n)::BIGINT), ',' ORDER BY s, o) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


URLS = r"""
WITH seen AS (
  SELECT page_id, url, rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
         DATE '2024-01-01' + (('0x' || substr(md5(coalesce(url, '')), 1, 6))::BIGINT % 730)::INT AS day FROM pages),
hosts AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM seen WHERE host <> ''),
below AS (SELECT host, array_to_string(l[i:], '.') AS name FROM hosts, unnest(range(1, len(l) + 1)) AS u(i)),
names AS (SELECT DISTINCT name, md5(name) AS h FROM below WHERE contains(name, '.')),
picked AS (SELECT name, CASE WHEN ('0x' || substr(h, 2, 1))::INT % 2 = 0 THEN 'malware' ELSE 'adult' END AS list,
           DATE '2024-01-01' + (('0x' || substr(h, 3, 3))::INT % 500) AS first, ('0x' || substr(h, 6, 1))::INT % 2 = 0 AS again
           FROM names WHERE ('0x' || substr(h, 1, 1))::INT % 8 < 3),
spans AS (SELECT list, name, first AS f, first + 200 AS t FROM picked UNION ALL SELECT list, name, first + 350, NULL FROM picked WHERE again),
met AS (SELECT DISTINCT page_id, url, list FROM seen JOIN below USING (host) JOIN spans USING (name) WHERE day >= f AND (t IS NULL OR day < t)),
active AS (SELECT page_id, string_agg(list, ',' ORDER BY list) AS lists FROM met GROUP BY page_id)
SELECT page_id, url, host, day, coalesce(lists, '') AS lists, lists IS NOT NULL AS blocked FROM seen LEFT JOIN active USING (page_id)
"""

CHATS = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
coded AS (SELECT *, length(replace(replace(replace(replace(text, '\', '\0'), '###', '\1'), '</turn>', '\2'), '<|', '\4')) AS n FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(role) + 2 + n + 9)::BIGINT AS formatted_chars
FROM coded GROUP BY conv_id
"""

MIX = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) || ':7'), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[((rank - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget, coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
v AS (SELECT *, arg_min((budget - before) / rest, before) FILTER ((budget - before) / rest * weight <= cap) OVER () AS level FROM r),
t AS (SELECT source, source_size, floor(coalesce(least(cap, level * weight), cap) * 1e6 + 0.5) / 1e6 AS target FROM v),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS full_times FROM t),
k AS (SELECT u.source, u.source_size, target, full_times, key, target - full_times * u.source_size AS left_over, sum(size) AS n FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY key) AS upto FROM k),
m AS (SELECT *, CASE WHEN left_over > 0 AND (upto <= left_over OR (upto - n <= left_over AND (left_over - upto + n) * 2 >= n)) THEN 1 ELSE 0 END AS more FROM c)
SELECT d.doc_id, d.size, m.source_size, m.target, ((full_times + more) * d.size)::BIGINT AS taken FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source AND d.key = m.key
"""

#: Components: reach holds every (node, root) with root below node that edges lead to; small tables only.
_REACH = """
near AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, e.b FROM reach AS r JOIN near AS e ON r.b = e.a),
low AS (SELECT a, min(least(a, b)) AS component FROM reach GROUP BY a)"""

JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w),
h AS (SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS k, s FROM s),
sets AS (SELECT k, min(doc_id) AS id, any_value(n) AS n, any_value(s) AS s, count(*) AS w FROM h WHERE n > 0 GROUP BY k),
m AS (SELECT id, n, unnest(s) AS x FROM sets),
edges AS (SELECT a.id AS a, b.id AS b FROM m AS a JOIN m AS b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),""" + _REACH + """,
k AS (SELECT near.a, sum(w) AS k FROM near JOIN sets ON sets.id = near.b GROUP BY near.a)
SELECT h.doc_id, h.n::BIGINT AS n_shingles, coalesce(low.component, sets.id, h.doc_id) AS component_id, coalesce(w - 1 + coalesce(k.k, 0), 0)::BIGINT AS n_links
FROM h LEFT JOIN sets USING (k) LEFT JOIN low ON low.a = sets.id LEFT JOIN k ON k.a = sets.id
"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
edges AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok AS a JOIN ok AS b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),""" + _REACH + """,
n AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id
"""

#: crc32 of the digits of an id: the table's entry for a byte is eight shifts of it, a text is a fold over its bytes.
CRC = """
bits AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS t),
hashed AS (SELECT doc_id, xor(4294967295, list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
             lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295::BIGINT)) AS h FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), bits)"""

#: Runs by their definition: stretches of five words that occur again q words on, in a row, are words that equal those q words on.
RUNS = rf"""
WITH {CRC},
w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, h FROM documents LEFT JOIN hashed USING (doc_id)),
a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM w),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
d AS (SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p),
g AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 5], ' ') AS g FROM d, unnest(range(len(w) - 4)) AS u(i)),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g AS x JOIN g AS y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q + 4 AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM e) GROUP BY doc_id, q, part),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat_ws(',', start, length, period) || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id),
best AS (SELECT x.* FROM r AS x WHERE NOT EXISTS (FROM r AS y WHERE y.doc_id = x.doc_id AND (y.length * x.period > x.length * y.period
           OR (y.length * x.period = x.length * y.period AND (y.start, y.period) < (x.start, x.period))))),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT doc_id, coalesce(string_agg(word, ' ' ORDER BY i), '') AS text FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.start, best.length, best.period, 1000 * best.length // best.period AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: A gram is text here; blanks sort below letters, and shorter grams first, as their numbers do.
LANGUAGES = rf"""
WITH {CRC},
d AS (SELECT doc_id, lang, coalesce(h % 5 = 0, false) AS held_out, h IS NULL AS unnamed, ' ' || regexp_replace(lower(coalesce(text, '')), '[^\pL]', ' ', 'g') || ' ' AS t FROM documents LEFT JOIN hashed USING (doc_id)),
z AS (SELECT * EXCLUDE t, string_split(t, '') AS c FROM d),
y AS (SELECT * EXCLUDE (c, z), z[1] AS a, z[2] AS b, z[3] AS e FROM (SELECT *, unnest(list_zip(c, c[2:], c[3:])) AS z FROM z)),
g AS (SELECT doc_id, lang, held_out, unnamed, g, count(*) AS n FROM (
        SELECT *, a AS g FROM y WHERE a <> ' ' UNION ALL SELECT *, a || b AS g FROM y WHERE b IS NOT NULL AND a || b <> '  '
        UNION ALL SELECT *, a || b || e AS g FROM y WHERE e IS NOT NULL AND b <> ' ') GROUP BY ALL),
p AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(g), g) - 1 AS rank FROM (
        SELECT lang, g, sum(n) AS n FROM g WHERE lang IS NOT NULL AND NOT held_out AND NOT unnamed GROUP BY lang, g) QUALIFY rank < 400),
o AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(g), g) - 1 AS place FROM g QUALIFY place < 400),
size AS (SELECT doc_id, count(*) AS m FROM o GROUP BY doc_id),
met AS (SELECT doc_id, lang, sum(400 - abs(rank - place)) AS saved FROM o JOIN p USING (g) GROUP BY doc_id, lang),
dist AS (SELECT doc_id, l.lang, m * 400 - coalesce(saved, 0) AS dist, m * 400 AS most FROM size CROSS JOIN (SELECT DISTINCT lang FROM p) AS l LEFT JOIN met USING (doc_id, lang)),
best AS (SELECT doc_id, lang, dist, most FROM dist QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dist, lang) = 1)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(1 - dist::DOUBLE / most, 0) AS score FROM d LEFT JOIN best USING (doc_id)
"""

NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
      FROM v AS a JOIN v AS b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""

ORACLES: dict[str, str] = {"op1_jaccard_join": JACCARD, "op3_vector_dedup": VECTORS, "op2_secret_scan": _secrets(), "op4_url_filter": URLS, "op6_chat_format": CHATS, "op7_source_mix": MIX, "op11_periodic_runs": RUNS, "op12_hard_negatives": NEGATIVES, "op13_language_id": LANGUAGES}
