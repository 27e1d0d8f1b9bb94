"""Check SQL for the queries that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    # the schedule takes of every source the whole part of its target, pass by pass in the order of its shuffle
    "op1_mixing": f"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
l AS (SELECT *, row_number() OVER (ORDER BY (3 * source_size)::DOUBLE / weight, rank) AS place FROM w),
c AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
  coalesce(sum(3 * source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
  (sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS sharing FROM l),
f AS (SELECT capped, sharing, place FROM c WHERE (weight * (total - capped))::DOUBLE / sharing <= 3 * source_size ORDER BY place LIMIT 1),
t AS (SELECT c.source, c.source_size, CASE WHEN c.place >= f.place THEN (c.weight * (c.total - f.capped))::DOUBLE / f.sharing
  ELSE (3 * c.source_size)::DOUBLE END AS target FROM c LEFT JOIN f ON true),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS upto,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE
  (upto // source_size) * size + greatest(0, least(start + size, upto % source_size) - start) END::BIGINT AS taken FROM p""",

    "op3_quality_rules": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d),
h AS (SELECT *, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM h WHERE c IS NOT NULL) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS at FROM r) GROUP BY doc_id),
lines AS (SELECT doc_id, source, line FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
texts AS MATERIALIZED (SELECT source, md5(t) AS id, any_value(w) AS w FROM d GROUP BY source, md5(t)),
win AS MATERIALIZED (SELECT DISTINCT source, id, unnest(list_transform(range(1, len(w) - 1), lambda i: md5(concat_ws(' ', w[i], w[i + 1], w[i + 2])))) AS g
  FROM texts WHERE len(w) >= 3),
wins AS (SELECT source, id, count(*) AS n FROM win GROUP BY source, id),
shared AS (SELECT a.source, a.id AS a, b.id AS b, count(*) AS equal FROM win a JOIN win b ON a.g = b.g AND a.source IS NOT DISTINCT FROM b.source AND a.id < b.id
  GROUP BY ALL),
alike AS MATERIALIZED (SELECT s.source, a, b FROM shared s JOIN wins x ON x.id = a AND x.source IS NOT DISTINCT FROM s.source
  JOIN wins y ON y.id = b AND y.source IS NOT DISTINCT FROM s.source WHERE equal >= 0.95::DOUBLE * (x.n + y.n - equal)),
edge AS MATERIALIZED (SELECT source, a, b FROM alike UNION ALL SELECT source, b, a FROM alike),
reach(source, id, root) AS (SELECT source, id, id FROM texts UNION SELECT r.source, r.id, e.b FROM reach r JOIN edge e
  ON e.a = r.root AND e.source IS NOT DISTINCT FROM r.source),
group_of AS (SELECT source, id, min(root) AS root FROM reach GROUP BY source, id),
sig AS (SELECT doc_id, d.source, root AS signature FROM d JOIN group_of g ON g.id = md5(t) AND g.source IS NOT DISTINCT FROM d.source),
n AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS norm,
  len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM lines),
hosts AS (SELECT source, count(DISTINCT signature) AS documents FROM sig GROUP BY source),
seen AS (SELECT n.source, norm, count(DISTINCT signature) AS seen FROM n JOIN sig USING (doc_id) GROUP BY n.source, norm),
common AS (SELECT s.source, norm FROM seen s JOIN hosts h ON s.source IS NOT DISTINCT FROM h.source
  WHERE seen > 20 AND seen > 0.05::DOUBLE * documents),
rem AS (SELECT doc_id, sum(words)::BIGINT AS removed_words FROM n JOIN common c ON n.norm = c.norm AND n.source IS NOT DISTINCT FROM c.source
  GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN rem USING (doc_id))
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_words - removed_words < 0.3::DOUBLE * n_words) AS kept
FROM m""".replace("\\\\", "\\"),

    "op4_warc": """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT digest, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY digest HAVING count(*) > 1)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to
FROM p LEFT JOIN g USING (digest)""",

    "op5_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",

    "op11_vector_copies": """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS id, vec_id, embedding::DOUBLE[] AS e,
  coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS usable FROM embeddings),
u AS (SELECT * FROM v WHERE usable),
l AS MATERIALIZED (SELECT a.id AS a, b.id AS b, b.vec_id FROM u a JOIN u b ON a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(id, reached) AS (SELECT id, id FROM v UNION SELECT r.id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT r.id, min(v.vec_id) AS component_id FROM r JOIN v ON r.reached = v.id GROUP BY r.id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN c USING (id) LEFT JOIN n ON n.a = v.id""",

    "op12_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w, range(1, 5) t(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS times FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
parts AS MATERIALIZED (SELECT lang, phrase, times, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS head,
  array_to_string(string_split(phrase, ' ')[c + 1:], ' ') AS tail FROM f, range(1, 4) t(c) WHERE k > c),
cuts AS (SELECT parts.lang, parts.phrase, parts.times AS a, c, x.times AS l, y.times AS r, (2000000 * parts.times) // (x.times + y.times) AS score
  FROM parts JOIN f x ON x.lang = parts.lang AND x.phrase = head JOIN f y ON y.lang = parts.lang AND y.phrase = tail),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (SELECT f.lang, array_to_string(string_split(phrase, ' ')[s:s + m - 1], ' ') AS phrase, max(times) AS longer
  FROM f, range(2, 4) t(m), range(1, 4) q(s) WHERE m < f.k AND s + m - 1 <= f.k GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",

    "op13_prefix_trie": """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT *, md5(length(role) || ':' || role || ':' || text) AS key, strlen(text) AS size FROM t),
s AS (SELECT conv_id, list({'key': key, 'size': size} ORDER BY turn NULLS FIRST, key) AS turns FROM k GROUP BY conv_id),
h AS (SELECT *, xor(4294967295, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, x:
  list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)), xor(c, x)), 4294967295::BIGINT)) % 9 AS h FROM s),
m AS (SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns
  FROM h LEFT JOIN s b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d AS depth, len(turns) AS n, array_to_string(list_transform(turns[1:d], lambda x: x.key), '') AS path,
  CASE WHEN d = 0 THEN 0 ELSE turns[d].size END AS size FROM m, unnest(range(0, len(turns) + 1)) r(d)),
x AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM p GROUP BY path, depth),
c AS (SELECT left(path, 32 * (depth - 1)::INT) AS path, count(*) AS n_children FROM x WHERE depth > 0 GROUP BY 1),
a AS (SELECT left(x.path, 32 * d::INT) AS path, sum(CASE WHEN c.path IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves,
  sum((n_convs - 1) * size)::BIGINT AS saved_tokens FROM x LEFT JOIN c ON c.path = x.path, unnest(range(0, x.depth + 1)) r(d) GROUP BY 1)
SELECT x.conv_id, x.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, x.n_convs::BIGINT AS n_convs,
  coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, x.ends_sha256
FROM x JOIN a ON a.path = x.path LEFT JOIN c ON c.path = x.path
LEFT JOIN x o ON x.depth > 0 AND o.depth = x.depth - 1 AND o.path = left(x.path, 32 * (x.depth - 1)::INT)""",
}
