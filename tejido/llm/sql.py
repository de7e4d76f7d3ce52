"""DuckDB texts of the operators that SQL can express. Words are \\x20 and \\x09-\\x0D apart; only A-Z is lowered."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

PHRASES = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), totals AS (
    SELECT lang, sum(len(ws)) AS n FROM worded GROUP BY lang
), starts AS (
    SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(ws) >= m
), f AS (
    SELECT lang, m, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS phrase, count(*) AS a FROM starts GROUP BY ALL HAVING count(*) >= 100
), candidates AS (
    SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2
), inside AS (
    SELECT c.lang, array_to_string(list_slice(c.ws, s, s + j - 1), ' ') AS phrase, max(c.a) AS longer
    FROM candidates c, (SELECT unnest([2, 3, 4]) AS j), (SELECT unnest([1, 2, 3, 4]) AS s) WHERE j < c.m AND s + j - 1 <= c.m GROUP BY ALL
), own AS (
    SELECT c.* FROM candidates c LEFT JOIN inside i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < 100 * c.a
), cuts AS (
    SELECT o.lang, o.phrase, o.a, k, l.a AS l, r.a AS r, t.n, (1000::HUGEINT * o.a * t.n) // (l.a::HUGEINT * r.a) AS score
    FROM own o JOIN (SELECT unnest([1, 2, 3, 4]) AS k) ON k < o.m JOIN totals t USING (lang)
    JOIN f l ON l.lang = o.lang AND l.phrase = array_to_string(list_slice(o.ws, 1, k), ' ')
    JOIN f r ON r.lang = o.lang AND r.phrase = array_to_string(list_slice(o.ws, k + 1, o.m), ' ')
), best AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
"""

SHINGLE_JOIN = rf"""
WITH RECURSIVE worded AS (
    SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(list_slice(ws, i, i + 2), ' '))) END AS s FROM worded
), shingles AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets
), shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) + any_value(y.n) AS total, count(*) AS c FROM shingles x JOIN shingles y ON x.h = y.h AND x.doc_id <> y.doc_id AND 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n) GROUP BY 1, 2
), links AS (
    SELECT a, b FROM shared WHERE 100 * c >= 90 * (total - c)
), reached(a, b) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) USING (doc_id)
"""

FILTER_AUDIT = r"""
WITH worded AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), marked AS (
    SELECT part, doc_id, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM worded
), rated AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), kinds AS (
    SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM marked LEFT JOIN rated USING (doc_id) GROUP BY ALL
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
    SELECT v.c || w.c || x.c || y.c || z.c AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits FROM letters v, letters w, letters x, letters y, letters z WHERE v.bit | w.bit | x.bit | y.bit | z.bit = 31
), steps AS (
    SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::INT AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), counted AS (
    SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM kinds, steps GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""
