"""DuckDB SQL for queries of this subpackage that SQL can express."""

_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_AZ}, {_ALNUM}) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_AZ}, {_ALNUM}) AS w FROM benchmark WHERE item_id IS NOT NULL),
j AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, w[p:p + n - 1] AS g FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM j)),
dw AS (SELECT doc_id, p, n, w[p:p + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
v AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS p FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, p FROM v QUALIFY count(*) OVER (PARTITION BY g) > 1),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 34)) AS q FROM r),
x AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS q, unnest(w) AS word FROM d),
k AS (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.q) AS t FROM x ANTI JOIN g ON g.doc_id = x.doc_id AND g.q = x.q GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_AZ}, {_SPACED}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(g, ' ')) AS h FROM (
    SELECT doc_id, w[p:p + 4] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS p FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * c >= 75 * (u.n + v.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""

#: Every control string that the text holds costs one more character.
_CONTROL = r"'<s>|</s>|\[ROLE\]|\[/ROLE\]|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>'"
CHAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, length('<s>[ROLE][/ROLE]</s>') + length(role) + length(text) + len(regexp_extract_all(role, {_CONTROL})) + len(regexp_extract_all(text, {_CONTROL})) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(n) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

#: CRC-32 byte by byte: z is its table, by the polynomial's rule; each different feature is hashed once.
RESAMPLE = f"""
WITH z AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_AZ}, {_ALNUM}) AS w FROM documents),
n AS (SELECT unnest([1, 2, 3]) AS n),
f AS MATERIALIZED (SELECT r, array_to_string(w[p:p + n - 1], ' ') AS f FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, n WHERE len(w) >= n)),
g AS MATERIALIZED (SELECT array_to_string(w[p:p + n - 1], ' ') AS f FROM (SELECT w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM (SELECT regexp_extract_all({_AZ}, {_ALNUM}) AS w FROM benchmark), n WHERE len(w) >= n)),
c AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b
    FROM (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM f UNION SELECT f FROM g)), z),
fb AS (SELECT r, b FROM f JOIN c ON f.f = c.f), sb AS (SELECT b, count(*) AS s FROM fb GROUP BY b), tb AS (SELECT b, count(*) AS t FROM g JOIN c ON g.f = c.f GROUP BY b),
gain AS (SELECT k.b, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM f) + 10000.0::DOUBLE) / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM g) + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM (SELECT DISTINCT b FROM c) k LEFT JOIN sb ON sb.b = k.b LEFT JOIN tb ON tb.b = k.b),
x AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM fb JOIN gain ON gain.b = fb.b GROUP BY r),
y AS (SELECT d.r, doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN x ON x.r = d.r),
v AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS FIRST) AS place, 5 * (SELECT count(*) FROM y WHERE able) // 100 AS most FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= most THEN place END AS rank FROM v
"""
