"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _crc32(text: str) -> str:
    """crc32 of an ASCII text, bit by bit."""
    codes = f"list_transform(range(1, len({text}) + 1), lambda i: CAST(ascii({text}[i]) AS BIGINT))"
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x // 2, 3988292384 * (x % 2)))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {step}), 4294967295)"


SQL: dict[str, str] = {
    "op11_periodic_runs": rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
g AS (SELECT *, len(w) AS n, h // 10 % len(w) AS a FROM d),
p AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(w[:a], list_transform(range(a, n), lambda i: w[1 + a + (i - a) % (1 + (n - a) // (3 + h // 10 % 8))])) ELSE w END AS w FROM g),
x AS MATERIALIZED (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + 16], ' ') AS gram FROM (SELECT *, unnest(range(0, n - 15)) AS i FROM p WHERE n >= 24)),
m AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.gram = b.gram AND b.i > a.i AND b.i - a.i <= a.n // 3),
r AS (SELECT doc_id, q, min(i) AS s, count(*) + 15 + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM m)
    GROUP BY doc_id, q, k HAVING count(*) + 15 >= greatest(24 - q, 2 * q)),
u AS MATERIALIZED (SELECT doc_id, s, l, min(q) AS q FROM r GROUP BY doc_id, s, l),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l / q DESC, s, q) AS k FROM u),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM u GROUP BY doc_id),
o AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM u),
c AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, n)) AS i FROM p) w ANTI JOIN o ON o.doc_id = w.doc_id AND o.i = w.i GROUP BY w.doc_id)
SELECT p.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
    CAST(1000 * l // q AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM p LEFT JOIN t ON t.doc_id = p.doc_id LEFT JOIN b ON b.doc_id = p.doc_id AND b.k = 1 LEFT JOIN c ON c.doc_id = p.doc_id""",
    "op13_turn_repair": rf"""
WITH RECURSIVE f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS fault FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM f),
t AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY c) AS n, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY k) > 1 THEN 'duplicate'
        WHEN NOT contains('.!?', right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1)) THEN 'truncated' ELSE 'none' END AS fault,
    lag(role[1]) OVER (PARTITION BY c ORDER BY k) || role[1] NOT IN ('su', 'ua', 'au') AS illegal
    FROM (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM d)),
w AS (SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (coalesce(illegal, false)) AS illegal FROM t GROUP BY c),
-- backwards: the cheapest way from a state, before the k-th turn, to the end
s(c, state, k, cost, audit) AS (
    SELECT DISTINCT c, z.state, n, CAST(5 * len(put) AS BIGINT), put FROM t, (VALUES (0, ''), (1, 'II'), (2, 'I'), (3, '')) z(state, put)
    UNION ALL
    SELECT c, state, k, b.cost, b.audit FROM (SELECT s.c, o.state, s.k - 1 AS k, min(ROW(s.cost + 5 * len(o.put) + e.price + CASE WHEN t.fault = 'truncated' AND e.letter <> 'D' THEN 5 ELSE 0 END, o.put || e.letter || s.audit)::STRUCT(cost BIGINT, audit VARCHAR)) AS b
        FROM s JOIN t ON t.c = s.c AND t.k = s.k
        JOIN (VALUES ('s', 0, 1, 'K', 0), ('u', 0, 2, 'K', 0), ('u', 1, 2, 'K', 0), ('u', 3, 2, 'K', 0), ('a', 2, 3, 'K', 0), ('', 0, 2, 'R', 1), ('', 1, 2, 'R', 1), ('', 3, 2, 'R', 1), ('', 2, 3, 'R', 1),
            ('', 0, 0, 'D', 2), ('', 1, 1, 'D', 2), ('', 2, 2, 'D', 2), ('', 3, 3, 'D', 2)) e(initial, mid, state, letter, price)
            ON e.state = s.state AND e.initial IN ('', role[1]) AND (e.letter = 'D' OR t.fault NOT IN ('blank', 'duplicate'))
        JOIN (VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'II'), (2, 2, ''), (2, 3, 'I'), (3, 3, ''), (3, 2, 'I')) o(state, mid, put) ON o.mid = e.mid
        GROUP BY s.c, o.state, s.k)),
a AS (SELECT c, cost, audit FROM s WHERE k = 0 AND state = 0),
l AS (SELECT c, unnest(string_split(audit, '')) AS letter, unnest(range(1, len(audit) + 1)) AS j FROM a),
p AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY c ORDER BY j) AS k FROM l),
o AS (SELECT p.*, role, text, row_number() OVER (PARTITION BY p.c ORDER BY j) AS place FROM p LEFT JOIN t ON t.c = p.c AND t.k = p.k AND letter <> 'I' WHERE letter <> 'D'),
h AS (SELECT *, count(*) FILTER (place = 1 AND letter = 'K' AND role[1] = 's') OVER (PARTITION BY c) AS head FROM o),
r AS (SELECT c, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS repaired FROM h GROUP BY c)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
    CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN a ON a.c = w.c LEFT JOIN r ON r.c = w.c""",
    "op12_block_names": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
    doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM n""",
    "op7_warc_store": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, body, CAST(strlen(body) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, payload_bytes, sha1(body) AS payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM q""",
    "op5_temporal_url_lists": r"""
WITH c AS (SELECT page_id, url, lower(nullif(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1), '')) AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g') AS path, DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS fetched FROM pages),
n AS (SELECT DISTINCT 'malware' AS list, 'host:' || host AS entry FROM c UNION SELECT DISTINCT 'adult', 'path:' || host || '/' || string_split_regex(path, '/+')[1] FROM c),
k AS (SELECT *, CAST('0x' || substr(md5(entry), 1, 6) AS INT) AS k FROM n WHERE entry IS NOT NULL),
log AS (SELECT list, entry, a AS action, DATE '2024-01-01' + CAST(k % 200 + d AS INT) AS day FROM k, (VALUES ('add', 0, 4), ('remove', 90, 8), ('add', 150, 16)) v(a, d, m) WHERE k % m = 0),
w AS (SELECT *, lag(action) OVER (PARTITION BY list, entry ORDER BY day) AS before FROM log),
i AS (SELECT list, entry, day AS from_day, to_day FROM (SELECT *, lead(day) OVER (PARTITION BY list, entry ORDER BY day) AS to_day FROM w WHERE action IS DISTINCT FROM before) WHERE action = 'add'),
s AS (SELECT page_id, url, fetched, host, unnest(list_distinct(list_concat(
    list_transform(range(1, greatest(len(string_split(host, '.')), 2)), lambda j: 'host:' || array_to_string(string_split(host, '.')[j:], '.')),
    CASE WHEN path = '' THEN [] ELSE list_transform(range(1, least(len(string_split_regex(path, '/+')), 8) + 1), lambda j: 'path:' || host || '/' || array_to_string(string_split_regex(path, '/+')[:j], '/')) END))) AS entry FROM c),
f AS (SELECT s.page_id, count(*) AS n_active, string_agg(DISTINCT i.list, ',' ORDER BY i.list) AS lists, min(from_day) AS since FROM s JOIN i ON i.entry = s.entry AND fetched >= from_day AND (to_day IS NULL OR fetched < to_day) GROUP BY s.page_id)
SELECT c.page_id, c.url, c.host, c.fetched, CAST(coalesce(n_active, 0) AS BIGINT) AS n_active, coalesce(lists, '') AS lists, since, coalesce(n_active, 0) > 0 AS blocked FROM c LEFT JOIN f ON f.page_id = c.page_id""",
    "op6_positional_decontamination": rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS MATERIALIZED (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, greatest(0, len(w) - 10) + 2)) AS k FROM i WHERE len(w) > 0)),
h AS MATERIALIZED (SELECT doc_id, k, n, item FROM (SELECT doc_id, k, s.n, array_to_string(w[k : k + s.n - 1], ' ') AS phrase
    FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d), (SELECT DISTINCT n FROM v) s WHERE k + s.n - 1 <= len(w)) JOIN v USING (n, phrase)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id""",
    "op4_tensored_minhash": rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[k : k + least(2, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(2, len(w)))) AS k FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS MATERIALIZED (SELECT a, b FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 80 * (p.n + q.n - i)),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c(node, comp) USING KEY (node) AS (SELECT doc_id, doc_id FROM n
    UNION SELECT l.a, min(f.comp) FROM c f JOIN l ON l.b = f.node JOIN recurring.c o ON o.node = l.a WHERE f.comp < o.comp GROUP BY l.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.comp, d.doc_id) AS component_id, d.doc_id = coalesce(c.comp, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id""",
}
