"""SQL for the queries that SQL can express."""

from .quality_rules import STOP_WORDS

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_DOCS = f"d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents)"
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op2_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(h, b, v)),
f AS (SELECT page_id, arg_max(h || b, length(h || b)) AS rule, arg_max(v, length(h || b)) AS verdict FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, b) GROUP BY 1)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN f ON p.page_id = f.page_id""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM m""",
    "op4_quality_rules": f"""
WITH {_DOCS}, l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT r, i, list_slice(w, i, i + 7) AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
again AS (SELECT r, s FROM win GROUP BY 1, 2 HAVING count(*) > 1), hit AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 8)) AS p FROM win JOIN again USING (r, s)) GROUP BY 1),
twin AS (SELECT r, count(*) AS twins FROM (SELECT r, word, lag(word) OVER (PARTITION BY r ORDER BY p) AS before FROM (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS p FROM d)) WHERE word = before GROUP BY 1),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop, coalesce(twins, 0) AS n_twin, len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09]*[-*•]'))) AS n_bullet,
len(list_filter(lines, lambda x: suffix(rtrim(x, ' '), '...') OR suffix(rtrim(x, ' '), '…'))) AS n_ellipsis FROM l LEFT JOIN hit USING (r) LEFT JOIN twin USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words <= 1000000 AND 100 * word_chars BETWEEN 200 * n_words AND 1500 * n_words AND 100 * n_symbols <= 10 * n_words AND 100 * n_stop >= 5 * n_words AND 100 * n_twin <= 20 * n_words
AND 100 * n_dup_lines <= 60 * n_lines AND 100 * n_bullet <= 90 * n_lines AND 100 * n_ellipsis <= 30 * n_lines AS kept FROM f""",
    "op8_substring_dedup": f"""
WITH {_DOCS}, win AS (SELECT r, i, array_to_string(list_slice(w, i, i + 34), ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
again AS (SELECT s FROM win GROUP BY 1 HAVING count(*) > 1), gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win JOIN again USING (s)),
k AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)""",
    "op10_benchmark_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark),
iw AS (SELECT item, q, n, array_to_string(list_slice(w, q, q + n - 1), ' ') AS s FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS q FROM b WHERE len(w) > 0)),
dw AS (SELECT r, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw))),
m AS (SELECT r, p, n, item, q FROM dw JOIN iw USING (n, s)), hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS k FROM m) GROUP BY 1),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM m) GROUP BY 1),
runs AS (SELECT r, item, min(p) AS p, min(q) AS q, count(*) + 9 AS n FROM (SELECT *, p - row_number() OVER (PARTITION BY r, item, p - q ORDER BY p) AS island FROM m WHERE n = 10) GROUP BY r, item, p - q, island UNION ALL SELECT r, item, p, q, n FROM m WHERE n < 10),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY n DESC, p, item, q) = 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(best.n, 0) AS longest_words, best.item AS longest_item, best.q - 1 AS longest_item_word, best.p - 1 AS longest_doc_word
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r) LEFT JOIN best USING (r)""",
    "op12_source_divergence": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
own AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) GROUP BY 1, 2, 3),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY 1, 2 HAVING count(*) >= 10),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(term) AS v FROM groups LEFT JOIN kept USING (lang) GROUP BY lang, source QUALIFY row_number() OVER (PARTITION BY lang) = 1),
cells AS (SELECT g.lang, g.source, k.term, CAST(coalesce(n, 0) AS HUGEINT) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN own USING (lang, source, term)),
langs AS (SELECT lang, term, sum(n) AS n FROM cells GROUP BY 1, 2),
p AS (SELECT lang, source, term, n, CAST(1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS HUGEINT) AS p FROM cells JOIN v USING (lang)),
q AS (SELECT lang, term, CAST(1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS HUGEINT) AS q FROM langs JOIN v USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
    "op13_filter_interaction": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [('A', len(w) < 200), ('B', 100 * len(list_distinct(w)) < 50 * len(w)), ('C', 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t)),
('D', regexp_matches(t, '[#$%&*|]')), ('E', coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false))] AS f FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, list_transform(list_filter(f, lambda x: x[2]), lambda x: x[1]) AS fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM m GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o), z AS (SELECT *, filter_order[step] AS f, len(list_filter(fails, lambda y: instr(filter_order, y) < step)) > 0 AS earlier FROM s, c),
r AS (SELECT part, filter_order, step, f, sum(n) FILTER (NOT earlier AND NOT list_contains(fails, f)) AS kept, sum(n) FILTER (NOT earlier AND list_contains(fails, f)) AS removed, sum(n) FILTER (earlier AND list_contains(fails, f)) AS redundant,
sum(n) FILTER (fails = [f]) AS unique_fails, sum(good) FILTER (NOT earlier AND list_contains(fails, f)) AS good_lost, sum(toxic) FILTER (NOT earlier AND list_contains(fails, f)) AS toxic_lost FROM z GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley FROM r""",
}
