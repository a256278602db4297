"""The same queries in SQL over the same tables, for comparison."""

from __future__ import annotations

_ANSWERS = "ans AS (SELECT l_suppkey AS person, l_linenumber AS line, CAST(year(l_shipdate) AS INTEGER) AS term, CAST(1 + floor((l_quantity - 1) / 10) AS INTEGER) AS k FROM lineitem)"
_B = f"{_ANSWERS}, b AS (SELECT person, CAST(sum(k) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS b_rating, CAST(count(*) AS BIGINT) AS b_count FROM ans GROUP BY person)"
_BLEND = f"""{_B},
a AS (SELECT s_suppkey AS person, s_name AS name, s_nationkey, CAST(CASE WHEN s_acctbal > 0 THEN 1 + floor(s_acctbal / 2500) ELSE 0 END AS DOUBLE) AS a_rating,
  CAST(CASE WHEN s_acctbal > 0 THEN s_suppkey % 40 ELSE 0 END AS BIGINT) AS a_count FROM supplier),
bl AS (SELECT a.*, b_rating, coalesce(b_count, 0) AS b_count, CASE WHEN a_count > 0 AND a_rating > 0 AND b_rating IS NOT NULL AND b_count > 0 THEN (a_rating + b_rating) / 2
  WHEN b_rating IS NOT NULL AND b_count > 0 THEN b_rating WHEN a_count > 0 AND a_rating > 0 THEN a_rating ELSE 0.0 END AS avg_rating,
  CAST(a_count + coalesce(b_count, 0) AS BIGINT) AS total FROM a LEFT JOIN b USING (person))"""
_FOLD = "trim(regexp_replace(regexp_replace(strip_accents(lower(trim({x}))), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g'))"
_SLUG = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"
_LABEL = """'ACCT' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN ':0' || (p_partkey % 7) || ' (' || p_name || ') - P' WHEN 1 THEN ' (' || p_name || ')' ELSE ' plain text' END"""
_FRIENDLY = "CASE WHEN o_orderkey < 100 THEN CAST(o_orderkey AS VARCHAR) ELSE format('{:,}', CAST(floor(o_orderkey / 100) * 100 AS BIGINT)) || '+' END"

SQL: dict[str, str] = {
    "csv_roundtrip_scan": "SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents GROUP BY lang",
    "coerce_clean": """WITH r AS (SELECT event_id, value, CASE WHEN event_id % 7 <> 0 THEN regexp_extract(props, '"k": *(-?[0-9.]+)', 1) END AS raw FROM events)
SELECT event_id, try_cast(raw AS DOUBLE) AS k, CAST(trunc(try_cast(raw AS DOUBLE)) AS BIGINT) AS k_or_0, CASE WHEN try_cast(raw AS DOUBLE) >= 0 THEN try_cast(raw AS DOUBLE) END AS pct,
  CASE WHEN value > 0 THEN value END AS pos FROM r WHERE try_cast(raw AS DOUBLE) IS NOT NULL""",
    "nested_page_flatten": "SELECT conv_id, role, CAST(turn AS VARCHAR) AS quality, CASE WHEN turn % 2 = 0 THEN 'Yes' ELSE 'No' END AS online_class, CAST(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS BIGINT) AS chars FROM conversations",
    "cell_grid_scan": """SELECT o_orderkey AS report_id, 3 AS row_idx, CAST(o_orderkey % 50 + 1 AS BIGINT) AS enrollment, CAST(nullif(o_orderkey % 20, 0) AS BIGINT) AS completed, 'How clear was it?' AS question,
  CAST(k AS BIGINT) AS count_5, CAST(k + 1 AS BIGINT) AS count_4, CAST(k + 2 AS BIGINT) AS count_3, CAST(k + 3 AS BIGINT) AS count_2, CAST(k + 4 AS BIGINT) AS count_1,
  CAST(k + 5 AS DOUBLE) AS mean, CAST(k + 6 AS DOUBLE) AS median, CAST(k + 7 AS DOUBLE) AS std_dev FROM (SELECT *, o_orderkey % 11 AS k FROM orders)""",
    "html_extract": """WITH f AS (SELECT page_id, regexp_extract_all(html, '(?is)<li[^>]*>\\s*<a[^>]*>(.*?)</a>', 1) AS xs FROM pages),
e AS (SELECT page_id, i - 1 AS pos, xs[i] AS raw FROM (SELECT page_id, xs, unnest(range(1, len(xs) + 1)) AS i FROM f))
SELECT page_id, CAST(pos AS BIGINT) AS pos, trim(regexp_replace(regexp_replace(raw, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS text FROM e""",
    "append_sink": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "nested_export": "SELECT o_orderkey, o_orderstatus, count(*) AS n, sum(l_quantity) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL",
    "category_counts": """SELECT CASE n_regionkey WHEN 0 THEN 'Arts' WHEN 1 THEN 'Business' WHEN 2 THEN 'Science' ELSE 'Health' END AS college, count(*) AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey BETWEEN 0 AND 3 GROUP BY 1 HAVING count(*) >= 5""",
    "score_bands": """WITH r AS (SELECT CASE WHEN l_linenumber <> 7 THEN l_quantity / 10 END AS k, l_quantity - 25 AS q FROM lineitem)
SELECT CASE WHEN k IS NULL THEN 'neutral' WHEN k >= 4 THEN 'high' WHEN k >= 3 THEN 'mid' ELSE 'low' END AS score,
  CASE WHEN k IS NULL THEN 'neutral' WHEN k <= 2 THEN 'high' WHEN k <= 3 THEN 'mid' ELSE 'low' END AS difficulty, count(*) AS n, CAST(sum(CAST(trunc(least(greatest(q, 0.0), 5.0) / 5.0 * 100) AS BIGINT)) AS BIGINT) AS pct FROM r GROUP BY 1, 2""",
    "histogram_mean": f"WITH {_ANSWERS} SELECT person, line, term, count(*) AS n, CAST(sum(k) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean FROM ans GROUP BY ALL",
    "date_window": """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 9 <> 0
  AND CAST(o_orderdate AS DATE) BETWEEN DATE '1998-01-01' - 720 AND DATE '1998-01-01' - 90""",
    "weighted_mean_join": f"WITH {_B} SELECT s_name, b_rating, b_count FROM b JOIN supplier ON person = s_suppkey",
    "prefix_link": """WITH l AS (SELECT p_partkey, left(split_part(p_name, ' ', 1), 3) AS f, split_part(p_name, ' ', -1) AS g FROM part WHERE p_name LIKE '% %'),
n AS (SELECT DISTINCT p_name FROM part), m AS (SELECT * FROM l WHERE f || ' ' || g NOT IN (SELECT p_name FROM n))
SELECT p_partkey, min(p_name) AS linked FROM m JOIN n ON split_part(p_name, ' ', -1) = g AND p_name LIKE '% %' AND (starts_with(f, split_part(p_name, ' ', 1)) OR starts_with(split_part(p_name, ' ', 1), f)) GROUP BY p_partkey""",
    "blend_rating": f"WITH {_BLEND} SELECT person, CASE WHEN a_count > 0 THEN a_rating END AS a_rating, CASE WHEN b_count > 0 THEN b_rating END AS b_rating, avg_rating, total FROM bl",
    "leaderboard": f"""WITH {_BLEND} SELECT row_number() OVER (ORDER BY avg_rating DESC NULLS LAST, total DESC, name) AS rank, name, n_name AS category, avg_rating, a_count, b_count, total
FROM bl JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' AND a_count >= 3 AND b_count >= 3 AND b_rating IS NOT NULL ORDER BY rank LIMIT 10""",
    "leaderboard_lenient": f"""WITH {_BLEND} SELECT row_number() OVER (ORDER BY avg_rating DESC NULLS LAST, total DESC, name) AS rank, name, n_name AS category, avg_rating, a_count, b_count, total
FROM bl JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AFRICA' AND total >= 5 ORDER BY rank LIMIT 10""",
    "random_row": f"""WITH {_BLEND} SELECT person, name FROM bl WHERE a_count >= 3 ORDER BY md5('42:' || person), person LIMIT 1""",
    "review_orders": " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS course, '{mode}' AS mode, event_id, event_type, value FROM events WHERE '{c}' IN ('__all__', event_type) ORDER BY {order} NULLS LAST, event_id LIMIT 10 OFFSET 10)"
        for c in ("click", "__all__") for mode, order in (("newest", "ts DESC"), ("oldest", "ts"), ("highest", "value DESC"), ("lowest", "value"))
    ),
    "search_index": f"""WITH a AS (SELECT *, 0 AS priority FROM supplier WHERE s_suppkey % 2 = 0), b AS (SELECT *, 1 AS priority FROM supplier WHERE s_name NOT IN (SELECT s_name FROM a)),
u AS (SELECT *, {_FOLD.format(x="replace(s_name, '#', ' ')")} AS key FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE s_nationkey <> 7),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY priority, s_suppkey) AS rn FROM u) SELECT s_suppkey, priority, key, {_SLUG.format(x="key")} AS slug FROM r WHERE rn = 1""",
    "search_person": """WITH t AS (SELECT p_partkey, p_name AS name, p_size AS total, CASE WHEN list_contains(string_split(lower(p_name), ' '), 'gear') THEN 1
  WHEN len(list_filter(string_split(lower(p_name), ' '), lambda w: starts_with(w, 'gear'))) > 0 THEN 2 WHEN contains(lower(p_name), 'gear') THEN 3 END AS tier FROM part)
SELECT * FROM t WHERE tier IS NOT NULL ORDER BY tier, total DESC, p_partkey LIMIT 20""",
    "search_code": """WITH p AS (SELECT p_partkey, lower(p_type) || ' ' || lower(p_brand) AS code, lower(p_name) AS title FROM part),
t AS (SELECT p_partkey, CASE WHEN starts_with(code, 'ring') THEN 1 WHEN contains(code, 'ring') THEN 2 WHEN contains(title, 'ring') THEN 3 END AS tier,
  CASE WHEN starts_with(code, 'pro') THEN 1 WHEN contains(code, 'pro') THEN 2 WHEN contains(title, 'pro') THEN 3 END AS prefix FROM p)
SELECT tier, prefix, count(*) AS n, min(p_partkey) AS first FROM t GROUP BY tier, prefix""",
    "review_list": "SELECT event_id, event_type, value FROM events WHERE event_type = 'click' ORDER BY ts DESC NULLS LAST, event_id LIMIT 10 OFFSET 10",
    "course_list": "SELECT event_type, min(event_id) AS first_row FROM events GROUP BY event_type",
    "profile_nested": f"""WITH {_ANSWERS}, h AS (SELECT person, line, term, count(*) AS completed, sum(k) AS ws FROM ans GROUP BY ALL),
s AS (SELECT person, count(*) AS n_sections, string_agg(term || ':' || line || ':' || completed || ':' || ws, ',' ORDER BY term DESC, line) AS sections FROM h GROUP BY person),
c AS (SELECT CAST(regexp_extract(url, '(\\d+)', 1) AS BIGINT) % 100 + 1 AS person, count(*) AS n_comments FROM pages WHERE regexp_extract(url, '(\\d+)', 1) <> '' GROUP BY 1)
SELECT s.person, n_sections, sections, coalesce(n_comments, 0) AS n_comments FROM s LEFT JOIN c ON s.person = c.person""",
    "fixed_histogram": f"""WITH {_ANSWERS}, d AS (SELECT unnest([6, 5, 4, 3, 2, 1]) AS bucket), c AS (SELECT k, count(*) AS n FROM ans GROUP BY k),
j AS (SELECT bucket, coalesce(n, 0) AS n FROM d LEFT JOIN c ON bucket = k) SELECT CAST(bucket AS BIGINT) AS bucket, n, CAST(n * 100.0 AS DOUBLE) / greatest(max(n) OVER (), 1) AS bar FROM j""",
    "ordered_share": """WITH r AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE o_orderpriority END AS priority FROM orders),
c AS (SELECT priority, count(*) AS n FROM r WHERE trim(priority) <> '' AND priority <> '4-NOT SPECIFIED' GROUP BY priority), s AS (SELECT *, CAST(n * 100.0 AS DOUBLE) / sum(n) OVER () AS percent FROM c)
SELECT priority, n, percent, CAST(list_position(['5-LOW', '3-MEDIUM', '1-URGENT'], priority) AS BIGINT) AS place FROM s WHERE list_contains(['5-LOW', '3-MEDIUM', '1-URGENT'], priority)""",
    "stats": """SELECT 'codes' AS label, count(DISTINCT upper(split_part(p_brand, ':', 1))) AS value FROM part
UNION ALL SELECT 'people', count(*) FROM (SELECT s_name AS n FROM supplier UNION SELECT c_name FROM customer) WHERE trim(n) <> ''
UNION ALL SELECT 'answers', count(*) FROM lineitem UNION ALL SELECT 'departments', count(DISTINCT lower(trim(p_type))) FROM part""",
    "group_terms": """WITH r AS (SELECT o_orderpriority, year(o_orderdate) + 10 AS y, (month(o_orderdate) + 2) // 3 AS s FROM orders),
g AS (SELECT o_orderpriority, y, s, count(*) AS n FROM r GROUP BY ALL)
SELECT o_orderpriority, CAST(sum(n) AS BIGINT) AS n, string_agg(['Spring', 'Summer', 'Fall', 'Winter'][s] || ' ' || y, ',' ORDER BY y DESC, s DESC) AS terms FROM g GROUP BY o_orderpriority""",
    "summary_report": """SELECT count(*) AS total, count(*) FILTER (c_acctbal > 0) AS rated, CAST(sum(CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal) AS BIGINT) END) AS BIGINT) AS units,
  count(*) FILTER (c_mktsegment = 'BUILDING') AS building FROM customer""",
    "top_and_bottom": """WITH n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) >= 5)
SELECT * FROM (SELECT *, 'top' AS side FROM n ORDER BY n DESC, c_nationkey LIMIT 10) UNION ALL SELECT * FROM (SELECT *, 'bottom' AS side FROM n ORDER BY n, c_nationkey LIMIT 10)""",
    "latest_per_key": """WITH r AS (SELECT l_suppkey, l_linenumber, l_orderkey * 100000 + l_partkey AS row_id, year(l_shipdate) AS y FROM lineitem),
t AS (SELECT l_suppkey, l_linenumber, CASE WHEN row_id % 5 <> 0 THEN CAST(y AS BIGINT) END AS term, row_id FROM r),
w AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY term DESC NULLS LAST, row_id) AS rn FROM t) SELECT l_suppkey, l_linenumber, term, row_id FROM w WHERE rn = 1""",
    "text_keys": f"WITH k AS (SELECT doc_id, {_FOLD.format(x="text")} AS key FROM documents) SELECT doc_id, key, {_SLUG.format(x='key')} AS slug FROM k",
    "title_keys": """SELECT p_partkey, list_aggregate(list_transform(regexp_extract_all(lower(p_name || '-' || p_brand), '([a-z]+|[^a-z]+)', 1), lambda x: upper(left(x, 1)) || substring(x, 2)), 'string_agg', '') AS title FROM part""",
    "code_parse": f"""WITH l AS (SELECT p_partkey, {_LABEL} AS label FROM part)
SELECT p_partkey, nullif(regexp_extract(label, '^([A-Z]+\\d+):\\d+\\s+\\((.+?)\\)', 1), '') AS code, nullif(regexp_extract(label, '^([A-Z]+\\d+):\\d+\\s+\\((.+?)\\)', 2), '') AS title,
  coalesce(nullif(regexp_extract(label, '^([A-Z]+\\d+)(?::\\d+)?\\s*\\(', 1), ''), split_part(split_part(label, ':', 1), ' ', 1)) AS lenient, nullif(regexp_extract(label, '\\((.+?)\\)', 1), '') AS brackets FROM l""",
    "formatters": f"""WITH f AS (SELECT *, {_FRIENDLY} AS friendly FROM orders)
SELECT o_orderkey, friendly, CAST(regexp_extract(replace(friendly, ',', ''), '^(\\d+)', 1) AS BIGINT) AS parsed, CAST(round_even((o_orderkey % 200) / 2, 0) AS BIGINT) || '%' AS pct, base64(encode('School-' || o_orderkey)) AS id64,
  list_aggregate(list_transform(string_split(lower(o_orderpriority) || ' ' || o_orderstatus, ' '), lambda x: left(x, 1)), 'string_agg', '') AS initials, lower(regexp_replace(o_orderpriority, '[^a-zA-Z0-9]', '_', 'g')) AS file FROM f""",
    "tag_split": """WITH h AS (SELECT doc_id, replace(text, '. ', '--') AS x FROM documents), t AS (SELECT doc_id, list_filter(list_transform(string_split(x, '--'), lambda y: trim(y)), lambda y: y <> '') AS a,
  list_filter(list_transform(string_split(x, ','), lambda y: trim(y)), lambda y: y <> '') AS b FROM h)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_dashed, CAST(len(b) AS BIGINT) AS n_comma, array_to_string(b, '|') AS tags FROM t""",
}
