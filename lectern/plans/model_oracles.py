"""The read model's queries in SQL over the same raw tables, for comparison."""

from __future__ import annotations

from .model_inputs import select
from .oracles import _FOLD, _SLUG
from .values import GRADES, NO_GRADE


def rounded(x: str, digits: int) -> str:
    """SQL of numbers.round_binary of a double column."""
    ten, high = f"1e{digits}", f"({x} * 134217729e0 - ({x} * 134217729e0 - {x}))"
    product, near = f"({x} * {ten})", f"round_even({x} * {ten}, 0)"
    lacks = f"(({high} * {ten} - {product}) + ({x} - {high}) * {ten})"
    return f"CASE WHEN {product} - {near} = 0.5 AND {lacks} > 0 THEN {near} + 1 WHEN {product} - {near} = -0.5 AND {lacks} < 0 THEN {near} - 1 ELSE {near} END / {ten}"


_NUM = "CASE WHEN {0} NOT IN ('N/A', '') THEN try_cast({0} AS DOUBLE) END"
_MODEL = f"""a AS (SELECT row_id, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name, {_FOLD.format(x="name")} AS key, department, {_NUM.format("rating")} AS rating, CAST({_NUM.format("num_ratings")} AS BIGINT) AS num_ratings,
  CASE WHEN try_cast(replace(would_take_again_pct, '%', '') AS DOUBLE) >= 0 THEN try_cast(replace(would_take_again_pct, '%', '') AS DOUBLE) END AS again,
  CASE WHEN try_cast(level_of_difficulty AS DOUBLE) > 0 THEN try_cast(level_of_difficulty AS DOUBLE) END AS difficulty, professor_url AS url FROM ({select("people")}) WHERE {_NUM.format("rating")} IS NOT NULL AND {_NUM.format("num_ratings")} IS NOT NULL),
s AS MATERIALIZED (SELECT row_id, CAST(courseId AS BIGINT) AS c, CAST(instructorId AS BIGINT) AS i, CAST(termId AS BIGINT) AS t, CAST(enrollment AS BIGINT) AS enrollment, termTitle, displayName, section, departmentName AS department,
  nullif({_FOLD.format(x="concat_ws(' ', instructorFirstName, instructorLastName)")}, '') AS key FROM ({select("sections")})),
q AS MATERIALIZED (SELECT row_id, CAST(courseId AS BIGINT) AS c, CAST(instructorId AS BIGINT) AS i, CAST(termId AS BIGINT) AS t, question, coalesce(try_cast(completed AS BIGINT), 0) AS completed, CAST(median AS DOUBLE) AS median,
  {", ".join(f"CAST(count_{k} AS BIGINT) AS n{k}" for k in range(1, 6))} FROM ({select("scores")})),
one AS (SELECT * FROM s WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY c, i, t, key ORDER BY row_id) = 1),
names AS (SELECT DISTINCT c, i, key FROM one),
asked AS (SELECT * FROM q WHERE contains(lower(question), 'overall') QUALIFY row_number() OVER (PARTITION BY c, i, t, question ORDER BY row_id) = 1),
rate AS (SELECT key, CAST(sum(n1 + 2 * n2 + 3 * n3 + 4 * n4 + 5 * n5) AS DOUBLE) / CAST(sum(n1 + n2 + n3 + n4 + n5) AS DOUBLE) AS b_rating FROM asked JOIN names USING (c, i) WHERE n1 + n2 + n3 + n4 + n5 > 0 GROUP BY key),
done AS (SELECT c, i, t, completed FROM q QUALIFY row_number() OVER (PARTITION BY c, i, t ORDER BY row_id) = 1),
cnt AS (SELECT key, CAST(sum(completed) AS BIGINT) AS b_count FROM one JOIN done ON one.c = done.c AND one.i = done.i AND one.t IS NOT DISTINCT FROM done.t GROUP BY key),
dep AS (SELECT key, department AS b_department FROM one QUALIFY row_number() OVER (PARTITION BY key ORDER BY t DESC NULLS LAST, row_id) = 1),
b AS MATERIALIZED (SELECT dep.key, b_department, b_rating, b_count FROM dep LEFT JOIN rate USING (key) LEFT JOIN cnt USING (key)),
near AS (SELECT a.row_id, min(b.key) AS near FROM a JOIN b ON split_part(a.key, ' ', -1) = split_part(b.key, ' ', -1) AND contains(a.key, ' ') AND contains(b.key, ' ')
  AND (starts_with(split_part(a.key, ' ', 1), split_part(b.key, ' ', 1)) OR starts_with(split_part(b.key, ' ', 1), split_part(a.key, ' ', 1))) WHERE a.key NOT IN (SELECT key FROM b) GROUP BY a.row_id),
l0 AS (SELECT a.*, coalesce(e.key, near) AS matched_key FROM a LEFT JOIN b e ON a.key = e.key LEFT JOIN near USING (row_id)),
l1 AS (SELECT l0.*, b_department, b_rating, coalesce(b_count, 0) AS b_count, num_ratings + coalesce(b_count, 0) AS total, num_ratings > 0 AND rating > 0 AS has_a, b_rating IS NOT NULL AND coalesce(b_count, 0) > 0 AS has_b,
  CASE department WHEN 'Computer Science' THEN 'Khoury' WHEN 'Physics' THEN 'Science' WHEN 'Law' THEN 'Law' WHEN 'Music' THEN 'CAMD' ELSE 'Other' END AS college FROM l0 LEFT JOIN b ON matched_key = b.key),
l2 AS (SELECT *, CASE WHEN has_a AND has_b THEN (rating + b_rating) / 2 WHEN has_b THEN b_rating WHEN has_a THEN rating ELSE 0e0 END AS blend FROM l1),
l AS MATERIALIZED (SELECT *, {rounded("blend", 2)} AS avg_rating FROM l2),
card AS (SELECT row_id, name, coalesce(b_department, department) AS dept, CASE WHEN has_a THEN {rounded("rating", 2)} END AS rating_a, CASE WHEN has_b THEN {rounded("b_rating", 2)} END AS rating_b, avg_rating, num_ratings AS reviews_a, b_count AS reviews_b, total, url, college FROM l),
first AS (SELECT key, department AS b_department, row_id FROM s WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY row_id) = 1),
both_ AS (SELECT key, name, b_department, avg_rating, total, 0 AS priority, row_id FROM l UNION ALL
  SELECT f.key, list_aggregate(list_transform(regexp_extract_all(f.key, '([a-z]+|[^a-z]+)', 1), lambda x: upper(left(x, 1)) || substring(x, 2)), 'string_agg', ''), f.b_department, {rounded("b_rating", 2)}, coalesce(b_count, 0), 1, row_id FROM first f LEFT JOIN b USING (key) WHERE f.key NOT IN (SELECT key FROM l)),
people_index AS (SELECT * FROM both_ WHERE b_department IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY priority, row_id) = 1),
course_index AS (SELECT row_id, regexp_extract(displayName, '^([A-Z]+\\d+):\\d+\\s+\\((.+?)\\)', 1) AS code, regexp_extract(displayName, '^([A-Z]+\\d+):\\d+\\s+\\((.+?)\\)', 2) AS title, department FROM s
  WHERE regexp_matches(displayName, '^([A-Z]+\\d+):\\d+\\s+\\((.+?)\\)') QUALIFY row_number() OVER (PARTITION BY code ORDER BY row_id) = 1),
rev AS (SELECT *, {_FOLD.format(x="professor_name")} AS key FROM ({select("reviews")})),
com AS (SELECT row_id, CAST(regexp_extract(course_url, '(?:sp=|x/)(\\d+)', 1) AS BIGINT) AS c, CAST(regexp_extract(course_url, '(?:sp=|x/)\\d+(?:&sp=|/)(\\d+)', 1) AS BIGINT) AS i, CAST(regexp_extract(course_url, '(\\d+)$', 1) AS BIGINT) AS t, question, comment
  FROM ({select("comments")}) WHERE trim(comment) <> ''),
mine AS (SELECT * FROM s WHERE key = (SELECT matched_key FROM l WHERE key = 'jo k40') QUALIFY row_number() OVER (PARTITION BY c, i, t ORDER BY row_id) = 1)"""


def _friendly(x: str) -> str:
    return f"CASE WHEN {x} < 100 THEN CAST({x} AS VARCHAR) ELSE format('{{:,}}', CAST(floor({x} / 100) * 100 AS BIGINT)) || '+' END"


_STATS = " UNION ALL ".join(
    f"SELECT '{label}' AS label, {_friendly('v')} AS value FROM ({sql})"
    for label, sql in (
        ("Professors", "SELECT count(*) AS v FROM (SELECT key FROM a UNION SELECT key FROM s) WHERE trim(key) <> ''"), ("Courses", "SELECT count(DISTINCT upper(split_part(displayName, ':', 1))) AS v FROM s"),
        ("Evaluations", "SELECT CAST((SELECT sum(completed) FROM done) + (SELECT count(*) FROM rev) AS BIGINT) AS v"), ("Departments", "SELECT count(DISTINCT lower(trim(department))) AS v FROM s"),
    )
)


def _people_search(q: str, folded: str) -> str:
    tier = f"CASE WHEN list_contains(string_split(key, ' '), '{folded}') THEN 1 WHEN len(list_filter(string_split(key, ' '), lambda w: starts_with(w, '{folded}'))) > 0 THEN 2 WHEN contains(key, '{folded}') THEN 3 END"
    limit = 25 if len(folded) >= 2 else 0
    return f"SELECT * FROM (SELECT 'professor' AS type, name, b_department AS dept, CASE WHEN avg_rating > 0 THEN avg_rating END AS rating, '{q}' AS q FROM (SELECT *, {tier} AS tier FROM people_index) WHERE tier IS NOT NULL ORDER BY tier, total DESC, priority, row_id LIMIT {limit})"


def _course_search(q: str) -> str:
    tier = f"CASE WHEN starts_with(lower(code), '{q}') THEN 1 WHEN contains(lower(code), '{q}') THEN 2 WHEN contains(lower(title), '{q}') THEN 3 END"
    return f"SELECT * FROM (SELECT 'course' AS type, code, title AS name, department AS dept, '{q}' AS q FROM (SELECT *, {tier} AS tier FROM course_index) WHERE tier IS NOT NULL ORDER BY tier, row_id LIMIT 25)"


_ATTRIBUTES = {"attendance": ("Mandatory", "Mandatory", "Not Mandatory"), "textbook": ("Yes", "Yes", "No"), "online_class": ("Yes", "Online", "In-Person")}


def _attributes(x: str) -> str:
    """SQL of the three attributes as shown, of the column or expression x (with the attribute's name where it has {})."""
    return ", ".join(f"CASE WHEN coalesce({x.format(c)}, '') IN ('', 'N/A') THEN NULL WHEN {x.format(c)} IN ('true', '{yes}') THEN '{shown}' ELSE '{other}' END AS {c}" for c, (yes, shown, other) in _ATTRIBUTES.items())


def _reviews(course: str, mode: str, order: str) -> str:
    return f"""SELECT * FROM (SELECT row_id, course, CASE WHEN d IS NULL THEN date ELSE strftime(d, '%B %-d, %Y') END AS date, quality, CASE WHEN grade <> 'N/A' THEN grade END AS grade, {_attributes("{}")},
  array_to_string(list_filter(list_transform(string_split(tags, ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags, comment, '{course}' AS chosen, '{mode}' AS mode
  FROM (SELECT * REPLACE (try_cast(quality AS DOUBLE) AS quality), try_cast(date AS DATE) AS d FROM rev WHERE key = 'zoe k4' AND '{course}' IN ('__all__', course)) ORDER BY {order} NULLS LAST, row_id LIMIT 10)"""


_EXPORT = """k AS (SELECT row_id, o AS "order", st FROM (SELECT o_custkey % 97 AS row_id, o_orderkey AS o, o_orderstatus AS st FROM orders WHERE o_custkey < 300) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY o) <= 3),
n AS (SELECT row_id, count(*) AS n, string_agg("order" || st, ',' ORDER BY "order") AS reviews FROM k GROUP BY row_id),
e AS (SELECT s_suppkey AS row_id, s_name AS name, s_suppkey % 4 AS num_ratings, s_acctbal / 1000 AS rating, CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey % 101) / 2 ELSE -1e0 END AS again, (s_suppkey % 40) / 8 AS difficulty,
  coalesce(n, 0) AS n, coalesce(reviews, '') AS reviews FROM supplier LEFT JOIN n ON s_suppkey = n.row_id)"""
_SHOWN = "CASE WHEN {0} < 0 THEN 'N/A' ELSE printf('%.1f', floor({0} * 10 + 0.5) / 10) END"
_QUOTED = lambda xs: ", ".join(f"'{x}'" for x in xs)

MODEL_SQL: dict[str, str] = {
    "model_people": f"WITH {_MODEL} SELECT row_id, name, key, num_ratings, rating, again, difficulty, college, matched_key, b_department, b_rating, b_count, total, avg_rating FROM l",
    "model_leaders": f"WITH {_MODEL}, r AS (SELECT *, row_number() OVER (ORDER BY avg_rating DESC NULLS LAST, total DESC, row_id) AS rank FROM card WHERE college = 'Science' AND reviews_a >= 3 AND reviews_b >= 3 AND rating_b IS NOT NULL) SELECT * EXCLUDE (row_id, college) FROM r WHERE rank <= 10",
    "model_leaders_lenient": f"WITH {_MODEL}, r AS (SELECT *, row_number() OVER (ORDER BY avg_rating DESC NULLS LAST, total DESC, row_id) AS rank FROM card WHERE college = 'Law' AND total >= 5) SELECT * EXCLUDE (row_id, college) FROM r WHERE rank <= 5",
    "model_stats": f"WITH {_MODEL} {_STATS}",
    "model_colleges": f"WITH {_MODEL} SELECT college FROM l WHERE college <> 'Other' GROUP BY college HAVING count(*) >= 5",
    "model_random": f"WITH {_MODEL} SELECT * EXCLUDE (row_id) FROM card WHERE reviews_a >= 3 ORDER BY md5('7:' || row_id), row_id LIMIT 1",
    "model_search_people": f"WITH {_MODEL} " + " UNION ALL ".join(_people_search(q, f) for q, f in (("JOSÉ", "jose"), ("k1", "k1"), ("k", "k"))),
    "model_search_courses": f"WITH {_MODEL} " + " UNION ALL ".join(map(_course_search, ("acct1", "10", "topic 3"))),
    "model_slugs": f"WITH {_MODEL}, g AS (SELECT *, {_SLUG.format(x='key')} AS slug FROM both_ WHERE key <> '') SELECT slug, key FROM g QUALIFY row_number() OVER (PARTITION BY slug ORDER BY priority, CASE WHEN priority = 0 THEN -row_id ELSE row_id END) = 1",
    "profile_head": f"""WITH {_MODEL} SELECT l.key, card.name, dept, rating_a, rating_b, card.avg_rating, {rounded("again", 1)} AS again, {rounded("difficulty", 2)} AS difficulty, card.total, card.url, (SELECT count(*) FROM mine) AS n_courses,
  (SELECT count(*) FROM rev WHERE key = 'jo k40') AS n_reviews, (SELECT count(*) FROM com WHERE EXISTS (SELECT 1 FROM mine m WHERE m.c = com.c AND m.i = com.i AND m.t IS NOT DISTINCT FROM com.t)) AS n_comments FROM l JOIN card USING (row_id) WHERE l.key = 'jo k40'""",
    "profile_courses": f"""WITH {_MODEL}, z AS (SELECT m.row_id, string_agg(question || ':' || n5 || ':' || n1 || ':' || CAST(coalesce(median, 0e0) AS VARCHAR) || ':' || completed, ',' ORDER BY q.row_id) AS scores FROM mine m JOIN q ON m.c = q.c AND m.i = q.i AND m.t IS NOT DISTINCT FROM q.t GROUP BY m.row_id)
SELECT row_number() OVER (ORDER BY t DESC NULLS LAST, row_id) - 1 AS place, c AS courseId, t AS termId, termTitle AS term, displayName AS name, section, enrollment, scores FROM mine LEFT JOIN z USING (row_id)""",
    "profile_comments": f"WITH {_MODEL} SELECT com.row_id, com.c AS courseId, com.t AS termId, question, comment FROM com WHERE EXISTS (SELECT 1 FROM mine m WHERE m.c = com.c AND m.i = com.i AND m.t IS NOT DISTINCT FROM com.t)",
    "review_pages": f"WITH {_MODEL} " + " UNION ALL ".join(_reviews(c, m, o) for c in ("__all__", "click") for m, o in (("newest", "d DESC"), ("oldest", "d"), ("highest", "quality DESC"), ("lowest", "quality"))),
    "grade_shares": f"""WITH {_MODEL}, g AS (SELECT grade, count(*) AS n FROM rev WHERE key = 'zoe k4' AND trim(grade) <> '' AND grade NOT IN ({_QUOTED(NO_GRADE)}) GROUP BY grade), p AS (SELECT *, CAST(n * 100.0 AS DOUBLE) / sum(n) OVER () AS percent FROM g)
SELECT grade, n, percent, CAST(list_position([{_QUOTED(GRADES)}], grade) AS BIGINT) AS place FROM p WHERE list_contains([{_QUOTED(GRADES)}], grade)""",
    "report_list": f"""SELECT CAST(courseId AS BIGINT) AS courseId, CAST(instructorId AS BIGINT) AS instructorId, CAST(termId AS BIGINT) AS termId, 'https://x/coursereport?sp=' || courseId || '&sp=' || instructorId || '&sp=' || termId AS url FROM ({select("sections")})
WHERE row_id % 7 <> 0 AND termId IS NOT NULL AND CAST(termEndDate AS DATE) BETWEEN DATE '1998-06-01' - 1080 AND DATE '1998-06-01' - 90 ORDER BY row_id LIMIT 100""",
    "malformed_rows": "SELECT event_id, user_id, event_type FROM events WHERE event_id % 7 <> 3 AND event_id % 5 <> 2",
    "entity_pages": """WITH g AS (SELECT c_custkey AS c, c_name, c_mktsegment, list_sort(list_transform(range(1, 13), lambda i: {'n': -((c_custkey + 3 * i) % 5), 't': 'tag ' || CAST((c_custkey * i) % 13 AS VARCHAR)}))[1:10] AS tags FROM customer WHERE c_custkey % 3 <> 1)
SELECT c_mktsegment || CASE WHEN c % 6 <> 0 THEN ' ' || c_name ELSE '' END AS name, CASE WHEN c % 4 <> 0 THEN CAST(CAST((c % 50) / 10 AS DOUBLE) AS VARCHAR) ELSE 'N/A' END AS rating, CASE WHEN c % 7 <> 0 THEN CAST(c % 3 AS VARCHAR) ELSE 'N/A' END AS num_ratings,
  CASE WHEN c % 5 <> 0 THEN CAST(CAST(round_even((c % 202) / 2, 0) AS BIGINT) AS VARCHAR) || '%' END AS would_take_again_pct, CAST(CAST((c % 40) / 10 AS DOUBLE) AS VARCHAR) AS level_of_difficulty, CASE WHEN c % 8 <> 1 THEN 'https://x/' || c END AS professor_url,
  CASE WHEN c % 10 <> 4 THEN 'n' || c END AS node_id, array_to_string(list_transform(tags, lambda x: x.t), '|') AS tags, c % 10 <> 4 AND c % 7 <> 0 AND c % 3 <> 0 AS worth FROM g""",
    "error_pages": """SELECT CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Cannot query field "x"' ELSE 'Too many requests' END END AS message, o_orderkey % 5 <> 0 AS has_data, o_orderkey % 6 = 0 AS narrow, count(*) AS n FROM orders GROUP BY ALL""",
    "page_plan": "SELECT unnest(range(1, CAST(ceil(count(*) / 500) AS BIGINT) + 1)) AS page FROM orders",
    "export_rows": f"WITH {_EXPORT} SELECT row_id, name, num_ratings, {_SHOWN.format('rating')} AS rating, {_SHOWN.format('again')} AS again, {_SHOWN.format('difficulty')} AS difficulty, 'a; b' || row_id AS tags FROM e",
    "export_summary": f"""WITH {_EXPORT} SELECT count(*) AS total, count(*) FILTER (num_ratings > 0) AS with_ratings, count(*) FILTER (num_ratings <= 0) AS without_ratings, count(*) FILTER (n > 0) AS with_reviews, CAST(sum(n) AS BIGINT) AS n_reviews,
  round(avg(rating) FILTER (num_ratings > 0), 9) AS rating, round(avg(difficulty) FILTER (num_ratings > 0), 9) AS difficulty, round(avg(again) FILTER (num_ratings > 0 AND again >= 0), 9) AS again FROM e""",
    "export_document": f"""WITH {_EXPORT}, t AS (SELECT count(*) AS total, count(*) FILTER (num_ratings > 0) AS with_ratings, count(*) FILTER (n > 0) AS with_reviews, CAST(sum(n) AS BIGINT) AS n_reviews FROM e)
SELECT 'mit' AS source, t.*, row_number() OVER (ORDER BY row_id) - 1 AS place, name, reviews FROM e, t""",
    "comment_pages": "SELECT 'https://x/' || o_orderkey AS course_url, 'What of ' || o_orderkey || '?' AS question, comment FROM (SELECT o_orderkey, unnest(['said ' || o_orderkey, 'plain & ' || o_orderpriority]) AS comment FROM orders)",
    "append_stream": "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type",
    "date_display": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'some day' ELSE strftime(o_orderdate, '%B %-d, %Y') END AS shown FROM orders",
    "exact_rounding": f"WITH v AS (SELECT DISTINCT l_orderkey % 1000 AS k FROM lineitem), x AS (SELECT k, CASE k % 3 WHEN 0 THEN k / 8 WHEN 1 THEN k / 200 ELSE k / 7 END AS x FROM v) SELECT k, {rounded('x', 2)} AS rounded FROM x",
    "review_attributes": f"""SELECT o_orderkey, {_attributes("CASE WHEN o_orderkey % 11 <> 0 THEN ['Yes', 'true', 'no', 'Mandatory', 'N/A', '', 'false'][o_orderkey % 7 + 1] END")}, 'Why? Q: ' || o_orderkey AS asked,
  'https://x/report?sp=' || (o_orderkey % 50) || '&sp=' || o_orderkey || '&sp=' || (o_orderkey % 9) AS url, o_orderkey % 50 AS course, o_orderkey AS person, o_orderkey % 9 AS term FROM orders""",
}
