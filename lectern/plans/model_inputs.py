"""The read model's five raw tables, made of the star-schema tables, as (source, columns) that both Spark SQL and other engines read.

Suppliers are people: source A knows all but every fourth, source B all but another fourth.  Names differ in accents, blanks and
length; some cells are missing or unreadable, as those of the model's inputs are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Sections are (supplier, line number, ship year) with their histogram of answers.
GROUPS = "SELECT l_suppkey AS s, l_linenumber AS line, CAST(year(l_shipdate) AS BIGINT) AS y, count(*) AS n, " + ", ".join(f"sum(CASE WHEN floor((l_quantity - 1) / 10) = {k - 1} THEN 1 ELSE 0 END) AS k{k}" for k in range(1, 6)) + " FROM lineitem WHERE l_suppkey % 4 <> 2 GROUP BY l_suppkey, l_linenumber, year(l_shipdate)"

_TEXT = "CAST({} AS STRING)".format
_FIRST = "CASE {0} % 5 WHEN 0 THEN 'Jo' WHEN 1 THEN 'José ' WHEN 2 THEN 'Ann Bea' WHEN 3 THEN 'Max' ELSE 'Zoë' END"
_NAME = f"{_FIRST} || ' K' || CAST({{0}} AS STRING)"
_COURSE = "CAST(line * 100 + s % 10 AS STRING)"
_SECTION = "s * 1000 + line * 10 + y - 1991"
_TERM = "CASE WHEN line = 7 THEN NULL ELSE CAST(y AS STRING) END"

SOURCES: dict[str, tuple[str, dict[str, str]]] = {
    "people": ("SELECT *, s_suppkey AS s FROM supplier WHERE s_suppkey % 4 <> 3", {
        "row_id": "s", "name": f"{_FIRST.format('s')} || ' K' || CAST(CASE WHEN s % 50 = 44 THEN s - 40 ELSE s END AS STRING)",
        "department": "CASE s % 6 WHEN 0 THEN 'Computer Science' WHEN 1 THEN 'Physics' WHEN 2 THEN 'Law' WHEN 3 THEN 'Music' WHEN 4 THEN 'Nowhere' END",
        "rating": "CASE s % 9 WHEN 0 THEN 'N/A' WHEN 1 THEN '0' ELSE CAST(1 + s % 4 AS STRING) || '.' || CAST(s % 10 AS STRING) || '25' END", "num_ratings": "CASE WHEN s % 17 = 16 THEN 'many' ELSE CAST(s % 23 AS STRING) END",
        "would_take_again_pct": "CASE s % 4 WHEN 0 THEN CAST((s * 7) % 101 AS STRING) || '.25%' WHEN 1 THEN '-1' END", "level_of_difficulty": _TEXT("s % 6"), "professor_url": "'https://x/' || CAST(s AS STRING)",
    }),
    "sections": (GROUPS, {
        "row_id": _SECTION, "courseId": _COURSE, "schoolCode": "'S'", "termId": _TERM, "termTitle": "'FALL ' || CAST(y + 20 AS STRING)", "instructorId": _TEXT("s"), "termEndDate": "CAST(y AS STRING) || '-12-01'",
        "instructorFirstName": "CASE WHEN s % 8 = 5 THEN NULL WHEN s % 5 = 0 THEN 'Josephine' WHEN s % 5 = 1 THEN 'JOSE' WHEN s % 5 = 2 THEN 'Ann' WHEN s % 5 = 3 THEN 'Max' ELSE 'Zoe' END",
        "instructorLastName": "CASE WHEN s % 8 = 5 THEN NULL WHEN s % 5 = 2 THEN 'Bea K' || CAST(s AS STRING) ELSE 'K' || CAST(s AS STRING) END",
        "departmentName": "CASE WHEN s % 7 = 3 THEN NULL ELSE 'Dept ' || CAST((s + y) % 9 AS STRING) END", "enrollment": _TEXT("n"),
        "displayName": f"CASE WHEN line = 6 THEN 'Plain label' ELSE 'ACCT' || {_COURSE} || ':0' || CAST(line AS STRING) || ' (Topic ' || CAST(s % 10 AS STRING) || ') - K' END", "section": "'01'",
    }),
    "scores": (f"SELECT * FROM ({GROUPS}) g CROSS JOIN (SELECT 0 AS q UNION ALL SELECT 1 AS q UNION ALL SELECT 2 AS q) w WHERE q < 2 OR s % 6 = 0", {
        "row_id": f"({_SECTION}) * 10 + q", "courseId": _COURSE, "instructorId": _TEXT("s"), "termId": _TERM, "enrollment": _TEXT("n"), "completed": "CASE WHEN s % 10 = 9 THEN 'N/A' ELSE CAST(n AS STRING) END",
        "question": "CASE WHEN q = 1 THEN 'Clarity' WHEN line % 2 = 1 THEN 'Overall rating' ELSE 'How OVERALL?' END", **{f"count_{k}": f"CAST(CASE WHEN q = 1 THEN k{6 - k} ELSE k{k} END AS STRING)" for k in (5, 4, 3, 2, 1)},
        "mean": "'0'", "median": "CASE WHEN q = 1 THEN NULL ELSE '3.5' END", "std_dev": "'1'",
    }),
    "reviews": ("SELECT *, user_id % 100 AS u FROM events", {
        "row_id": "event_id", "professor_name": f"upper({_NAME.format('u')})", "department": "'D'", "overall_rating": "'3'", "course": "event_type", "quality": "CASE WHEN event_id % 11 = 0 THEN 'N/A' ELSE CAST(event_id % 5 + 1 AS STRING) END",
        "difficulty": _TEXT("event_id % 4"), "date": "CASE WHEN event_id % 13 = 0 THEN 'someday' ELSE CAST(CAST(ts AS DATE) AS STRING) END", "tags": "CASE event_id % 3 WHEN 0 THEN 'Tough Grader, Caring,, ' WHEN 1 THEN 'Hilarious' END",
        "attendance": "CASE event_id % 3 WHEN 0 THEN 'Mandatory' WHEN 1 THEN 'no' END", "grade": "CASE event_id % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'B+' WHEN 2 THEN 'N/A' WHEN 3 THEN 'Not sure yet' WHEN 4 THEN 'C' WHEN 5 THEN 'A' ELSE 'Audit' END",
        "textbook": "CASE WHEN event_id % 2 = 0 THEN 'YES' ELSE 'No' END", "online_class": "'false'", "comment": "'c ' || CAST(event_id AS STRING)",
    }),
    "comments": ("SELECT o_orderkey AS o, o_custkey % 100 AS s, o_orderkey % 6 + 1 AS line, CAST(year(o_orderdate) AS BIGINT) AS y FROM orders", {
        "row_id": "o", "course_url": f"CASE WHEN o % 2 = 0 THEN 'https://x/coursereport?sp=' || {_COURSE} || '&sp=' || CAST(s AS STRING) || '&sp=' || CAST(y AS STRING) ELSE 'https://x/' || {_COURSE} || '/' || CAST(s AS STRING) || '/' || CAST(y AS STRING) END",
        "question": "'Best?'", "comment": "CASE WHEN o % 10 = 3 THEN '  ' ELSE 'said ' || CAST(o AS STRING) END",
    }),
}


def select(name: str) -> str:
    source, columns = SOURCES[name]
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM ({source}) t"


def raw(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The raw table, its rows numbered as its row_id says."""
    from ..sources.readers import na_normalise

    source, columns = SOURCES[name]
    for table in ("supplier", "lineitem", "events", "orders"):
        if f"FROM {table}" in source:
            source = source.replace(f"FROM {table}", f"FROM parquet.`{folder}/{table}.parquet`")
    rows = spark.sql(source).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))
    return na_normalise(rows.withColumn("row_id", rows["row_id"].cast("bigint")))
