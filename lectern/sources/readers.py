"""Scans with explicit schemas.  Text columns are read as text and typed by try_cast; missing markers become null at the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import number, positive, percent, whole
from ..functions.text import collapse, name_key, nullif_blank
from ..plans.values import SKIPPED, SOURCES

#: Texts that stand for a missing value in the CSV inputs.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

#: Columns of the five persisted tables.
PEOPLE = ("name", "department", "rating", "num_ratings", "would_take_again_pct", "level_of_difficulty", "professor_url")
REVIEWS = ("professor_name", "department", "overall_rating", "course", "quality", "difficulty", "date", "tags", "attendance", "grade", "textbook", "online_class", "comment")
SECTIONS = ("courseId", "schoolCode", "termId", "termTitle", "instructorId", "termEndDate", "instructorFirstName", "instructorLastName", "departmentName", "enrollment", "displayName", "section")
SCORES = ("courseId", "instructorId", "termId", "enrollment", "completed", "question", "count_5", "count_4", "count_3", "count_2", "count_1", "mean", "median", "std_dev")
COMMENTS = ("course_url", "question", "comment")


def text_schema(columns: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def na_normalise(df: DataFrame) -> DataFrame:
    """Missing markers of all text columns become null."""
    return df.select(*(F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes))


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A CSV with header, quotes doubled inside quotes and line breaks in quoted text; every column as text."""
    return na_normalise(spark.read.schema(text_schema(columns)).option("header", True).option("multiLine", True).option("escape", '"').csv(path))


def read_numbered_csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """read_csv with row_id, the row's number in the order of the files' names and then of their lines, however Spark deals the
    files to tasks: a file with quoted line breaks is read by one task, whose counter rises along it."""
    raw = spark.read.schema(text_schema(columns)).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = sorted(r.f for r in raw.select(F.col("_metadata.file_path").alias("f")).distinct().collect())  # names of files
    place = spark.createDataFrame(list(enumerate(names)), "place long, file string")
    in_task = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = raw.select("*", F.col("_metadata.file_path").alias("file"), in_task.alias("at"))
    joined = rows.join(F.broadcast(place), "file") if len(names) > 1 else rows.withColumn("place", F.lit(0).cast("long"))
    return na_normalise(joined.select((F.shiftleft("place", 33) + F.col("at")).alias("row_id"), *columns))


def with_row_id(df: DataFrame) -> DataFrame:
    """A row number in the order in which df is read: unique, increasing along the scan.  For tables of one file or in memory;
    read_numbered_csv numbers several files."""
    return df.withColumn("row_id", F.monotonically_increasing_id())


def people(raw: DataFrame) -> DataFrame:
    """Typed entities of source A: rows without a readable rating and count are dropped."""
    out = raw.select(
        "row_id", collapse(F.col("name")).alias("name"), "department", number(F.col("rating")).alias("rating"), number(F.col("num_ratings")).alias("n"),
        percent(F.col("would_take_again_pct")).alias("again"), positive(number(F.col("level_of_difficulty"))).alias("difficulty"), F.col("professor_url").alias("url"),
    )
    out = out.na.drop(subset=["rating", "n"]).withColumn("num_ratings", F.col("n").cast("bigint")).drop("n")
    return out.withColumn("key", name_key(F.col("name")))


def sections(raw: DataFrame) -> DataFrame:
    """Typed sections of source B with the person's key; the key is null where both names are missing."""
    full = F.concat_ws(" ", "instructorFirstName", "instructorLastName")
    ids = [F.col(c).try_cast("bigint").alias(c) for c in ("courseId", "instructorId", "termId", "enrollment")]
    return raw.select("row_id", *ids, "termTitle", F.to_date(F.try_to_timestamp("termEndDate", F.lit("yyyy-MM-dd"))).alias("ends"), F.col("departmentName").alias("department"), "displayName", "section", nullif_blank(name_key(full)).alias("key"))


def scores(raw: DataFrame) -> DataFrame:
    """Typed answers of source B, one row for each section and question."""
    ids = [F.col(c).try_cast("bigint").alias(c) for c in ("courseId", "instructorId", "termId")]
    counts = [whole(F.col(c)).alias(c) for c in ("enrollment", "completed", "count_5", "count_4", "count_3", "count_2", "count_1")]
    return raw.select("row_id", *ids, *counts, "question", number(F.col("mean")).alias("mean_stored"), number(F.col("median")).alias("median"), number(F.col("std_dev")).alias("std_dev"))


def valid_keys(raw: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are all readable numbers; other columns may be anything."""
    return raw.select(*(F.col(c).try_cast("bigint").alias(c) if c in keys else F.col(c) for c in raw.columns)).na.drop(subset=keys)


def report_list(sections: DataFrame, base: str, now: Column, months: int | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
    """The reports worth reading: sections with readable ids, ended within the window, the first `limit` of them as stored, with
    the address of each report."""
    from ..functions.numbers import read_date, report_url
    from ..operators.core import date_window

    good = valid_keys(sections, ["courseId", "instructorId", "termId"])
    good = date_window(good.withColumn("ends", read_date(F.col("termEndDate"))), F.col("ends"), now, months, skip)
    some = good if limit is None else good.orderBy("row_id").limit(limit)
    return some.select("row_id", "courseId", "instructorId", "termId", report_url(base, F.col("courseId"), F.col("instructorId"), F.col("termId")).alias("url"))


# ---------------------------------------------------------------- recorded pages of nested extracts

ENTITY_NODE = "struct<id:string,legacyId:bigint,firstName:string,lastName:string,department:string,school:struct<id:string,legacyId:bigint,name:string>,avgRating:double,numRatings:bigint,avgDifficulty:double,wouldTakeAgainPercent:double,teacherRatingTags:array<struct<tagName:string,tagCount:bigint>>>"
ENTITY_PAGE = f"data struct<search:struct<teachers:struct<didFallback:boolean,edges:array<struct<cursor:string,node:{ENTITY_NODE}>>,pageInfo:struct<hasNextPage:boolean,endCursor:string>,resultCount:bigint>>>"
REVIEW_NODE = "struct<comment:string,class:string,date:string,qualityRating:bigint,difficultyRatingRounded:bigint,ratingTags:string,grade:string,isForOnlineClass:boolean,attendanceMandatory:string,textbookIsUsed:boolean>"
REVIEW_PAGE = f"data struct<node:struct<ratings:struct<edges:array<struct<node:{REVIEW_NODE}>>,pageInfo:struct<hasNextPage:boolean,endCursor:string>>>>"


def entity_rows(pages: DataFrame, json: str, base_url: str, school: int | None = None) -> DataFrame:
    """Entities of recorded pages: one row for each node; other schools' nodes go (a missing school stays)."""
    node = pages.select(F.from_json(json, ENTITY_PAGE).alias("p")).select(F.explode("p.data.search.teachers.edges.node").alias("n"))
    if school is not None:
        node = node.where(F.col("n.school.legacyId").isNull() | (F.col("n.school.legacyId") == school))
    full = F.trim(F.concat_ws(" ", F.trim("n.firstName"), F.trim("n.lastName")))
    again = F.when(F.coalesce(F.col("n.wouldTakeAgainPercent"), F.lit(-1.0)) >= 0, F.concat(F.bround("n.wouldTakeAgainPercent").cast("bigint").cast("string"), F.lit("%")))
    return node.select(
        full.alias("name"), F.col("n.department").alias("department"), F.coalesce(F.col("n.avgRating").cast("string"), F.lit("N/A")).alias("rating"), F.coalesce(F.col("n.numRatings").cast("string"), F.lit("N/A")).alias("num_ratings"),
        again.alias("would_take_again_pct"), F.coalesce(F.col("n.avgDifficulty").cast("string"), F.lit("N/A")).alias("level_of_difficulty"),
        F.when(F.col("n.legacyId").isNotNull(), F.concat(F.lit(base_url), F.col("n.legacyId").cast("string"))).alias("professor_url"), F.col("n.id").alias("node_id"), top_tags(F.col("n.teacherRatingTags")).alias("tags"),
    )


def top_tags(tags: Column, most: int = 10) -> Column:
    """Names of the most frequent tags, ties by name."""
    by = lambda a, b: F.when(a["tagCount"] > b["tagCount"], -1).when(a["tagCount"] < b["tagCount"], 1).when(a["tagName"] < b["tagName"], -1).when(a["tagName"] > b["tagName"], 1).otherwise(0)
    return F.transform(F.slice(F.array_sort(tags, by), 1, most), lambda t: t["tagName"])


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").when(~flag, "No")


def review_rows(pages: DataFrame, json: str, parent: str) -> DataFrame:
    """Reviews of recorded pages with the parent's column; parents without reviews give none."""
    node = pages.select(parent, F.from_json(json, REVIEW_PAGE).alias("p")).select(parent, F.explode("p.data.node.ratings.edges.node").alias("n"))
    attendance = F.col("n.attendanceMandatory")
    return node.select(
        parent, collapse(F.col("n.comment")).alias("comment"), F.col("n.class").alias("course"), F.col("n.date").alias("date"), F.col("n.qualityRating").cast("string").alias("quality"), F.col("n.difficultyRatingRounded").cast("string").alias("difficulty"),
        collapse(F.col("n.ratingTags")).alias("tags"), F.col("n.grade").alias("grade"), yes_no(F.col("n.isForOnlineClass")).alias("online_class"), yes_no(F.col("n.textbookIsUsed")).alias("textbook"),
        F.when(F.lower(attendance) == "mandatory", "Mandatory").when(F.lower(attendance).isin("non mandatory", "non-mandatory"), "Not Mandatory").otherwise(attendance).alias("attendance"),
    )


def known_source(key: str) -> tuple[int, str]:
    """(id, name) of a known source: the id is the `school` of entity_rows."""
    if key not in SOURCES:
        raise ValueError(f"unknown source {key!r}; known are {', '.join(SOURCES)}")
    return SOURCES[key]


def page_numbers(spark: SparkSession, total: int, per_page: int) -> DataFrame:
    """The pages that a source of `total` rows has, as its first page's count tells."""
    return spark.range(1, -(-total // per_page) + 1).toDF("page")


def page_errors(pages: DataFrame, json: str) -> DataFrame:
    """pages with the first error that each names (message, null where none), whether it has data all the same, and whether the
    error says that a field is unknown, so that the page is to be asked for again with fewer fields: narrow."""
    found = F.from_json(json, "errors array<struct<message:string>>")["errors"]
    message = F.get(found, F.lit(0))["message"]
    data = F.get_json_object(json, "$.data")
    return pages.select("*", message.alias("message"), (data.isNotNull() & (data != "null")).alias("has_data"), F.coalesce(F.contains(message, F.lit("Cannot query field")), F.lit(False)).alias("narrow"))


def worth_fetching(people: DataFrame, count: str = "num_ratings", node: str = "node_id") -> DataFrame:
    """Parents whose children are worth a scan: with a node and a count that is neither missing nor zero."""
    return people.where(F.col(node).isNotNull() & ~F.coalesce(F.col(count), F.lit("0")).isin("0", "N/A", ""))


# ---------------------------------------------------------------- report grids and comment pages

def numbers_of(cells: Column) -> Column:
    return F.filter(F.transform(cells, lambda c: c.try_cast("double")), lambda v: v.isNotNull())


def first_count(cells: Column) -> Column:
    """The first number of at least one in a row of cells, fractions cut off."""
    return F.get(F.filter(numbers_of(cells), lambda v: v >= 1), F.lit(0)).cast("bigint")


def grid_rows(cells: DataFrame) -> DataFrame:
    """(report_id, row_idx, col_idx, value) -> report_id, row_idx, label, cells."""
    rows = cells.groupBy("report_id", "row_idx").agg(F.sort_array(F.collect_list(F.struct("col_idx", "value"))).alias("c"))
    return rows.select("report_id", "row_idx", F.trim(F.get("c.value", F.lit(0))).alias("label"), F.slice("c.value", F.lit(2), F.size("c.value")).alias("cells"))


def grid_scores(cells: DataFrame, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """Questions of report grids: rows with at least six numbers whose label is not skipped; the report's last enrollment and
    completed counts stand on every row."""
    from ..operators.core import last_value_of

    rows = grid_rows(cells)
    low = F.lower("label")
    value = first_count(F.col("cells"))
    rows = rows.withColumn("enrollment", last_value_of(value, F.startswith(low, F.lit("enrollment")) & value.isNotNull(), "row_idx", "report_id"))
    rows = rows.withColumn("completed", last_value_of(value, F.startswith(low, F.lit("completed")) & value.isNotNull(), "row_idx", "report_id"))
    skip = F.exists(F.array(*map(F.lit, skipped)), lambda s: F.startswith(low, s))
    n = numbers_of(F.col("cells"))
    good = rows.withColumn("v", n).where((F.col("label") != "") & ~skip & (F.size("v") >= 6))
    counts = [F.get("v", F.lit(i)).cast("bigint").alias(f"count_{5 - i}") for i in range(5)]
    return good.select("report_id", "row_idx", "enrollment", "completed", F.col("label").alias("question"), *counts, F.get("v", F.lit(5)).alias("mean"), F.get("v", F.lit(6)).alias("median"), F.get("v", F.lit(7)).alias("std_dev"))


def html_items(pages: DataFrame, page: str, html: str) -> DataFrame:
    """page, pos, text of the links inside list items of regular markup: no Python."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<li[^>]*>\s*<a[^>]*>(.*?)</a>"), F.lit(1))
    return pages.select(page, F.posexplode(found).alias("pos", "raw")).select(page, "pos", collapse(F.regexp_replace("raw", "<[^>]*>", "")).alias("text"))
