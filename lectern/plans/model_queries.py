"""The read model's own queries, run over raw tables that the star-schema tables give, and exports of its parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import core as O
from ..sources import readers as R
from ..sources import sinks as S
from ..sources.scratch import scratch
from ..sources.udtf import comment_rows
from . import read_model as M
from .catalog import Query, Tables, long
from .model_inputs import raw

#: A person whom both sources know under names of different length, and one with most reviews.
LINKED, SLUG, REVIEWED = "jo k40", "jo-k40", "zoe k4"


_GOLD: dict[tuple[str, str], str] = {}


def model(spark: SparkSession, d: str) -> M.Model:
    """The model of a folder's tables: its gold tables are built once in an application and read from then on."""
    at = (spark.sparkContext.applicationId, d)
    if at not in _GOLD:
        path = scratch(spark, "gold")
        M.build(*(raw(spark, d, n) for n in ("people", "reviews", "sections", "scores", "comments")), path=path)
        _GOLD[at] = path
    return M.open_model(spark, _GOLD[at])


def model_people(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).people.select("row_id", "name", "key", "num_ratings", "rating", "again", "difficulty", "college", "matched_key", "b_department", "b_rating", "b_count", "total", "avg_rating")


def model_leaders(spark: SparkSession, d: str) -> DataFrame:
    return M.leaderboard(model(spark, d), "Science", 10, 3)


def model_leaders_lenient(spark: SparkSession, d: str) -> DataFrame:
    return M.leaderboard(model(spark, d), "Law", 5)


def model_stats(spark: SparkSession, d: str) -> DataFrame:
    return M.stats(model(spark, d))


def model_colleges(spark: SparkSession, d: str) -> DataFrame:
    return M.colleges(model(spark, d))


def model_random(spark: SparkSession, d: str) -> DataFrame:
    return M.random_person(model(spark, d), 7)


def model_search_people(spark: SparkSession, d: str) -> DataFrame:
    """Three searches: a first name, the middle of a last one, and one character, which finds nothing."""
    m = model(spark, d)
    return reduce(DataFrame.unionByName, (M.search(m, q, "professor", 25).withColumn("q", F.lit(q)) for q in ("JOSÉ", "k1", "k")))


def model_search_courses(spark: SparkSession, d: str) -> DataFrame:
    m = model(spark, d)
    return reduce(DataFrame.unionByName, (M.search(m, q, "course", 25).withColumn("q", F.lit(q)) for q in ("acct1", "10", "topic 3")))


def model_slugs(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).slugs


def profile_head(spark: SparkSession, d: str) -> DataFrame:
    found = M.profile(model(spark, d), SLUG)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return found.select("key", "name", "dept", "rating_a", "rating_b", "avg_rating", "again", "difficulty", "total", "url", size("courses").alias("n_courses"), size("reviews").alias("n_reviews"), size("comments").alias("n_comments"))


def profile_courses(spark: SparkSession, d: str) -> DataFrame:
    """Sections of a profile in their order, with the figures of their questions."""
    found = M.profile(model(spark, d), SLUG).select(F.posexplode("courses").alias("place", "c"))
    scores = F.transform("c.scores", lambda q: F.concat_ws(":", q["question"], q["count_5"], q["count_1"], q["median"], q["completed"]))
    return found.select(long(F.col("place")).alias("place"), "c.courseId", "c.termId", "c.term", "c.name", "c.section", "c.enrollment", F.array_join(scores, ",").alias("scores"))


def profile_comments(spark: SparkSession, d: str) -> DataFrame:
    found = M.profile(model(spark, d), SLUG).select(F.explode("comments").alias("c"))
    return found.select("c.row_id", "c.courseId", "c.termId", "c.question", "c.comment")


def review_pages(spark: SparkSession, d: str) -> DataFrame:
    """A person's reviews in each order, of all courses and of one, as shown."""
    m = model(spark, d)
    pages = (M.reviews(m, REVIEWED, c, mode).withColumns({"chosen": F.lit(c), "mode": F.lit(mode)}) for c in ("__all__", "click") for mode in O.REVIEW_ORDERS)
    return reduce(DataFrame.unionByName, pages).withColumn("tags", F.array_join("tags", "|"))


def grade_shares(spark: SparkSession, d: str) -> DataFrame:
    return M.grades(model(spark, d), REVIEWED).select("grade", "n", "percent", long(F.col("place")).alias("place"))


def report_list(spark: SparkSession, d: str) -> DataFrame:
    """Reports to read: of sections with readable ids that ended in a window, the first hundred."""
    rows = raw(spark, d, "sections")
    broken = rows.withColumn("instructorId", F.when(F.col("row_id") % 7 != 0, F.col("instructorId")).otherwise("x1"))
    return R.report_list(broken, "https://x/coursereport", F.lit("1998-06-01").cast("date"), 36, 3, 100).drop("row_id")


def malformed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Events whose ids are readable numbers, where every seventh is not."""
    rows = Tables(spark, d).events.select(F.when(F.col("event_id") % 7 == 3, F.concat(F.lit("e"), "event_id")).otherwise(F.col("event_id").cast("string")).alias("event_id"), F.when(F.col("event_id") % 5 != 2, F.col("user_id").cast("string")).alias("user_id"), "event_type")
    return R.valid_keys(rows, ["event_id", "user_id"])


def _entity_pages(spark: SparkSession, d: str) -> DataFrame:
    """Customers as recorded pages of twenty: every third of another source, some without ids, counts or tags."""
    c = F.col("c_custkey")
    tag = lambda i: F.struct(F.concat(F.lit("tag "), ((c * i) % 13).cast("string")).alias("tagName"), ((c + 3 * i) % 5).alias("tagCount"))
    node = F.struct(
        F.when(c % 10 != 4, F.concat(F.lit("n"), c)).alias("id"), F.when(c % 8 != 1, c).alias("legacyId"), F.concat(F.col("c_mktsegment"), F.lit(" ")).alias("firstName"), F.when(c % 6 != 0, F.col("c_name")).alias("lastName"), F.lit("D").alias("department"),
        F.struct(F.when(c % 3 == 0, F.lit(580)).when(c % 3 == 1, F.lit(399)).alias("legacyId")).alias("school"), F.when(c % 4 != 0, (c % 50) / 10).alias("avgRating"), F.when(c % 7 != 0, c % 3).alias("numRatings"), ((c % 40) / 10).alias("avgDifficulty"),
        F.when(c % 5 == 0, F.lit(-1.0)).otherwise((c % 202) / 2).alias("wouldTakeAgainPercent"), F.array(*(tag(i) for i in range(1, 13))).alias("teacherRatingTags"),
    )
    pages = Tables(spark, d).customer.groupBy(F.floor(c / 20).alias("page")).agg(F.collect_list(F.struct(node.alias("node"))).alias("edges"))
    return pages.select("page", F.to_json(F.struct(F.struct(F.struct(F.struct("edges").alias("teachers")).alias("search")).alias("data"))).alias("body"))


def entity_pages(spark: SparkSession, d: str) -> DataFrame:
    """Entities of one known source; those whose children are worth a scan are marked."""
    people = R.entity_rows(_entity_pages(spark, d), "body", "https://x/", R.known_source("mit")[0])
    worth = R.worth_fetching(people).select("node_id").withColumn("worth", F.lit(True))
    return people.join(worth, "node_id", "left").select("name", "rating", "num_ratings", "would_take_again_pct", "level_of_difficulty", "professor_url", "node_id", F.array_join("tags", "|").alias("tags"), F.coalesce("worth", F.lit(False)).alias("worth"))


def error_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with and without errors and data, by what is to be done with them."""
    k = F.col("o_orderkey")
    errors = F.when(k % 3 == 0, F.array(F.struct(F.when(k % 2 == 0, 'Cannot query field "x"').otherwise("Too many requests").alias("message"))))
    data = F.when(k % 5 != 0, F.struct(k.alias("id")))
    pages = Tables(spark, d).orders.select("o_orderkey", F.to_json(F.struct(errors.alias("errors"), data.alias("data"))).alias("body"))
    return R.page_errors(pages, "body").groupBy("message", "has_data", "narrow").agg(F.count("*").alias("n"))


def page_plan(spark: SparkSession, d: str) -> DataFrame:
    """The pages of 500 rows that a source as large as the table of orders has."""
    return R.page_numbers(spark, Tables(spark, d).orders.count(), 500)


def _export(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with tags and at most three of their reviews, which are orders."""
    t = Tables(spark, d)
    s = F.col("s_suppkey")
    people = t.supplier.select(s.alias("row_id"), F.col("s_name").alias("name"), (s % 4).alias("num_ratings"), (F.col("s_acctbal") / 1000).alias("rating"), F.when(s % 3 != 0, (s % 101) / 2).otherwise(-1.0).alias("again"), ((s % 40) / 8).alias("difficulty"), F.array(F.lit("a"), F.concat(F.lit("b"), s)).alias("tags"))
    kids = t.orders.where("o_custkey < 300").select((F.col("o_custkey") % 97).alias("row_id"), F.col("o_orderkey").alias("order"), "o_orderstatus")
    return S.capped(S.nest(people, kids, "row_id", ["order"], "reviews"), "reviews", 3)


def export_rows(spark: SparkSession, d: str) -> DataFrame:
    return S.export_rows(_export(spark, d))


def export_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts, and means as sums would give them: to nine decimals."""
    return S.export_summary(_export(spark, d)).select("total", "with_ratings", "without_ratings", "with_reviews", "n_reviews", *(F.round(c, 9).alias(c) for c in ("rating", "difficulty", "again")))


def export_document(spark: SparkSession, d: str) -> DataFrame:
    """The nested document, written as JSON text and read back."""
    path = scratch(spark, "document")
    made = S.export_document(_export(spark, d).select("row_id", "name", "num_ratings", "reviews"), "people", {"source": F.lit("mit")})
    S.document(made).write.text(path)
    kind = "source string, total bigint, with_ratings bigint, with_reviews bigint, n_reviews bigint, people array<struct<row_id bigint, name string, num_ratings bigint, reviews array<struct<`order` bigint, o_orderstatus string>>>>"
    back = spark.read.text(path).select(F.from_json("value", kind).alias("v")).select("v.*")
    each = back.select("source", "total", "with_ratings", "with_reviews", "n_reviews", F.posexplode("people").alias("place", "p"))
    return each.select("source", "total", "with_ratings", "with_reviews", "n_reviews", long(F.col("place")).alias("place"), "p.name", F.array_join(F.transform("p.reviews", lambda r: F.concat(r["order"].cast("string"), r["o_orderstatus"])), ",").alias("reviews"))


def comment_pages(spark: SparkSession, d: str) -> DataFrame:
    """Comment tables in HTML, one page for each order."""
    o = F.col("o_orderkey").cast("string")
    row = lambda *cells: F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells), F.lit("</tr>"))
    body = F.concat(row(F.lit("1"), F.concat(F.lit("<a href='#'>said \n "), o, F.lit("</a> more"))), row(F.lit("2"), F.concat(F.lit("plain &amp; "), "o_orderpriority")), row(F.lit("3"), F.lit(" ")))
    html = F.concat(F.lit("<html><table class='x table'><th><strong>Q: What of "), o, F.lit("?</strong></th><tbody>"), body, F.lit("</tbody></table><table><tr><td>1</td><td>no</td></tr></table></html>"))
    return comment_rows(Tables(spark, d).orders.select(F.concat(F.lit("https://x/"), o).alias("course_url"), html.alias("html")))


def append_stream(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of an incremental append, the second over files that hold rows of the first again."""
    from ..streaming.appends import append_new

    rows = Tables(spark, d).events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    source, target, state = (scratch(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    for part in ("event_id % 2 = 0", "event_id % 2 = 1 or event_id % 4 = 0"):
        rows.where(part).coalesce(1).write.mode("append").parquet(source)
        append_new(spark, source, rows.schema, ["event_id"], "ts", target, state, "400 days").awaitTermination()
    return spark.read.schema(rows.schema).parquet(target).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def date_display(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 5 == 0, "some day").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return Tables(spark, d).orders.select("o_orderkey", N.show_date(text).alias("shown"))


def exact_rounding(spark: SparkSession, d: str) -> DataFrame:
    """Rounding on binary values: quarters and eighths, which are ties, and hundredths with a five behind, which are none."""
    rows = Tables(spark, d).lineitem.select((F.col("l_orderkey") % 1000).alias("k")).distinct()
    k = F.col("k")
    return rows.select("k", N.round_binary(F.when(k % 3 == 0, k / 8).when(k % 3 == 1, k / 200).otherwise(k / 7), 2).alias("rounded"))


def review_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Attributes as shown, questions without their mark, and addresses of reports there and back."""
    k = F.col("o_orderkey")
    word = F.element_at(F.array(*map(F.lit, ("Yes", "true", "no", "Mandatory", "N/A", "", "false"))), (k % 7 + 1).cast("int"))
    url = N.report_url("https://x/report", k % 50, k, k % 9)
    back = N.url_key(url)
    asked = X.strip_question(F.concat(F.when(k % 2 == 0, "Q: ").otherwise(""), F.lit("Why? Q: "), k.cast("string")))
    return Tables(spark, d).orders.select("o_orderkey", *(X.attribute(F.when(k % 11 != 0, word), c).alias(c) for c in X.ATTRIBUTES), asked.alias("asked"), url.alias("url"), back["course"].alias("course"), back["person"].alias("person"), back["term"].alias("term"))


MODEL_QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        model_people, model_leaders, model_leaders_lenient, model_stats, model_colleges, model_random, model_search_people, model_search_courses, model_slugs, profile_head, profile_courses, profile_comments, review_pages, grade_shares,
        report_list, malformed_rows, entity_pages, error_pages, page_plan, export_rows, export_summary, export_document, comment_pages, append_stream, date_display, exact_rounding, review_attributes,
    )
}
