"""The read model: two independent sources of ratings linked by name, and the queries over them.

build() declares everything from the five raw tables; write() stores the gold tables as Parquet, open_model() reads them back,
and the queries read only those.  Divergences from a literal reading of the inputs are listed in the README.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import core as O
from ..sources import readers as R
from . import values as V


def college_of(department: Column) -> Column:
    """College of a department by its exact name; unknown and missing are Other."""
    known = F.create_map(*(F.lit(x) for kv in V.COLLEGE_OF.items() for x in kv))
    return F.coalesce(F.try_element_at(known, department), F.lit(V.OTHER))


@dataclass
class Model:
    """Gold tables: people (A with B's figures), sections, scores, comments, reviews, person_index, course_index, slugs."""

    people: DataFrame
    sections: DataFrame
    scores: DataFrame
    reviews: DataFrame
    comments: DataFrame
    person_index: DataFrame
    course_index: DataFrame
    slugs: DataFrame

    def write(self, path: str) -> None:
        for f in fields(self):
            write_gold(getattr(self, f.name), path, f.name)


LOOKUP = {"people": ["key"], "source_b": ["key"], "sections": ["key"], "scores": ["courseId", "instructorId"], "reviews": ["key"], "comments": ["courseId", "instructorId"], "person_index": ["key"], "course_index": ["code"], "slugs": ["slug"]}


def write_gold(df: DataFrame, path: str, name: str) -> DataFrame:
    """df as a gold table, read back: rows of one key in one file, and each file sorted by key, so that a lookup reads the row
    groups that may hold it."""
    order = [*LOOKUP[name], *(["row_id"] if "row_id" in df.columns else [])]
    df.repartition(*LOOKUP[name]).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/{name}")
    return df.sparkSession.read.parquet(f"{path}/{name}")


def open_model(spark: SparkSession, path: str) -> Model:
    return Model(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(Model)})


SECTION = ["courseId", "instructorId", "termId"]


def same_section(a: DataFrame, b: DataFrame) -> Column:
    """Sections match on all three ids; a missing term matches a missing term."""
    return (a["courseId"] == b["courseId"]) & (a["instructorId"] == b["instructorId"]) & a["termId"].eqNullSafe(b["termId"])


def source_b(sections: DataFrame, scores: DataFrame) -> DataFrame:
    """key, b_rating, b_count, b_department of every person of source B."""
    one = O.keep_first(sections.where("key is not null"), [*SECTION, "key"], [F.col("row_id")])
    names = one.select("courseId", "instructorId", "key").distinct()
    counts = {k: F.col(f"count_{k}") for k in N.ANSWERS}
    asked = O.keep_first(scores.where(F.contains(F.lower("question"), F.lit("overall"))), [*SECTION, "question"], [F.col("row_id")])
    sums = asked.select("courseId", "instructorId", N.answer_sum(counts).alias("ws"), N.answer_count(counts).alias("n")).where("n > 0")
    rating = sums.join(names, ["courseId", "instructorId"]).groupBy("key").agg((F.sum("ws").cast("double") / F.sum("n").cast("double")).alias("b_rating"))
    done = O.keep_first(scores, SECTION, [F.col("row_id")]).select(*SECTION, "completed")
    met = one.join(done, same_section(one, done)).select("key", done["completed"])
    count = met.groupBy("key").agg(F.coalesce(F.sum("completed"), F.lit(0)).alias("b_count"))
    department = O.latest(one, ["key"], "termId", "row_id").select("key", F.col("department").alias("b_department"))
    return department.join(rating, "key", "left").join(count, "key", "left")


def link(people: DataFrame, b: DataFrame) -> DataFrame:
    """people with matched_key and B's columns: the same key, else the prefix link."""
    near = O.prefix_link(people.select("row_id", "key"), b.select(F.col("key").alias("near")), "row_id", "key", "near")
    exact = people.join(b.select(F.col("key").alias("exact")), people["key"] == F.col("exact"), "left").join(near, "row_id", "left")
    keyed = exact.withColumn("matched_key", F.coalesce("exact", "near")).drop("exact", "near")
    return keyed.join(b.withColumnRenamed("key", "matched_key"), "matched_key", "left")


def build(people: DataFrame, reviews: DataFrame, sections: DataFrame, scores: DataFrame, comments: DataFrame, path: str | None = None) -> Model:
    """The model of five raw tables of text columns, each with row_id in file order.  With a path, every table is written there as
    soon as it is made and read by the ones that follow from it, so none is computed twice."""

    def kept(name: str, df: DataFrame) -> DataFrame:
        return df if path is None else write_gold(df, path, name)

    a, s, q = R.people(people), kept("sections", R.sections(sections)), kept("scores", R.scores(scores))
    b = kept("source_b", source_b(s, q))
    linked = link(a, b).withColumn("b_count", F.coalesce("b_count", F.lit(0))).withColumn("college", college_of(F.col("department")))
    linked = linked.withColumn("total", F.col("num_ratings") + F.col("b_count")).withColumn("avg_rating", N.round_binary(N.blend(F.col("rating"), F.col("num_ratings"), F.col("b_rating"), F.col("b_count")), 2))
    linked = kept("people", linked)
    b_first = O.keep_first(s.where("key is not null"), ["key"], [F.col("row_id")]).select("key", F.col("department").alias("b_department"), "row_id")
    known = linked.select("key", "name", F.col("b_department"), "rating", "avg_rating", "total", F.lit(0).alias("priority"), "row_id")
    only = b_first.join(linked.select("key"), "key", "left_anti").join(b.select("key", "b_rating", "b_count"), "key", "left")
    only = only.select("key", X.title_case(F.col("key")).alias("name"), "b_department", F.lit(None).cast("double").alias("rating"), N.round_binary(F.col("b_rating"), 2).alias("avg_rating"), F.coalesce("b_count", F.lit(0)).alias("total"), F.lit(1).alias("priority"), "row_id")
    both = known.unionByName(only)
    index = O.keep_first(both.where("b_department is not null"), ["key"], [F.col("priority"), F.col("row_id")])
    # A's later rows overwrite earlier ones, B's rows only fill gaps
    slug = both.where("key <> ''").withColumn("slug", X.slug(F.col("key")))
    order = F.when(F.col("priority") == 0, -F.col("row_id")).otherwise(F.col("row_id"))
    slugs = O.keep_first(slug, ["slug"], [F.col("priority"), order]).select("slug", "key")
    parsed = s.select("row_id", X.parse_course(F.col("displayName")).alias("c"), "department").select("row_id", "c.code", "c.title", "department").where("code is not null")
    courses = O.keep_first(parsed, ["code"], [F.col("row_id")])
    typed = comments.select("row_id", N.url_key(F.col("course_url")).alias("k"), "question", "comment").select("row_id", F.col("k.course").alias("courseId"), F.col("k.person").alias("instructorId"), F.col("k.term").alias("termId"), "question", "comment")
    typed = typed.where(X.collapse(F.col("comment")) != "")
    rated = reviews.withColumn("key", X.name_key(F.col("professor_name")))
    return Model(linked, s, q, kept("reviews", rated), kept("comments", typed), kept("person_index", index), kept("course_index", courses), kept("slugs", slugs))


# ---------------------------------------------------------------- queries


def stats(m: Model) -> DataFrame:
    """label, value: people, courses, evaluations and departments as friendly counts."""
    names = m.people.select("key").union(m.sections.select("key")).where("trim(key) <> ''").distinct().agg(F.count("*").alias("v"))
    courses = m.sections.agg(F.countDistinct(F.upper(X.course_code(F.col("displayName")))).alias("v"))
    done = O.keep_first(m.scores, SECTION, [F.col("row_id")]).agg(F.coalesce(F.sum("completed"), F.lit(0)).alias("c"))
    evaluations = done.crossJoin(F.broadcast(m.reviews.agg(F.count("*").alias("r")))).select((F.col("c") + F.col("r")).alias("v"))  # one row each
    departments = m.sections.agg(F.countDistinct(F.lower(F.trim("department"))).alias("v"))
    out = None
    for label, df in (("Professors", names), ("Courses", courses), ("Evaluations", evaluations), ("Departments", departments)):
        row = df.select(F.lit(label).alias("label"), N.friendly_count(F.col("v")).alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def colleges(m: Model, least: int = 5) -> DataFrame:
    return O.value_counts(m.people, "college").where((F.col("n") >= least) & (F.col("college") != V.OTHER)).select("college").orderBy("college")


def shown_ratings() -> tuple[Column, Column]:
    """Both sources' ratings as they are shown: A's only with a count and a rating above 0, B's only with a count."""
    a = F.when((F.col("num_ratings") > 0) & (F.col("rating") > 0), N.round_binary(F.col("rating"), 2))
    b = F.when((F.col("b_count") > 0) & F.col("b_rating").isNotNull(), N.round_binary(F.col("b_rating"), 2))
    return a, b


def _card(df: DataFrame) -> DataFrame:
    a, b = shown_ratings()
    return df.select(
        "name", F.coalesce("b_department", "department").alias("dept"), a.alias("rating_a"), b.alias("rating_b"), "avg_rating",
        F.col("num_ratings").alias("reviews_a"), F.col("b_count").alias("reviews_b"), "total", "url", "college", *(c for c in ("rank",) if c in df.columns),
    )


def leaderboard(m: Model, college: str, limit: int = 10, min_reviews: int = 10) -> DataFrame:
    """The best-rated people of a college with their rank.  Lenient colleges ask for five answers in all, the others for min_reviews
    of each source."""
    if college in V.LENIENT:
        good = F.col("total") >= 5
    else:
        good = (F.col("num_ratings") >= min_reviews) & (F.col("b_count") >= min_reviews) & F.col("b_rating").isNotNull()
    rows = m.people.where((F.col("college") == college) & good)
    return _card(O.ranked(rows, [F.desc_nulls_last("avg_rating"), F.desc("total"), F.col("row_id")], limit)).drop("college")


def random_person(m: Model, seed: int, least: int = 3) -> DataFrame:
    """One person with at least so many ratings of source A; none if there is none."""
    return _card(O.random_row(m.people.where(F.col("num_ratings") >= least), "row_id", seed))


def reviews(m: Model, key: str, course: str = "__all__", mode: str = "newest", offset: int = 0, limit: int = 10) -> DataFrame:
    """A page of a person's reviews; dates that cannot be read come last."""
    mine = m.reviews.where(F.col("key") == key)
    when = F.coalesce(N.read_date(F.col("date")).cast("timestamp"), F.try_to_timestamp("date"))
    found = O.review_page(mine, F.col("course"), when, N.number(F.col("quality")), "row_id", course, mode, offset, limit)
    shown = [X.attribute(F.col(c), c).alias(c) for c in X.ATTRIBUTES]
    return found.select("row_id", "course", N.show_date(F.col("date")).alias("date"), N.number(F.col("quality")).alias("quality"), "grade", *shown, X.split_tags(F.col("tags"), ",").alias("tags"), "comment")


def grades(m: Model, key: str) -> DataFrame:
    """Shares of the grades that a person's reviews name, in their order; texts that stand for none are left out."""
    return O.ordered_share(m.reviews.where(F.col("key") == key), "grade", list(V.GRADES), list(V.NO_GRADE))


def search(m: Model, query: str, kind: str = "professor", limit: int = 3) -> DataFrame:
    """Tiered matches; queries of under two characters find nothing.  Terms are literal, not patterns."""
    q = " ".join(query.lower().split())
    if kind == "course":
        found = O.tiered_top(m.course_index, O.code_tests(F.lower("code"), F.lower("title"), q), [F.col("row_id")], limit if len(q) >= 2 else 0)
        return found.select(F.lit("course").alias("type"), "code", F.col("title").alias("name"), F.col("department").alias("dept"))
    q = m.people.sparkSession.range(1).select(X.name_key(F.lit(query)).alias("q")).first().q  # folded as names are
    found = O.tiered_top(m.person_index, O.name_tests(F.col("key"), q), [F.desc("total"), F.col("priority"), F.col("row_id")], limit if len(q) >= 2 else 0)
    return found.select(F.lit("professor").alias("type"), "name", F.col("b_department").alias("dept"), F.when(F.col("avg_rating") > 0, N.round_binary(F.col("avg_rating"), 2)).alias("rating"))


def profile(m: Model, slug: str) -> DataFrame:
    """One nested row of a person, or none: scalars, courses with scores (newest term first), reviews, comments."""
    text = F.lit(" ".join(slug.lower().strip().replace("-", " ").split()))
    key = m.slugs.sparkSession.range(1).join(m.slugs.where(F.col("slug") == slug.lower().strip()), F.lit(True), "left").select(F.coalesce("key", text).alias("key"))
    a = O.keep_first(m.people.join(F.broadcast(key), "key"), ["key"], [F.col("row_id")])
    shown_a, shown_b = shown_ratings()
    a = a.select("key", F.coalesce("matched_key", "key").alias("b_key"), "name", F.coalesce("b_department", "department").alias("dept"), shown_a.alias("rating_a"), shown_b.alias("rating_b"), "avg_rating", N.round_binary(F.col("again"), 1).alias("again"), N.round_binary(F.col("difficulty"), 2).alias("difficulty"), "total", "url", F.lit(0).alias("priority"))
    b = m.person_index.where("priority = 1").join(F.broadcast(key), "key")
    b = b.select("key", F.col("key").alias("b_key"), "name", F.col("b_department").alias("dept"), F.lit(None).cast("double").alias("rating_a"), F.col("avg_rating").alias("rating_b"), "avg_rating", F.lit(None).cast("double").alias("again"), F.lit(None).cast("double").alias("difficulty"), "total", F.lit(None).cast("string").alias("url"), "priority")
    head = O.keep_first(a.unionByName(b), ["key"], [F.col("priority")]).drop("priority")
    mine = O.keep_first(m.sections.withColumnRenamed("key", "b_key").join(head.select("b_key"), "b_key", "left_semi"), SECTION, [F.col("row_id")])
    counts = {k: F.col(f"count_{k}") for k in N.ANSWERS}
    score = F.struct(F.col("row_id"), F.coalesce("question", F.lit("")).alias("question"), *(F.coalesce(F.col(f"count_{k}"), F.lit(0)).alias(f"count_{k}") for k in N.ANSWERS), F.coalesce("mean_stored", F.lit(0.0)).alias("mean_stored"), N.answer_mean(counts).alias("mean_computed"), F.coalesce("median", F.lit(0.0)).alias("median"), F.coalesce("std_dev", F.lit(0.0)).alias("std_dev"), F.col("completed"))
    ids = mine.select(*SECTION).distinct()
    asked = m.scores.join(F.broadcast(ids), same_section(m.scores, ids), "left_semi")  # one person's sections
    listed = asked.groupBy(*SECTION).agg(F.sort_array(F.collect_list(score)).alias("scores"))
    full = mine.join(listed, same_section(mine, listed), "left").select(mine["b_key"], F.struct((-mine["termId"]).alias("order"), mine["row_id"], mine["courseId"], mine["termId"], F.coalesce("termTitle", F.lit("")).alias("term"), F.coalesce("displayName", F.lit("")).alias("name"), F.coalesce("section", F.lit("")).alias("section"), F.coalesce("enrollment", F.lit(0)).alias("enrollment"), "scores").alias("c"))
    # the newest term first, missing terms last
    courses = full.groupBy("b_key").agg(F.sort_array(F.collect_list(F.struct(F.col("c.order").isNull().alias("last"), "c"))).alias("courses")).select("b_key", F.col("courses.c").alias("courses"))
    review = F.struct("row_id", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("course", "date", "tags", "attendance", "grade", "textbook", "online_class", "comment")), *(F.coalesce(N.number(F.col(c)), F.lit(0.0)).alias(c) for c in ("quality", "difficulty")))
    reviews = m.reviews.join(head.select("key"), "key", "left_semi").groupBy("key").agg(F.sort_array(F.collect_list(review)).alias("reviews"))
    said = m.comments.join(ids, same_section(m.comments, ids)).select(m.comments["row_id"], m.comments["courseId"], m.comments["termId"], "question", "comment")
    comments = said.agg(F.sort_array(F.collect_list(F.struct("row_id", "courseId", "termId", "question", "comment"))).alias("comments"))
    return head.join(courses, "b_key", "left").join(reviews, "key", "left").crossJoin(F.broadcast(comments)).drop("b_key")  # head and comments: one row
