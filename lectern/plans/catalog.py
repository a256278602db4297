"""The engine's queries over the star-schema tables, each built from the library's operators.

A section is (supplier, line number, ship year), an answer is 1 + floor((quantity - 1) / 10); suppliers are the people of
source B, and of source A with rating 1 + floor(balance / 2500) where the balance is positive.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import core as O
from ..sources import readers as R
from ..sources import sinks as S
from ..sources.scratch import scratch

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """Tables of one folder, read by name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def long(c: Column) -> Column:
    return c.cast("bigint")


# ---------------------------------------------------------------- shared building blocks


def answers(t: Tables) -> DataFrame:
    """One row for each line: section, answer."""
    return t.lineitem.select(F.col("l_suppkey").alias("person"), F.col("l_linenumber").alias("line"), F.year("l_shipdate").alias("term"), (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("int").alias("k"))


def histograms(t: Tables) -> DataFrame:
    """One row for each section: count_1 ... count_5, completed."""
    by = answers(t).groupBy("person", "line", "term")
    return by.agg(*(F.count_if(F.col("k") == k).alias(f"count_{k}") for k in N.ANSWERS), F.count("*").alias("completed"))


def counts() -> dict[int, Column]:
    return {k: F.col(f"count_{k}") for k in N.ANSWERS}


def source_b(t: Tables) -> DataFrame:
    """person, b_rating (weighted mean of answers), b_count: sums first, so sections are exact and one division remains."""
    h = histograms(t).select("person", N.answer_sum(counts()).alias("ws"), N.answer_count(counts()).alias("n"), "completed")
    total = h.groupBy("person").agg(F.sum("ws").alias("ws"), F.sum("n").alias("n"), F.coalesce(F.sum("completed"), F.lit(0)).alias("b_count"))
    return total.select("person", F.try_divide(F.col("ws").cast("double"), F.nullif(F.col("n"), F.lit(0)).cast("double")).alias("b_rating"), "b_count")


def source_a(t: Tables) -> DataFrame:
    rating = F.when(F.col("s_acctbal") > 0, 1 + F.floor(F.col("s_acctbal") / 2500)).otherwise(0).cast("double")
    n = F.when(F.col("s_acctbal") > 0, F.col("s_suppkey") % 40).otherwise(0)
    return t.supplier.select(F.col("s_suppkey").alias("person"), F.col("s_name").alias("name"), "s_nationkey", rating.alias("a_rating"), n.alias("a_count"))


def blended(t: Tables) -> DataFrame:
    """person, name, s_nationkey, both ratings and counts, avg_rating, total."""
    both = source_a(t).join(source_b(t), "person", "left").withColumn("b_count", F.coalesce("b_count", F.lit(0)))
    avg = N.blend(F.col("a_rating"), F.col("a_count"), F.col("b_rating"), F.col("b_count"))
    return both.withColumn("avg_rating", avg).withColumn("total", F.col("a_count") + F.col("b_count"))


def regional(t: Tables) -> DataFrame:
    """blended with category (nation) and college (region)."""
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("category"), F.col("r_name").alias("college"))
    return blended(t).join(place, F.col("s_nationkey") == F.col("n_nationkey"))


# ---------------------------------------------------------------- queries


def csv_roundtrip_scan(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "csv")
    S.write_csv(Tables(spark, d).documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang"), path)
    back = R.read_csv(spark, path, ("doc_id", "text", "lang"))
    return back.groupBy("lang").agg(F.count("doc_id").alias("n"), F.sum(long(F.length("text"))).alias("chars"), F.sum(F.col("doc_id").try_cast("bigint")).alias("ids"))


def coerce_clean(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 7 == 0, "N/A").otherwise(F.get_json_object("props", "$.k"))
    rows = R.na_normalise(Tables(spark, d).events.select("event_id", raw.alias("raw"), "value"))
    typed = rows.select("event_id", N.number(F.col("raw")).alias("k"), N.whole(F.col("raw")).alias("k_or_0"), N.percent(F.concat(F.lit(" "), "raw", F.lit("% "))).alias("pct"), N.positive(F.col("value")).alias("pos"))
    return typed.na.drop(subset=["k"])


def nested_page_flatten(spark: SparkSession, d: str) -> DataFrame:
    node = F.struct(F.struct(F.col("text").alias("comment"), F.col("role").alias("class"), F.col("turn").alias("qualityRating"), (F.col("turn") % 2 == 0).alias("isForOnlineClass")).alias("node"))
    pages = Tables(spark, d).conversations.groupBy("conv_id").agg(F.collect_list(node).alias("edges"))
    info = F.struct(F.lit(False).alias("hasNextPage"), F.lit("").alias("endCursor")).alias("pageInfo")
    body = F.to_json(F.struct(F.struct(F.struct(F.struct("edges", info).alias("ratings")).alias("node")).alias("data")))
    return R.review_rows(pages.select("conv_id", body.alias("body")), "body", "conv_id").select("conv_id", F.col("course").alias("role"), "quality", "online_class", long(F.length("comment")).alias("chars"))


def cell_grid_scan(spark: SparkSession, d: str) -> DataFrame:
    """Grids of orders: counts first, a skipped label, a question of nine numbers and one of five."""
    k = F.col("o_orderkey")
    nums = [k % 11 + i for i in range(8)]
    line = lambda i, *cells: F.transform(F.array(*(F.lit(c) if isinstance(c, str) else c.cast("string") for c in cells)), lambda v, j: F.struct(F.lit(i).alias("row_idx"), j.alias("col_idx"), v.alias("value")))
    grid = F.concat(line(0, "Enrollment", "", k % 50 + 1), line(1, "Completed", k % 20), line(2, "Eval #1", *nums), line(3, "How clear was it?", "x", *nums), line(4, "How fair was it?", *nums[:5]))
    cells = Tables(spark, d).orders.select(k.alias("report_id"), F.explode(grid).alias("c")).select("report_id", "c.*")
    return R.grid_scores(cells)


def html_extract(spark: SparkSession, d: str) -> DataFrame:
    return R.html_items(Tables(spark, d).pages, "page_id", "html").withColumn("pos", long(F.col("pos")))


def append_sink(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "append")
    orders = Tables(spark, d).orders.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderstatus")
    S.write_csv(orders.where("o_orderkey % 2 = 0"), path)
    S.write_csv(orders.where("o_orderkey % 2 = 1"), path, append=True)
    return R.read_csv(spark, path, ("o_orderkey", "o_orderstatus")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def nested_export(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    kids = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity", "l_partkey")
    nested = S.nest(t.orders.select("o_orderkey", "o_orderstatus"), kids, "o_orderkey", ["l_linenumber", "l_partkey"], "lines")
    flat = S.children(nested, "lines", ["o_orderkey", "o_orderstatus"])
    return flat.groupBy("o_orderkey", "o_orderstatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


def category_counts(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    college = F.create_map(*(F.lit(x) for kv in COLLEGES.items() for x in kv))
    named = named.withColumn("college", F.coalesce(F.try_element_at(college, F.col("n_regionkey")), F.lit("Other")))
    return O.value_counts(named, "college").where("n >= 5 and college <> 'Other'").orderBy("college")


#: Colleges of the stand-in categories; one category has none.
COLLEGES = {0: "Arts", 1: "Business", 2: "Science", 3: "Health"}


def score_bands(spark: SparkSession, d: str) -> DataFrame:
    k = F.when(F.col("l_linenumber") != 7, F.col("l_quantity") / 10)
    rows = Tables(spark, d).lineitem.select(N.score_band(k).alias("score"), N.difficulty_band(k).alias("difficulty"), long(N.clamp_percent(F.col("l_quantity") - 25)).alias("pct"))
    return rows.groupBy("score", "difficulty").agg(F.count("*").alias("n"), F.sum("pct").alias("pct"))


def histogram_mean(spark: SparkSession, d: str) -> DataFrame:
    return histograms(Tables(spark, d)).select("person", "line", "term", N.answer_count(counts()).alias("n"), N.answer_mean(counts()).alias("mean"))


def date_window(spark: SparkSession, d: str) -> DataFrame:
    dated = Tables(spark, d).orders.select("o_orderkey", N.read_date(N.iso_date(F.unix_millis(F.col("o_orderdate").cast("timestamp")))).alias("day"))
    dated = dated.withColumn("day", F.when(F.col("o_orderkey") % 9 != 0, F.col("day")))
    return O.date_window(dated, F.col("day"), F.lit("1998-01-01").cast("date"), months=24, skip=3).select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"))


def weighted_mean_join(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    names = t.supplier.select(F.col("s_suppkey").alias("person"), "s_name").distinct()
    return source_b(t).join(names, "person").select("s_name", "b_rating", "b_count")


def prefix_link(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws(" ", F.left(X.first_token(F.col("p_name")), F.lit(3)), X.last_token(F.col("p_name")))
    parts = Tables(spark, d).part
    return O.prefix_link(parts.select("p_partkey", key.alias("short")), parts.select(F.col("p_name").alias("linked")), "p_partkey", "short", "linked")


def blend_rating(spark: SparkSession, d: str) -> DataFrame:
    return blended(Tables(spark, d)).select("person", F.when(F.col("a_count") > 0, F.col("a_rating")).alias("a_rating"), F.when(F.col("b_count") > 0, F.col("b_rating")).alias("b_rating"), "avg_rating", "total")


def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return leaders(Tables(spark, d), "EUROPE", 3, 10)


def leaderboard_lenient(spark: SparkSession, d: str) -> DataFrame:
    return leaders(Tables(spark, d), "AFRICA", 3, 10)


def leaders(t: Tables, college: str, least: int, limit: int, lenient: tuple[str, ...] = ("AFRICA",)) -> DataFrame:
    """The best-rated people of a college.  Lenient colleges ask for five answers in all, the others for `least` of each source."""
    enough = F.when(F.col("college").isin(*lenient), F.col("total") >= 5).otherwise((F.col("a_count") >= least) & (F.col("b_count") >= least) & F.col("b_rating").isNotNull())
    good = regional(t).where((F.col("college") == college) & enough)
    found = O.ranked(good, [F.desc_nulls_last("avg_rating"), F.desc("total"), F.col("name")], limit)
    return found.select("rank", "name", "category", "avg_rating", long(F.col("a_count")).alias("a_count"), long(F.col("b_count")).alias("b_count"), "total")


def people_index(t: Tables) -> DataFrame:
    """People of both sources by key: A first (even ones only), then those B alone knows; category dropped where missing."""
    a = t.supplier.where("s_suppkey % 2 = 0").select("s_suppkey", "s_name", "s_nationkey", F.lit(0).alias("priority"))
    names = t.supplier.select("s_suppkey", "s_name", "s_nationkey", F.lit(1).alias("priority"))
    b_only = names.join(a.select("s_name"), "s_name", "left_anti").select(a.columns)
    both = a.unionByName(b_only).withColumn("category", F.when(F.col("s_nationkey") != 7, F.col("s_nationkey"))).where("category is not null")
    keyed = both.withColumn("key", X.name_key(F.replace(F.col("s_name"), F.lit("#"), F.lit(" "))))
    return O.keep_first(keyed, ["key"], [F.col("priority"), F.col("s_suppkey")]).withColumn("slug", X.slug(F.col("key")))


def search_index(spark: SparkSession, d: str) -> DataFrame:
    return people_index(Tables(spark, d)).select("s_suppkey", "priority", "key", "slug")


def search_person(spark: SparkSession, d: str) -> DataFrame:
    return find_person(Tables(spark, d), "gear", 20)


def find_person(t: Tables, query: str, limit: int) -> DataFrame:
    """Tiers: the query is a word of the name, starts one, stands in it.  Under two characters nothing is found."""
    names = t.part.select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("total"))
    q = " ".join(query.lower().split())
    if len(q) < 2:
        return names.withColumn("tier", F.lit(1)).limit(0)
    tests = O.name_tests(F.lower("name"), q)
    return O.tiered_top(names, tests, [F.desc("total"), F.col("p_partkey")], limit)


def search_code(spark: SparkSession, d: str) -> DataFrame:
    """How many parts each tier of one query holds: it starts the code, stands in it, stands in the title."""
    rows = Tables(spark, d).part.select("p_partkey", F.concat_ws(" ", F.lower("p_type"), F.lower("p_brand")).alias("code"), "p_name")
    return rows.withColumn("tier", O.tier(O.code_tests(F.col("code"), F.lower("p_name"), "ring"))).withColumn("prefix", O.tier(O.code_tests(F.col("code"), F.lower("p_name"), "pro"))).groupBy("tier", "prefix").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


def review_list(spark: SparkSession, d: str) -> DataFrame:
    return reviews(Tables(spark, d), "click", "newest", 10, 10)


def reviews(t: Tables, course: str, mode: str, offset: int, limit: int) -> DataFrame:
    """A page of reviews of one course (`__all__` for any) in one of four orders; undated ones last."""
    rows = t.events.select("event_id", "event_type", "ts", "value")
    return O.review_page(rows, F.col("event_type"), F.col("ts"), F.col("value"), "event_id", course, mode, offset, limit).select("event_id", "event_type", "value")


def review_orders(spark: SparkSession, d: str) -> DataFrame:
    """The second page of each order, of one course and of all."""
    t = Tables(spark, d)
    pages = [reviews(t, c, mode, 10, 10).select(F.lit(c).alias("course"), F.lit(mode).alias("mode"), "event_id", "event_type", "value") for c in ("click", "__all__") for mode in O.REVIEW_ORDERS]
    return reduce(DataFrame.unionByName, pages)


def course_list(spark: SparkSession, d: str) -> DataFrame:
    return O.first_seen(Tables(spark, d).events, "event_type", "event_id").orderBy("first_row")


def profile_nested(spark: SparkSession, d: str) -> DataFrame:
    """Sections of each person as one nested value, newest first, with comments matched by the key in their page's address."""
    t = Tables(spark, d)
    part = histograms(t).select("person", F.struct((-F.col("term")).alias("order"), "line", "term", "completed", N.answer_sum(counts()).alias("ws")).alias("s"))
    nested = part.groupBy("person").agg(F.sort_array(F.collect_list("s")).alias("sections"))
    url = F.concat(F.lit("https://x.example/"), F.element_at(F.split("url", "/"), 4), F.lit("/1/"), F.regexp_extract("url", r"(\d+)", 1), F.lit("/"), (F.col("page_id") % 50).cast("string"))
    comments = t.pages.select(N.url_key(url).alias("k")).select("k.person", "k.term", "k.course")
    comments = comments.where("person is not null").select((F.col("person") % 100 + 1).alias("person")).groupBy("person").agg(F.count("*").alias("n_comments"))
    out = nested.join(comments, "person", "left")
    return out.select("person", long(F.size("sections")).alias("n_sections"), F.array_join(F.transform("sections", lambda s: F.concat_ws(":", s["term"], s["line"], s["completed"], s["ws"])), ",").alias("sections"), F.coalesce("n_comments", F.lit(0)).alias("n_comments"))


def fixed_histogram(spark: SparkSession, d: str) -> DataFrame:
    return O.fixed_histogram(answers(Tables(spark, d)), F.col("k"), [6, 5, 4, 3, 2, 1]).select(long(F.col("bucket")).alias("bucket"), "n", "bar")


def ordered_share(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("o_orderkey") % 13 == 0, " ").otherwise(F.col("o_orderpriority"))
    rows = Tables(spark, d).orders.select(level.alias("priority"))
    return O.ordered_share(rows, "priority", ["5-LOW", "3-MEDIUM", "1-URGENT"], ["4-NOT SPECIFIED"]).select("priority", "n", "percent", long(F.col("place")).alias("place"))


def stats(spark: SparkSession, d: str) -> DataFrame:
    """Four headline numbers, one row each."""
    t = Tables(spark, d)
    codes = t.part.agg(F.countDistinct(F.upper(X.course_code(F.col("p_brand")))).alias("v"))
    people = t.supplier.select(F.col("s_name").alias("n")).union(t.customer.select(F.col("c_name").alias("n"))).where("trim(n) <> ''").distinct().agg(F.count("*").alias("v"))
    sections = histograms(t).agg(F.sum("completed").alias("v"))
    kinds = t.part.agg(F.countDistinct(F.lower(F.trim("p_type"))).alias("v"))
    parts = {"codes": codes, "people": people, "answers": sections, "departments": kinds}
    out = None
    for label, df in parts.items():
        row = df.select(F.lit(label).alias("label"), long(F.col("v")).alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def group_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of each order priority, newest first: year, then season."""
    m = F.month("o_orderdate")
    season = F.when(m <= 3, "spring").when(m <= 6, "SUMMER").when(m <= 9, "Fall").otherwise("winter")
    rows = Tables(spark, d).orders.select("o_orderpriority", X.clean_term(F.concat_ws(" ", (F.year("o_orderdate") + 10).cast("string"), season)).alias("term"))
    years = F.coalesce(X.term_year(F.col("term")), F.lit(0))
    grouped = rows.groupBy("o_orderpriority", "term").agg(F.count("*").alias("n"))
    ordered = grouped.groupBy("o_orderpriority").agg(F.sort_array(F.collect_list(F.struct((-years).alias("y"), (-X.season_rank(F.col("term"))).alias("s"), "term"))).alias("t"), F.sum("n").alias("n"))
    return ordered.select("o_orderpriority", "n", F.array_join("t.term", ",").alias("terms"))


def summary_report(spark: SparkSession, d: str) -> DataFrame:
    c = Tables(spark, d).customer
    return c.agg(F.count("*").alias("total"), F.count_if(F.col("c_acctbal") > 0).alias("rated"), F.sum(long(F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal")))).alias("units"), F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"))


def top_and_bottom(spark: SparkSession, d: str) -> DataFrame:
    """Ten nations with most and ten with fewest customers among those with five or more."""
    n = O.value_counts(Tables(spark, d).customer, "c_nationkey").where("n >= 5")
    best = O.top(n, [F.desc("n"), F.col("c_nationkey")], 10).withColumn("side", F.lit("top"))
    worst = O.top(n, [F.col("n"), F.col("c_nationkey")], 10).withColumn("side", F.lit("bottom"))
    return best.unionByName(worst)


def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    rows = Tables(spark, d).lineitem.select("l_suppkey", "l_linenumber", F.year("l_shipdate").alias("term"), (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("row_id"))
    rows = rows.withColumn("term", F.when(F.col("row_id") % 5 != 0, F.col("term")))
    return O.latest(rows, ["l_suppkey", "l_linenumber"], "term", "row_id").withColumn("term", long(F.col("term")))


def random_row(spark: SparkSession, d: str) -> DataFrame:
    return O.random_row(blended(Tables(spark, d)).where("a_count >= 3").select("person", "name"), "person", 42)


def text_keys(spark: SparkSession, d: str) -> DataFrame:
    return Tables(spark, d).documents.select("doc_id", X.name_key(F.col("text")).alias("key")).select("doc_id", "key", X.slug(F.col("key")).alias("slug"))


def title_keys(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat_ws("-", "p_name", F.lower("p_brand"))
    return Tables(spark, d).part.select("p_partkey", X.title_case(name).alias("title"))


def code_parse(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey")
    tail = F.when(n % 3 == 0, F.concat(F.lit(":0"), (n % 7).cast("string"), F.lit(" ("), "p_name", F.lit(") - P"))).when(n % 3 == 1, F.concat(F.lit(" ("), "p_name", F.lit(")"))).otherwise(F.lit(" plain text"))
    label = F.concat(F.lit("ACCT"), n.cast("string"), tail)
    parsed = X.parse_course(label)
    return Tables(spark, d).part.select("p_partkey", parsed["code"].alias("code"), parsed["title"].alias("title"), X.lenient_code(label).alias("lenient"), X.in_brackets(label).alias("brackets"))


def formatters(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    friendly = N.friendly_count(n)
    return Tables(spark, d).orders.select(
        "o_orderkey", friendly.alias("friendly"), N.parse_friendly(friendly)["value"].alias("parsed"), N.percent_text((n % 200) / 2).alias("pct"), X.base64_id("School", n).alias("id64"),
        X.initials(F.concat_ws(" ", F.lower("o_orderpriority"), "o_orderstatus")).alias("initials"), X.file_name(F.col("o_orderpriority")).alias("file"),
    )


def tag_split(spark: SparkSession, d: str) -> DataFrame:
    dashed = F.replace(F.col("text"), F.lit(". "), F.lit("--"))
    one, two = X.split_tags(dashed, "--"), X.split_tags(dashed, ",")
    return Tables(spark, d).documents.select("doc_id", long(F.size(one)).alias("n_dashed"), long(F.size(two)).alias("n_comma"), F.array_join(two, "|").alias("tags"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        csv_roundtrip_scan, coerce_clean, nested_page_flatten, cell_grid_scan, html_extract, append_sink, nested_export, category_counts, score_bands, histogram_mean, date_window, weighted_mean_join, prefix_link, blend_rating, leaderboard,
        search_index, search_person, search_code, review_list, review_orders, leaderboard_lenient, course_list, profile_nested, fixed_histogram, ordered_share, stats, group_terms, summary_report, top_and_bottom, latest_per_key, random_row, text_keys, title_keys, code_parse, formatters, tag_split,
    )
}
