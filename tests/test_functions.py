from __future__ import annotations

import datetime
import string

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import numbers as N
from lectern.functions import text as X
from lectern.operators import core as O


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


def texts(spark, make, cases):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", make(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [b for _, b in cases]


def test_keys(spark):
    texts(spark, X.name_key, [("  José   ÁLVAREZ ", "jose alvarez"), ("Søren", "sren"), ("ﬁx", "fix"), ("½", "12"), (None, None), ("a  b", "a b"), ("", "")])
    texts(spark, lambda c: X.slug(X.name_key(c)), [("María Núñez", "maria-nunez"), ("--A  b--", "a-b"), ("", ""), (None, None)])
    texts(spark, X.title_case, [("o'brien smith-jones", "O'Brien Smith-Jones"), ("ABC", "Abc")])


def test_courses_and_terms(spark):
    texts(spark, lambda c: X.parse_course(c)["code"], [("ACCT6228:02 (Title) - P", "ACCT6228"), ("ACCT6228 (Title)", None)])
    texts(spark, lambda c: X.parse_course(c)["title"], [("ACCT6228:02 (Title) - P", "Title"), ("ACCT6228 (Title)", None)])
    texts(spark, X.lenient_code, [("ACCT6228 (Title)", "ACCT6228"), ("ACCT6228:02 (T)", "ACCT6228"), ("plain words", "plain")])
    texts(spark, X.clean_term, [("2024 FALL CPS", "Fall 2024"), ("Winter", "Winter"), ("Term 5 ", "Term 5")])
    texts(spark, lambda c: X.season_rank(c).cast("int"), [("Fall 2024", 3), ("Winter 2024", 4), ("x", 0)])
    texts(spark, lambda c: X.split_tags(c, "--"), [("a-- b ----", ["a", "b"]), ("", [])])
    texts(spark, X.strip_question, [("Q: What?", "What?"), ("What?", "What?")])


def test_numbers(spark):
    texts(spark, N.percent, [("85%", 85.0), (" -1%", None), ("x", None), ("NaN", None)])
    texts(spark, lambda c: N.friendly_count(c.cast("int")), [("99", "99"), ("100", "100+"), ("3863", "3,800+"), ("42677", "42,600+")])
    texts(spark, lambda c: N.parse_friendly(c)["value"], [("3,800+", 3800), ("99", 99), ("x", None)])
    texts(spark, lambda c: N.iso_date(c), [("0", "1970-01-01"), ("1719792000000", "2024-07-01")])
    texts(spark, lambda c: N.url_key(c).cast("string"), [("https://x/coursereport?sp=1&sp=2&sp=3", "{1, 2, 3}"), ("https://x/11/2/34", "{11, 2, 34}"), ("https://x/", "{null, null, null}")])
    counts = {k: F.lit(v) for k, v in zip(N.ANSWERS, (2, 1, 0, 0, 1))}
    assert one(spark, N.answer_mean(counts)) == 3.75
    assert one(spark, N.answer_mean({k: F.lit(0) for k in N.ANSWERS})) is None


def test_blend(spark):
    rows = [(4.0, 5, 3.0, 2, 3.5), (0.0, 0, 3.0, 2, 3.0), (4.0, 5, None, 0, 4.0), (0.0, 0, None, 0, 0.0)]
    df = spark.createDataFrame(rows, "a double, an int, b double, bn int, want double")
    assert all(r.got == r.want for r in df.withColumn("got", N.blend(F.col("a"), F.col("an"), F.col("b"), F.col("bn"))).collect())


def test_date_window(spark):
    df = spark.createDataFrame([("2026-07-01",), ("2026-04-02",), ("2026-04-01",), ("",), ("x",)], "d string").withColumn("day", N.read_date(F.col("d")))
    now = F.lit(datetime.date(2026, 7, 1))
    assert {r.d for r in O.date_window(df, F.col("day"), now, 3).collect()} == {"2026-07-01", "2026-04-02"}
    assert O.date_window(df, F.col("day"), now, None).count() == 5
    assert {r.d for r in O.date_window(df, F.col("day"), now, None, 1).collect()} == {"2026-04-02", "2026-04-01", "", "x"}


def test_prefix_link(spark):
    left = spark.createDataFrame([(1, "mar villar"), (2, "ann smith"), (3, "solo"), (4, "bo lee")], "id int, k string")
    right = spark.createDataFrame([("maria elena villar",), ("marta villar",), ("ann smith",), ("solo",)], "c string")
    got = O.prefix_link(left, right, "id", "k", "c")
    assert [(r.id, r.c) for r in got.collect()] == [(1, "maria elena villar")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_keep_first_and_latest(spark):
    df = spark.createDataFrame([(1, 10, 0), (1, None, 1), (1, 30, 2), (2, None, 3), (2, None, 4)], "k int, t int, row_id int")
    for n in (1, 7):
        rows = df.repartition(n)
        assert {(r.k, r.row_id) for r in O.latest(rows, ["k"], "t", "row_id").collect()} == {(1, 2), (2, 3)}
        assert {(r.k, r.row_id) for r in O.keep_first(rows, ["k"], [F.col("row_id")]).collect()} == {(1, 0), (2, 3)}


def test_ordered_share_and_histogram(spark):
    df = spark.createDataFrame([(g,) for g in ("A", "A", "B", "ZZ", "N/A", " ")], "g string")
    got = [(r.g, r.n, r.percent) for r in O.ordered_share(df, "g", ["A", "B", "C"], ["N/A"]).collect()]
    assert got == [("A", 2, 50.0), ("B", 1, 25.0)]
    h = O.fixed_histogram(spark.createDataFrame([(5,), (5,), (1,)], "v int"), F.col("v"), [5, 4, 1])
    assert [(r.bucket, r.n, r.bar) for r in h.collect()] == [(5, 2, 100.0), (4, 0, 0.0), (1, 1, 50.0)]


def test_tiers_and_limits(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(("john smith", "amy smithson", "bo blacksmith", "x"))], "i int, n string")
    words = X.tokens(F.col("n"))
    tests = [F.array_contains(words, "smith"), F.exists(words, lambda w: F.startswith(w, F.lit("smith"))), F.contains("n", F.lit("smith"))]
    top = O.tiered_top(df, tests, [F.col("i")], 10)
    assert [r.tier for r in top.collect()] == [1, 2, 3]
    assert "TakeOrdered" in top._jdf.queryExecution().executedPlan().toString()
    for k in range(4):
        assert O.tiered_top(df, tests, [F.col("i")], k).collect() == top.collect()[:k]
    try:
        O.top(df, [F.col("i")], -1)
        raise AssertionError
    except ValueError:
        pass


def test_keys_are_idempotent(spark):
    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.text(alphabet=string.printable + "éñÅßﬁ½ø ", max_size=30), min_size=200, max_size=200))
    def check(names):
        df = spark.createDataFrame([(n,) for n in names], "n string").select(X.name_key(F.col("n")).alias("k"))
        df = df.select("k", X.name_key(F.col("k")).alias("k2"), X.slug(F.col("k")).alias("s"))
        for r in df.select("k", "k2", "s", X.slug(F.col("s")).alias("s2")).collect():
            assert r.k == r.k2 and r.s == r.s2

    check()


def test_round_binary_is_that_of_exact_values(spark):
    import random

    rng = random.Random(6)
    values = [2.675, 0.125, 4.345, 1.005, 2.5, 0.0, -2.675, -0.125, 1e9 + 0.125, 0.145, 0.285] + [rng.choice([rng.random() * 5, rng.randrange(5000) / 1000, rng.randrange(40) / 8, (rng.randrange(50) / 10 + rng.randrange(500) / 100) / 2]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    for digits in (0, 1, 2, 3):
        got = [r.r for r in df.select(N.round_binary(F.col("v"), digits).alias("r")).collect()]
        assert got == [*(float(round(v, digits)) for v in values), None]


def test_grid_rows_of_any_width(spark):
    from lectern.sources import readers as R

    cells = spark.createDataFrame([(1, 0, i, str(i)) for i in range(30)], "report_id int, row_idx int, col_idx int, value string")
    assert len(R.grid_rows(cells).first().cells) == 29
    plan = R.grid_rows(cells)._jdf.queryExecution().analyzed().toString()
    assert "1000000" not in plan


def test_random_row_does_not_depend_on_partitions(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    assert {O.random_row(df.repartition(n), "k", 5).first().k for n in (1, 3, 8)} == {O.random_row(df, "k", 5).first().k}
    assert len({O.random_row(df, "k", s).first().k for s in range(6)}) > 2


def test_review_page_orders(spark):
    df = spark.createDataFrame([(0, "a", "2024-01-02", 1.0), (1, "b", None, None), (2, "a", "2024-01-03", 3.0), (3, "a", "2024-01-01", 2.0)], "row_id int, c string, d string, q double")
    ids = lambda **k: [r.row_id for r in O.review_page(df, F.col("c"), N.read_date(F.col("d")), F.col("q"), "row_id", **k).collect()]
    assert ids() == [2, 0, 3, 1] and ids(mode="oldest") == [3, 0, 2, 1] and ids(mode="highest") == [2, 3, 0, 1] and ids(mode="lowest") == [0, 3, 2, 1]
    assert ids(chosen="b") == [1] and ids(chosen="a", offset=1, limit=1) == [0]
    try:
        ids(mode="best")
        raise AssertionError
    except ValueError:
        pass
