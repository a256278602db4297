"""The six queries on small inputs, with the cases that are easy to get wrong."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lectern.plans import read_model as M
from lectern.sources import readers as R
from lectern.sources import sinks as S
from lectern.sources.replay import register
from lectern.sources.udtf import comments_of, comment_rows

PEOPLE = [
    ("José  Álvarez", "Law", "4", "5", "85%", "2.5", "u1"), ("Mar Villar", "Physics", "4.0", "20", "-1", "0", "u2"), ("Bad Row", "Physics", "x", "N/A", None, None, None), ("Ann Solo", "Physics", "3.0", "12", None, "3", "u4"),
    ("José Álvarez", "Music", "1", "1", None, None, "dup"),
]
SECTIONS = [
    ("1", "S", "10", "2024 FALL", "7", "2024-12-01", "jose", "ALVAREZ", "Law Dept", "30", "LAW100:01 (Torts) - J", "01"), ("1", "S", None, "T", "7", None, "José", "Álvarez", "Null Term", "3", "LAW100:02 (Torts II) - J", "02"),
    ("2", "S", "30", "Spring 2025", "7", "2025-05-01", "José", "Álvarez", "New Dept", "9", "LAW200 (No section)", "01"), ("3", "S", "20", "Fall 2023", "8", "x", "Maria Elena", "Villar", "Physics B", "40", "PHYS1:01 (Motion) - M", "01"),
    ("4", "S", "20", "Fall 2023", "9", None, "Only", "O'Brien", "B Dept", "4", "BIO1:01 (Cells) - O", "01"), ("3", "S", "20", "Fall 2023", "8", "x", "Maria Elena", "Villar", "Physics B", "40", "PHYS1:01 (Motion) - M", "01"),
]
SCORES = [
    ("1", "7", "10", "30", "4", "Overall rating", "2", "1", "0", "0", "1", "0", "5", "1"), ("1", "7", "10", "30", "4", "Overall rating", "2", "1", "0", "0", "1", "0", "5", "1"), ("1", "7", None, "3", "6", "overall", "0", "0", "0", "0", "2", "1", "1", "0"),
    ("3", "8", "20", "40", "25", "OVERALL", "20", "5", "0", "0", "0", "4.8", "5", "0"), ("4", "9", "20", "4", "N/A", "Overall", "0", "0", "0", "0", "0", None, None, None), ("2", "7", "30", "9", "2", "clarity", "1", "1", "0", "0", "0", "4.5", "4.5", "0.5"),
]
REVIEWS = [("JOSÉ álvarez", "Law", "4", "LAW100", "5", "2", "2024-01-01", "a, b", None, "N/A", "Yes", "No", 'He said "hi"\nand left'), ("nobody", "Law", "4", "X", "1", "1", "", "", "", "A", "", "", "c")]
COMMENTS = [("https://x/coursereport?sp=1&sp=7&sp=10", "Best?", "good"), ("https://x/1/7/10", "Best?", "fine"), ("https://x/11/7/10", "Best?", "other"), ("https://x/1/7/10", "Best?", "  ")]


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("model"))
    raw = []
    for name, rows, columns in (("people", PEOPLE, R.PEOPLE), ("reviews", REVIEWS, R.REVIEWS), ("sections", SECTIONS, R.SECTIONS), ("scores", SCORES, R.SCORES), ("comments", COMMENTS, R.COMMENTS)):
        S.write_csv(spark.createDataFrame(rows, R.text_schema(columns)).coalesce(1), f"{folder}/{name}")
        raw.append(R.with_row_id(R.read_csv(spark, f"{folder}/{name}", columns)))
    M.build(*raw).write(f"{folder}/gold")
    return M.open_model(spark, f"{folder}/gold")


def test_people(model):
    got = {(r.name, r.row_id == 0): r for r in model.people.collect()}
    jose = got["José Álvarez", True]
    assert len(got) == 4 and jose.college == "Law" and jose.b_department == "New Dept"
    # answers 2,1,0,0,1 once and 0,0,0,0,2: the repeated row counts once; a missing term joins a missing term
    assert (jose.b_rating, jose.b_count, jose.total) == (17 / 6, 12, 17)
    villar = got["Mar Villar", False]
    assert villar.matched_key == "maria elena villar" and villar.b_count == 25 and villar.again is None and villar.difficulty is None
    assert got["Ann Solo", False].avg_rating == 3.0 and got["Ann Solo", False].b_rating is None


def test_stats_and_colleges(model):
    got = {r.label: r.value for r in M.stats(model).collect()}
    assert got == {"Professors": "5", "Courses": "4", "Evaluations": "39", "Departments": "5"}
    assert [r.college for r in M.colleges(model, 1).collect()] == ["CAMD", "Law", "Science"] and M.colleges(model).count() == 0


def test_leaderboard(model):
    assert [r.name for r in M.leaderboard(model, "Science").collect()] == ["Mar Villar"]
    assert [r.name for r in M.leaderboard(model, "Science", min_reviews=0).collect()] == ["Mar Villar"]  # B must know them
    assert [r.dept for r in M.leaderboard(model, "Law").collect()] == ["New Dept"]
    with pytest.raises(ValueError):
        M.leaderboard(model, "Law", -1)


def test_search(model):
    names = lambda q, **k: [r.name for r in M.search(model, q, **k).collect()]
    assert names("álvarez") == ["José Álvarez"] and names("o") == [] and names("obrien", limit=9) == []
    assert names("only") == ["Only O'Brien"] and names("vill", limit=5) == ["Mar Villar", "Maria Elena Villar"]
    assert names("c++") == [] and names("solo") == []  # no department in B
    assert [(r.code, r.name) for r in M.search(model, "phys", "course").collect()] == [("PHYS1", "Motion")]


def test_profile(model):
    p = M.profile(model, "jose-alvarez").collect()[0]
    assert [c.termId for c in p.courses] == [30, 10, None] and [c.enrollment for c in p.courses] == [9, 30, 3]
    assert len(p.courses[1].scores) == 2 and p.courses[1].scores[0].mean_computed == 3.75 and p.courses[1].scores[0].mean_stored == 0
    assert [r.comment for r in p.reviews] == ['He said "hi"\nand left'] and p.reviews[0].grade == ""
    assert [c.comment for c in p.comments] == ["good", "fine"]
    assert M.profile(model, "only-o-brien").collect()[0].rating_a is None and M.profile(model, "no-one").count() == 0
    body = json.loads(S.document(M.profile(model, "ann-solo")).first().value)
    assert body["again"] is None and body["rating_b"] is None and body["rating_a"] == 3.0
    assert len(M.profile(model, "mar-villar").collect()[0].courses) == 1


def test_random(model):
    assert M.random_person(model, 1).count() == 1 and M.random_person(model, 1, 10**9).count() == 0
    # source A's ratings count, not the sum: five for José Álvarez, whose sum is 17
    assert {M.random_person(model, seed, 6).first().name for seed in range(12)} == {"Mar Villar", "Ann Solo"}


def test_rows_are_numbered_by_file(spark, tmp_path):
    for i, n in enumerate((3, 1, 400, 2)):
        (tmp_path / f"part-{i}.csv").write_text("course_url,question,comment\n" + "".join(f'u{i},q,"c {j}\nmore"\n' for j in range(n)))
    got = {}
    for size in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got[size] = [(r.course_url, r.comment) for r in R.read_numbered_csv(spark, str(tmp_path), R.COMMENTS).orderBy("row_id").collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(f"u{i}", f"c {j}\nmore") for i, n in enumerate((3, 1, 400, 2)) for j in range(n)]
    assert got["128m"] == got["1k"] == want


def test_pages_of_any_store(spark, tmp_path):
    from lectern.sources.replay import recorded_pages

    for i in (1, 2, 3, 10):
        (tmp_path / f"page-{i}.json").write_text(json.dumps({"data": {"pageInfo": {"hasNextPage": i < 3}}}))
    assert sorted(r.page for r in recorded_pages(spark, str(tmp_path)).collect()) == [1, 2, 3, 10]
    assert sorted(r.page for r in recorded_pages(spark, str(tmp_path), chain=True).collect()) == [1, 2, 3]
    assert [r.page for r in R.page_numbers(spark, 1001, 500).collect()] == [1, 2, 3] and R.page_numbers(spark, 0, 500).count() == 0
    with pytest.raises(ValueError):
        R.known_source("nowhere")


def test_stream_stops_and_resumes(spark, tmp_path):
    """A run that ends between files leaves what it wrote; the next takes only the rest."""
    from lectern.streaming.appends import append_new

    rows = lambda a, b: spark.range(a, b).selectExpr("id", "timestamp_seconds(1704067200 + id) as t")
    rows(0, 10).coalesce(1).write.parquet(str(tmp_path / "in"))
    args = (spark, str(tmp_path / "in"), rows(0, 1).schema, ["id"], "t", str(tmp_path / "out"), str(tmp_path / "cp"))
    first = append_new(*args)
    first.processAllAvailable()
    first.stop()
    rows(5, 20).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    append_new(*args).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(20))


HTML = '<table class="table x"><th><strong>Q: Good?</strong></th><tbody><tr><td>1</td><td><a>a  b\nc</a></td></tr><tr><td>2</td><td>plain</td></tr><tr><td>3</td></tr><tr><td>4</td><td> </td></tr></tbody></table><table><tr><td>1</td><td>no</td></tr></table><table class="table"><tbody><tr><td>1</td><td>no question</td></tr></tbody></table>'


def test_comment_pages(spark):
    assert comments_of(HTML) == [("Q: Good?", "a b c"), ("Q: Good?", "plain")] and comments_of(None) == []
    df = spark.createDataFrame([("u", HTML), ("v", None)], "course_url string, html string")
    assert [tuple(r) for r in comment_rows(df).collect()] == [("u", "Good?", "a b c"), ("u", "Good?", "plain")]


def test_recorded_pages(spark, tmp_path):
    node = {"id": "n", "legacyId": 5, "firstName": "Ann ", "lastName": None, "department": "D", "school": {"legacyId": 3}, "avgRating": 4.5, "numRatings": 0, "wouldTakeAgainPercent": 62.5, "teacherRatingTags": [{"tagName": "b", "tagCount": 2}, {"tagName": "a", "tagCount": 9}]}
    for i in (1, 2, 3):
        page = {"data": {"search": {"teachers": {"edges": [{"node": node}, {"node": node | {"school": {"legacyId": 9}}}], "pageInfo": {"hasNextPage": i < 2, "endCursor": "c"}}}}}
        (tmp_path / f"page-{i}.json").write_text(json.dumps(page))
    register(spark)
    read = spark.read.format("recorded_pages").option("path", str(tmp_path))
    assert read.load().count() == 3 and read.option("chain", "true").load().count() == 2  # cursors end after page 2
    people = R.entity_rows(spark.read.format("recorded_pages").option("path", str(tmp_path)).load(), "body", "https://x/", 3)
    r = people.first()
    assert people.count() == 3 and (r["name"], r.would_take_again_pct, r.professor_url, r.tags, r.level_of_difficulty) == ("Ann", "62%", "https://x/5", ["a", "b"], "N/A")
    assert R.worth_fetching(people).count() == 0


def test_append_stream(spark, tmp_path):
    from lectern.streaming.appends import append_new

    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00")], "id int, t string").select("id", F.to_timestamp("t").alias("t"))
    rows.write.parquet(str(tmp_path / "in"))
    run = lambda: append_new(spark, str(tmp_path / "in"), rows.schema, ["id"], "t", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    rows.union(rows.selectExpr("id + 2", "t")).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 4]


def test_exports(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    kids = spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "id int, n int, c string")
    nested = S.nest(parents, kids, "id", ["n"], "kids")
    assert {r.id: [k.c for k in r.kids] for r in nested.collect()} == {1: ["x", "y"], 2: []}
    assert S.children(nested, "kids", ["name"]).count() == 2
