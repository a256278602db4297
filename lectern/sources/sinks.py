"""Writers: flat and nested exports of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import file_name  # noqa: F401  names of exported files


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """CSV with header, quotes doubled; each part has its own header, so appending needs no test for one."""
    df.write.mode("append" if append else "overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def children(parents: DataFrame, array: str, context: list[str]) -> DataFrame:
    """One row for each child with its parent's context; parents without children give none."""
    return parents.select(*context, F.explode(array).alias("__c")).select(*context, "__c.*")


def nest(parents: DataFrame, kids: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """parents with an array of their children's other columns, in order; childless parents have an empty one."""
    fields = [c for c in kids.columns if c != key]
    listed = kids.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *(c for c in fields if c not in order)))).alias(name))
    kind = listed.schema[name].dataType
    return parents.join(listed, key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))


def document(df: DataFrame, head: dict[str, Column] | None = None) -> DataFrame:
    """Each row as one JSON text; missing values are written as null."""
    return df.select(F.to_json(F.struct(*(v.alias(k) for k, v in (head or {}).items()), *df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str, head: dict[str, Column] | None = None) -> None:
    document(df, head).write.mode("overwrite").text(path)


def export_document(people: DataFrame, name: str, head: dict[str, Column]) -> DataFrame:
    """One row: the head's constants, the counts of export_summary, and the people as an array in order of row_id.  The whole export
    in one value, as its readers want it; large ones are written with write_json, a line for each person."""
    listed = F.sort_array(F.collect_list(F.struct("row_id", *(c for c in people.columns if c != "row_id")))).alias(name)
    return people.agg(*(v.alias(k) for k, v in head.items()), *export_counts(), listed)


def export_counts(reviews: str = "reviews") -> list[Column]:
    """Aggregates: total, with_ratings, with_reviews, n_reviews."""
    return [
        F.count("*").alias("total"), F.count_if(F.col("num_ratings") > 0).alias("with_ratings"), F.count_if(F.size(reviews) > 0).alias("with_reviews"),
        F.coalesce(F.sum(F.greatest(F.size(reviews), F.lit(0))), F.lit(0)).cast("bigint").alias("n_reviews"),
    ]


def export_summary(people: DataFrame, reviews: str = "reviews") -> DataFrame:
    """The counts of an export, and the means of rating and difficulty of rated people, and of `again` where it is known."""
    rated = F.col("num_ratings") > 0
    mean = lambda c, good: F.avg(F.when(good, F.col(c)))
    return people.agg(*export_counts(reviews), F.count_if(~rated).alias("without_ratings"), mean("rating", rated).alias("rating"), mean("difficulty", rated).alias("difficulty"), mean("again", rated & (F.col("again") >= 0)).alias("again"))


def display_row(number: Column) -> Column:
    """One decimal; negative is `N/A`."""
    return F.when(number < 0, "N/A").otherwise(F.format_string("%.1f", number))


def display_tags(tags: Column) -> Column:
    return F.array_join(tags, "; ")


def export_rows(people: DataFrame) -> DataFrame:
    """People as an export shows them: ratings with one decimal, unknown shares as `N/A`, tags joined."""
    shown = {"rating": display_row(F.col("rating")), "again": display_row(F.coalesce(F.col("again"), F.lit(-1.0))), "difficulty": display_row(F.col("difficulty")), "tags": display_tags(F.col("tags"))}
    return people.select(*(shown[c].alias(c) if c in shown else F.col(c) for c in people.columns if c != "reviews"))


def capped(df: DataFrame, array: str, most: int) -> DataFrame:
    """df with at most so many children in the array, the first ones."""
    return df.withColumn(array, F.slice(array, 1, most))
