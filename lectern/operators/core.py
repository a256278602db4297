"""Relational operators with the engine's own semantics: keep-first, latest, linking by name, tiers, shares.

Orders are total: every operator that picks a row takes the columns that decide, so results do not depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in order.  row_number() = 1 lets the plan limit groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def latest(df: DataFrame, keys: list[str], by: str, row_id: str) -> DataFrame:
    """One row for each key: the largest `by`, missing last, then the first row."""
    return keep_first(df, keys, [F.desc_nulls_last(by), F.col(row_id)])


def first_seen(df: DataFrame, value: str, row_id: str) -> DataFrame:
    """Distinct values with the row at which each came first."""
    return df.groupBy(value).agg(F.min(row_id).alias("first_row"))


def prefix_link(left: DataFrame, right: DataFrame, left_id: str, left_key: str, right_key: str) -> DataFrame:
    """(left_id, right_key) for rows whose key is not found as such: same last word, and one first word starts the other.

    Keys of fewer than two words link with nothing.  The lowest candidate wins.  Either side's first words are unfolded into
    their prefixes and meet the other side's whole ones, so the join keys hold first and last word and a common last word
    alone brings nothing together.
    """
    from ..functions.text import first_token, last_token, tokens

    a = left.select(F.col(left_id).alias("id"), F.col(left_key).alias("k")).where(F.size(tokens(F.col("k"))) >= 2)
    b = right.select(F.col(right_key).alias("c")).distinct()
    miss = a.join(b, F.col("k") == F.col("c"), "left_anti")
    miss = miss.select("id", first_token(F.col("k")).alias("first"), last_token(F.col("k")).alias("last"))
    names = b.where(F.size(tokens(F.col("c"))) >= 2).select("c", first_token(F.col("c")).alias("first"), last_token(F.col("c")).alias("last"))
    prefixes = lambda df: df.withColumn("first", F.explode(F.transform(F.sequence(F.lit(1), F.length("first")), lambda n: F.left("first", n))))
    shorter = prefixes(miss).join(names, ["first", "last"])
    longer = miss.join(prefixes(names), ["first", "last"])
    return shorter.select("id", "c").unionByName(longer.select("id", "c")).groupBy("id").agg(F.min("c").alias(right_key)).withColumnRenamed("id", left_id)


def name_tests(key: Column, query: str) -> list[Column]:
    """Tiers of people: the query is a word of the key, starts a word, stands in it."""
    from ..functions.text import tokens

    words = tokens(key)
    return [F.array_contains(words, query), F.exists(words, lambda w: F.startswith(w, F.lit(query))), F.contains(key, F.lit(query))]


def code_tests(code: Column, title: Column, query: str) -> list[Column]:
    """Tiers of courses: the query starts the code, stands in it, stands in the title."""
    return [F.startswith(code, F.lit(query)), F.contains(code, F.lit(query)), F.contains(title, F.lit(query))]


def tier(tests: list[Column]) -> Column:
    """1 for the first test that holds, 2 for the second, ...; null if none does."""
    out = F.when(tests[0], 1)
    for i, t in enumerate(tests[1:], 2):
        out = out.when(t, i)
    return out


def top(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows in order; negative limits are refused."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    return df.orderBy(*order).limit(limit)


def tiered_top(df: DataFrame, tests: list[Column], order: list[Column], limit: int) -> DataFrame:
    """Rows that pass a test, by tier and then order, at most `limit`: one pass and a bounded heap, no union of tiers."""
    return top(df.withColumn("tier", tier(tests)).where("tier is not null"), [F.col("tier"), *order], limit)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must not be negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def value_counts(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("n"))


def fixed_histogram(df: DataFrame, value: Column, domain: list[int]) -> DataFrame:
    """bucket, n, bar (percent of the largest count, which is taken as 1 at least) for each value of the domain, zeros too."""
    one = df.agg(*(F.count_if(value == k).alias(f"n{k}") for k in domain))
    rows = one.select(F.greatest(*(F.col(f"n{k}") for k in domain), F.lit(1)).alias("most"), F.explode(F.array(*(F.struct(F.lit(k).alias("bucket"), F.col(f"n{k}").alias("n")) for k in domain))).alias("s"))
    return rows.select("s.bucket", "s.n", (F.col("s.n") * 100.0 / F.col("most")).alias("bar"))


def ordered_share(df: DataFrame, value: str, domain: list[str], dropped: list[str]) -> DataFrame:
    """value, n, percent in the domain's order.  Shares are of all values that are neither blank nor dropped, whether listed or not."""
    good = df.where(F.trim(value) != "").where(~F.col(value).isin(dropped) if dropped else F.lit(True))
    counts = good.groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    place = F.array_position(F.array(*map(F.lit, domain)), F.col(value))
    shared = counts.crossJoin(F.broadcast(total))  # the total is one row
    return shared.withColumn("place", place).where("place > 0").select(value, "n", (F.col("n") * 100.0 / F.col("total")).alias("percent"), "place").orderBy("place")


def last_value_of(value: Column, present: Column, order: str, group: str) -> Column:
    """The value of the group's last row (by order) for which `present` holds, on every row of the group."""
    return F.max_by(F.when(present, value), F.when(present, F.col(order))).over(Window.partitionBy(group))


def date_window(df: DataFrame, date: Column, now: Column, months: int | None, skip: int = 0) -> DataFrame:
    """Rows of the last `months` months of 30 days, without the last `skip`.  Undated rows stay only if months is None; without
    both settings nothing is filtered."""
    if months is None and skip == 0:
        return df
    upper = date <= F.date_sub(now, 30 * skip)
    if months is None:
        return df.where(date.isNull() | upper)
    return df.where(upper & (date >= F.date_sub(now, 30 * months)))


def random_row(df: DataFrame, key: str, seed: int) -> DataFrame:
    """The row whose md5 of seed and key is least: as good as random, and the same however the rows are dealt."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(1)


def ranked(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows in order with their place, rank, from 1 and without ties.  Only the limited rows are numbered."""
    return top(df, order, limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


#: Orders of a list of reviews; undated and unrated ones come last in each.
REVIEW_ORDERS = ("newest", "oldest", "highest", "lowest")


def review_page(df: DataFrame, course: Column, date: Column, quality: Column, row_id: str, chosen: str = "__all__", mode: str = "newest", offset: int = 0, limit: int = 10) -> DataFrame:
    """A page of the reviews of one course, or of all (`__all__`), in one of REVIEW_ORDERS, then as stored."""
    order = dict(zip(REVIEW_ORDERS, (F.desc_nulls_last(date), F.asc_nulls_last(date), F.desc_nulls_last(quality), F.asc_nulls_last(quality))))
    if mode not in order:
        raise ValueError(f"mode must be one of {REVIEW_ORDERS}")
    rows = df if chosen == "__all__" else df.where(course == chosen)
    return page(rows, [order[mode], F.col(row_id)], offset, limit)
