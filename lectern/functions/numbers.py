"""Numeric and date functions: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """A double, or null where the text is none (NaN counts as missing)."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


def whole(text: Column, default: int = 0) -> Column:
    """Missing becomes the default; fractions are cut off."""
    return F.coalesce(number(text), F.lit(default)).cast("bigint")


def percent(text: Column) -> Column:
    """`85%` -> 85.0; negative or unreadable is null."""
    value = number(F.replace(F.trim(text), F.lit("%"), F.lit("")))
    return F.when(value >= 0, value)


def positive(value: Column) -> Column:
    return F.when(value > 0, value)


#: The counted answers, best first.
ANSWERS = (5, 4, 3, 2, 1)


def answer_count(counts: dict[int, Column]) -> Column:
    total = F.lit(0)
    for k in ANSWERS:
        total = total + F.coalesce(counts[k], F.lit(0))
    return total


def answer_sum(counts: dict[int, Column]) -> Column:
    total = F.lit(0)
    for k in ANSWERS:
        total = total + k * F.coalesce(counts[k], F.lit(0))
    return total


def answer_mean(counts: dict[int, Column]) -> Column:
    """Mean of a histogram of answers; null without answers."""
    return F.try_divide(answer_sum(counts).cast("double"), F.nullif(answer_count(counts), F.lit(0)).cast("double"))


def blend(a: Column, a_count: Column, b: Column, b_count: Column) -> Column:
    """Both sources: their mean; one: that one; none: 0."""
    has_a, has_b = F.coalesce(a_count, F.lit(0)) > 0, b.isNotNull() & (F.coalesce(b_count, F.lit(0)) > 0)
    has_a = has_a & (F.coalesce(a, F.lit(0.0)) > 0)
    return F.when(has_a & has_b, (a + b) / 2).when(has_b, b).when(has_a, a).otherwise(0.0)


def round_binary(value: Column, digits: int) -> Column:
    """Rounded half to even on the exact binary value, so 2.675 becomes 2.67 and 0.125 becomes 0.12; null stays null.

    The product with 10 ** digits is taken without error, as a double p and what p lacks (the value is split into halves whose
    products with so short a factor are exact), so a p that stands at a half shows on which side of it the product lies.
    Exact below 1e12 and for up to seven digits.
    """
    if not 0 <= digits <= 7:
        raise ValueError("digits must be 0 to 7")
    ten, split = float(10**digits), float(2**27 + 1)

    def once(v: Column) -> Column:
        high = v * split - (v * split - v)
        p = v * ten
        lacks = (high * ten - p) + (v - high) * ten
        near = F.rint(p)
        # at a half, rint takes the even side; the exact product may lie on the other one
        return F.when((p - near == 0.5) & (lacks > 0), near + 1).when((p - near == -0.5) & (lacks < 0), near - 1).otherwise(near) / ten

    return F.get(F.transform(F.array(value.cast("double")), once), F.lit(0))  # the value is computed once


def score_band(value: Column) -> Column:
    return F.when(value.isNull(), "neutral").when(value >= 4, "high").when(value >= 3, "mid").otherwise("low")


def difficulty_band(value: Column) -> Column:
    return F.when(value.isNull(), "neutral").when(value <= 2, "high").when(value <= 3, "mid").otherwise("low")


def clamp_percent(value: Column, top: float = 5.0) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(top)) / top * 100


def friendly_count(n: Column) -> Column:
    """Below 100 as it is; from there floored to hundreds, with separators and a plus sign."""
    return F.when(n < 100, n.cast("string")).otherwise(F.concat(F.format_number(F.floor(n / 100) * 100, 0), F.lit("+")))


def parse_friendly(text: Column) -> Column:
    """struct<value bigint, rest string> of a friendly count."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    return F.struct(F.regexp_extract(plain, r"^(\d+)(.*)$", 1).try_cast("bigint").alias("value"), F.regexp_extract(plain, r"^(\d+)(.*)$", 2).alias("rest"))


def percent_text(value: Column) -> Column:
    """No decimals, ties to even."""
    return F.concat(F.bround(value).cast("bigint").cast("string"), F.lit("%"))


def iso_date(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis.cast("bigint")), "yyyy-MM-dd")


def read_date(text: Column) -> Column:
    """yyyy-MM-dd, or null."""
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def show_date(text: Column) -> Column:
    """`March 3, 2024`, or the text as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "MMMM d, yyyy"), text)


def url_key(url: Column) -> Column:
    """struct<course, person, term> of `...?sp=C&sp=I&sp=T` or a path `.../C/I/T`; null parts where neither fits."""
    query, path = r"sp=(\d+)&sp=(\d+)&sp=(\d+)", r"(?:^|/)(\d+)/(\d+)/(\d+)(?:$|[/?#])"
    part = lambda i: F.coalesce(F.regexp_extract(url, query, i).try_cast("bigint"), F.regexp_extract(url, path, i).try_cast("bigint"))
    return F.struct(part(1).alias("course"), part(2).alias("person"), part(3).alias("term"))


def report_url(base: str, course: Column, person: Column, term: Column) -> Column:
    return F.concat(F.lit(base + "?sp="), course.cast("string"), F.lit("&sp="), person.cast("string"), F.lit("&sp="), term.cast("string"))
