"""Text functions: Column -> Column.  Only the accent folding of non-ASCII texts leaves the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Unicode white space: regexp and trim of their own know only part of it.
SPACE = r"(?U)\s+"


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def fold(text: Column) -> Column:
    """Decompose characters and drop what is not ASCII.  No built-in does this; texts travel in Arrow batches."""

    def fold_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii")
        for texts in batches:
            yield texts.map(one, na_action="ignore")

    fold_all.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(fold_all, "string")(text)


def name_key(name: Column) -> Column:
    """Key by which names are compared: lower case, folded to ASCII, blanks collapsed; null stays null."""
    lowered = F.lower(F.trim(name))
    plain = F.length(lowered) == F.octet_length(lowered)
    # a null argument keeps plain texts out of Python
    folded = F.when(plain, lowered).otherwise(fold(F.when(~plain, lowered)))
    return collapse(folded)


def slug(key: Column) -> Column:
    """Runs of anything but a-z and 0-9 become one hyphen; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(key), "[^a-z0-9]+", "-"), "^-|-$", "")


def title_case(text: Column) -> Column:
    """Every run of letters starts with a capital: o'brien smith-jones -> O'Brien Smith-Jones."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda t: F.initcap(t)), "")


def tokens(key: Column) -> Column:
    """Words of a collapsed text; an empty one has none."""
    return F.array_remove(F.split(key, " "), "")


def first_token(key: Column) -> Column:
    return F.get(tokens(key), F.lit(0))


def last_token(key: Column) -> Column:
    return F.try_element_at(tokens(key), F.lit(-1))


def initials(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, " "), lambda t: F.left(t, F.lit(1))), "")


def nullif_blank(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def course_code(label: Column) -> Column:
    """What stands before the first colon."""
    return F.substring_index(label, ":", 1)


#: Forms of course labels, and of terms.
CODED = r"^([A-Z]+\d+):\d+\s+\((.+?)\)"
CODE_ONLY = r"^([A-Z]+\d+)(?::\d+)?\s*\("
BRACKETED = r"\((.+?)\)"
SEASON_NAME = r"(?i)(spring|summer|fall|winter)"
YEAR = r"\b(20\d{2})\b"


def parse_course(label: Column) -> Column:
    """CODE123:02 (Title) ... -> struct<code, title>, both null where the form differs."""
    return F.struct(nullif_blank(F.regexp_extract(label, CODED, 1)).alias("code"), nullif_blank(F.regexp_extract(label, CODED, 2)).alias("title"))


def lenient_code(label: Column) -> Column:
    """The code with or without section number, else the first word."""
    return F.coalesce(nullif_blank(F.regexp_extract(label, CODE_ONLY, 1)), F.substring_index(F.substring_index(label, ":", 1), " ", 1))


def in_brackets(label: Column) -> Column:
    """The first text in round brackets, or null."""
    return nullif_blank(F.regexp_extract(label, BRACKETED, 1))


def term_season(term: Column) -> Column:
    return nullif_blank(F.initcap(F.regexp_extract(term, SEASON_NAME, 1)))


def term_year(term: Column) -> Column:
    return F.regexp_extract(term, YEAR, 1).try_cast("int")


def clean_term(term: Column) -> Column:
    """Season and year as `Fall 2024`; only the season without a year; the trimmed text without a season."""
    season, year = term_season(term), term_year(term)
    return F.when(season.isNull(), F.trim(term)).when(year.isNull(), season).otherwise(F.concat_ws(" ", season, year.cast("string")))


#: Order of the seasons within a year.
SEASONS = ("Spring", "Summer", "Fall", "Winter")


def season_rank(term: Column) -> Column:
    """1 for Spring to 4 for Winter; 0 where unknown."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEASONS)), F.split_part(term, F.lit(" "), F.lit(1))), F.lit(0))


def split_tags(text: Column, delimiter: str) -> Column:
    """Trimmed, non-empty parts."""
    literal = "".join("\\" + c if not c.isalnum() else c for c in delimiter)
    return F.filter(F.transform(F.split(text, literal), lambda t: F.trim(t)), lambda t: t != "")


def strip_question(text: Column) -> Column:
    """Without a leading `Q:`."""
    return F.trim(F.regexp_replace(text, r"^Q:", ""))


#: For each attribute of a review, the text besides `true` that stands for yes, and how yes and anything else are shown.
ATTRIBUTES = {
    "attendance": ("Mandatory", "Mandatory", "Not Mandatory"),
    "textbook": ("Yes", "Yes", "No"),
    "online_class": ("Yes", "Online", "In-Person"),
}


def attribute(value: Column, name: str) -> Column:
    """How an attribute of a review is shown; missing and `N/A` are not."""
    yes, shown, other = ATTRIBUTES[name]
    return F.when(F.coalesce(value, F.lit("")).isin("", "N/A"), None).when(value.isin("true", yes), shown).otherwise(other)


def file_name(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "[^a-zA-Z0-9]", "_"))


def base64_id(kind: str, number: Column) -> Column:
    return F.base64(F.concat(F.lit(kind + "-"), number.cast("string")).cast("binary"))
