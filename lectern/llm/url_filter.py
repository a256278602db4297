"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

URLs that a rule judges are the labelled ones.  Statistics of suffixes count all of them; the trees are fitted on a sample of
at most SAMPLE distinct labelled URLs (of each verdict those with the smallest hashes, half the places each, free ones to the
other), which weigh as many rows as they stand for, and the fitted trees judge every URL that no rule fits.  A labelled URL's
suffix rate leaves out the labels of its own fold, so the trees cannot read a URL's label from its rate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import kernels as K
from .common import LOWER, UPPER, materialize

#: Fixed values: (host, path prefix, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: Bounds of the fit: labelled URLs, trees and their depth.
SAMPLE, TREES, DEPTH, RATE, BINS = 20_000, 40, 3, 0.3, 32
#: Labelled URLs are dealt to so many folds by hash.
FOLDS = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end; else both ''."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, else nulls."""
    name, verdict = None, None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, label (the rule's verdict), suffix_rate and folder_rate: the shrunk share of blocked URLs
    among the labelled ones of other folds with the host's last two labels, and with the path's first folder there too."""
    url = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumn("url", F.coalesce("url", F.lit("")))
    host, path = host_and_path(F.col("url"))
    parts = url.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = _rule(F.col("host"), F.col("path"), rules)
    suffix = F.substring_index("host", ".", -2)
    parts = parts.select("*", name.alias("rule"), verdict.alias("label"), suffix.alias("suffix"), F.concat(suffix, F.regexp_extract("path", "^/[^/]*", 0)).alias("folder"), fold_of(F.col("url")).alias("fold"))
    parts = _rate(_rate(parts, "suffix", F.lit(0.5)), "folder", F.col("suffix_rate"))
    return parts.select("page_id", "url", "host", "path", "rule", "label", "suffix_rate", "folder_rate")


def _rate(parts: DataFrame, key: str, prior: Column) -> DataFrame:
    """parts with <key>_rate: blocked labels of the key, and two of the prior rate, by all of them; a labelled URL's own fold is
    left out."""
    blocked = F.col("label") == "block"
    sums = lambda f: F.struct(F.count_if(blocked & f).alias("b"), F.count_if(f).alias("n"))
    stats = parts.where("label is not null").groupBy(key).agg(sums(F.lit(True)).alias("all"), F.array(*(sums(F.col("fold") == i) for i in range(FOLDS))).alias("by_fold"))
    left = lambda k: F.coalesce(F.col(f"all.{k}") - F.when(F.col("label").isNotNull(), F.get("by_fold", F.col("fold"))[k]).otherwise(0), F.lit(0))
    return parts.join(stats, key, "left").withColumn(f"{key}_rate", (left("b") + 2 * prior) / (left("n") + 2)).drop("all", "by_fold")


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), url), F.lit(FOLDS)).cast("int")


def _sample(rows: DataFrame, sample: int) -> tuple[list, np.ndarray]:
    """At most sample distinct labelled URLs, and the rows each stands for: its own times the share of its verdict's rows in all
    to those in the sample."""
    columns = ["url", "host", "path", "suffix_rate", "folder_rate", "label"]
    each = materialize(rows.where("label is not null").groupBy(*columns).agg(F.count("*").alias("n")), "labelled")
    blocked = F.col("label") == "block"
    total = {r.blocked: r.n for r in each.groupBy(blocked.alias("blocked")).agg(F.sum("n").alias("n")).collect()}
    found = {v: each.where(blocked == v).orderBy(F.xxhash64("url"), "url").limit(sample).collect() for v in (False, True)}
    picked, weights = [], []
    for v, most in ((v, max(sample // 2, sample - len(found[not v]))) for v in (False, True)):
        some = found[v][:most]
        held = sum(r.n for r in some)
        picked += some
        weights += [r.n * total[v] / held for r in some]
    return picked, np.array(weights, float)


def _features(rows: list) -> np.ndarray:
    return K.url_features([r.url for r in rows], [r.host for r in rows], [r.path for r in rows], [r.suffix_rate for r in rows], [r.folder_rate for r in rows])


def _fit(picked: list, weights: np.ndarray):
    return K.fit_trees(_features(picked), np.array([r.label == "block" for r in picked], float), TREES, DEPTH, RATE, BINS, weights)


def held_out_accuracy(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> float:
    """Share of the rows of one fold of the sampled labelled URLs that trees fitted on the other folds judge right."""
    rows = judged(pages, rules).withColumn("fold", fold_of(F.col("url")))
    learned, weights = _sample(rows.where("fold > 0"), sample)
    model = _fit(learned, weights)
    asked, weights = _sample(rows.where("fold = 0"), sample)
    right = (K.predict(model, _features(asked)) >= 0.5) == np.array([r.label == "block" for r in asked], bool)
    return float(np.average(right, weights=weights))


def url_verdicts(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block of each row of pages (page_id, url).

    A rule fits its host and all subdomains if the path starts with its path; the longest wins.  Where none fits, the trees
    judge: block from a probability of one half on.  Without labelled URLs of both verdicts the only one is given, or allow.
    Null urls count as ''; repeated rows and null ids are rows of their own; an empty table gives none; other columns are not
    read.
    """
    kind = pages.schema["page_id"].dataType
    rows = judged(pages, rules)
    picked, weights = _sample(rows, sample)
    model = _fit(picked, weights)
    arrow = pa.schema([("page_id", to_arrow_type(kind)), *((c, pa.string()) for c in ("host", "path", "rule", "verdict")), ("p_block", pa.float64())])
    schema = T.StructType([T.StructField("page_id", kind), *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")), T.StructField("p_block", T.DoubleType())])
    return rows.select("page_id", "url", "host", "path", "rule", "label", "suffix_rate", "folder_rate").mapInArrow(lambda it: K.url_rows(it, model, arrow), schema)


