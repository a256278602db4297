"""Mixing sources to target weights by hierarchical budgets.

The tree is domain > language > source.  A node's budget is split among its children by weight; a child that holds less than
its share gives the rest back to its siblings (water-filling with the capacities of whole subtrees), and only what a whole
family cannot use goes to the family's own siblings.  Each leaf then takes whole epochs and a prefix, in tokens, of the next
epoch's seeded order.  Running sums are taken over hash ranges of about RANGE rows, first between and then, only in the range
that the budget cuts, within them, so a leaf with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import freed, held, materialize, sized, small, text_hash

#: Weights of languages; whatever is not named weighs 10, every domain and source weighs 1.
LANG_WEIGHTS = {"en": 40, "de": 20, "fr": 20, "es": 20}
OTHER_LANG = 10
LEVELS = ("domain", "lang", "source")
SHARE_PERCENT, EPOCHS, SEED, RANGE = 60, 2, 17, 2_000


def domain_of(source: Column) -> Column:
    """The letters that a source's name starts with."""
    return F.coalesce(F.regexp_extract(source, "^([A-Za-z]*)", 1), F.lit(""))


def n_tokens(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def leaf_budgets(leaves: DataFrame, share: int = SHARE_PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """leaves (domain, lang, source, tokens) -> the same with budget: whole tokens, at most epochs * tokens each.

    The root's budget is share percent of all tokens.  At each level budgets are floored to whole tokens.
    """
    weight = {"domain": F.lit(1), "lang": F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LANG_WEIGHTS.items() for x in kv)), F.col("lang")), F.lit(OTHER_LANG)), "source": F.lit(1)}
    cap = leaves.withColumn("cap", F.col("tokens") * epochs)
    parents = leaves.agg(F.floor(F.sum("tokens") * share / 100).cast("long").alias("budget"))
    for depth, level in enumerate(LEVELS):
        above, here = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        kids = cap.groupBy(*here).agg(F.sum("cap").alias("cap")).withColumn("w", weight[level].cast("long"))
        if above:
            p = parents.select(*(F.col(c).alias(f"p_{c}") for c in above), "budget")
            on = None
            for c in above:
                same = F.col(c).eqNullSafe(F.col(f"p_{c}"))
                on = same if on is None else on & same
            kids = kids.join(p, on).drop(*(f"p_{c}" for c in above))
        else:
            kids = kids.crossJoin(F.broadcast(parents))  # one row
        order = Window.partitionBy(*(above or [F.lit(0)])).orderBy(F.col("cap") / F.col("w"), level)
        whole = Window.partitionBy(*(above or [F.lit(0)]))
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        kids = kids.withColumn("cap_b", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_b", F.coalesce(F.sum("w").over(before), F.lit(0))).withColumn("w_all", F.sum("w").over(whole))
        rate = (F.col("budget") - F.col("cap_b")) / (F.col("w_all") - F.col("w_b"))
        # a child is full while its capacity is below its share of what the smaller ones left
        kids = kids.withColumn("rate", rate).withColumn("full", F.col("cap") <= F.col("rate") * F.col("w"))
        kids = kids.withColumn("level", F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col(level), F.col("rate").alias("r")))).over(whole))
        got = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.floor(F.col("level.r") * F.col("w")).cast("long")))
        parents = kids.select(*here, got.alias("budget"))
    on = None
    p = parents.select(*(F.col(c).alias(f"p_{c}") for c in LEVELS), "budget")
    for c in LEVELS:
        same = F.col(c).eqNullSafe(F.col(f"p_{c}"))
        on = same if on is None else on & same
    return leaves.join(p, on).drop(*(f"p_{c}" for c in LEVELS))


def order_hash(seed: int, epoch: Column) -> Column:
    """Seeded order of an epoch: md5 of seed, epoch and id, as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mixture(docs: DataFrame, share: int = SHARE_PERCENT, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """Rows that the mixture takes: doc_id, tx, domain, lang, source, n_tokens, epoch (0, 1, ...), one for each time.

    Rows without words cost nothing and come with their place in the order.  Null languages and sources are leaves of their
    own; null ids are ordered as ''; repeated rows are taken as rows, one after another; an empty table gives none; columns
    other than doc_id, text, lang and source are not read.
    """
    base = docs.select("doc_id", text_hash().alias("tx"), domain_of(F.col("source")).alias("domain"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), n_tokens(F.col("text")).alias("n_tokens"))
    base = materialize(base, "lengths")
    leaves = base.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    plan = leaf_budgets(leaves, share, epochs)
    plan = plan.withColumn("leaf", F.xxhash64(*LEVELS)).withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")).withColumn("ranges", F.ceil(F.col("rows") / RANGE).cast("int"))
    plan, size = sized(plan.select(*(F.col(c).alias(f"p_{c}") for c in LEVELS), "leaf", "whole", "rest", "ranges"), "budgets")
    on = None
    for c in LEVELS:
        same = F.col(c).eqNullSafe(F.col(f"p_{c}"))
        on = same if on is None else on & same
    rows = base.join(small(plan, size), on).drop(*(f"p_{c}" for c in LEVELS))
    rows = rows.withColumn("o", order_hash(seed, F.col("whole")))
    rows = rows.withColumn("range", F.floor(F.conv(F.substring("o", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(1 << 32)).cast("int"))
    sums = rows.groupBy("leaf", "range").agg(F.sum("n_tokens").alias("t"))
    run = Window.partitionBy("leaf").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums, size = sized(sums.withColumn("before", F.coalesce(F.sum("t").over(run), F.lit(0))), "ranges")
    rows = rows.join(small(sums.withColumnsRenamed({"leaf": "r_leaf", "range": "r_range"}), size), (F.col("leaf") == F.col("r_leaf")) & (F.col("range") == F.col("r_range"))).drop("r_leaf", "r_range")
    inside = F.col("before") + F.col("t") <= F.col("rest")
    cut = rows.where(~inside & (F.col("before") <= F.col("rest")))
    in_range = Window.partitionBy("leaf", "range").orderBy("o", "doc_id", "tx").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("upto", F.col("before") + F.sum("n_tokens").over(in_range)).where("upto <= rest").drop("upto")
    prefix = rows.where(inside).unionByName(cut).withColumn("epoch", F.col("whole"))
    full = rows.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)))
    return prefix.unionByName(full).select("doc_id", "tx", *LEVELS, "n_tokens", "epoch")


def take_mixture(docs: DataFrame, share: int = SHARE_PERCENT, epochs: int = 1, seed: int = SEED) -> DataFrame:
    """The rows of docs, columns unchanged, that the mixture takes, as often as it takes them.  Equal rows with one id are
    told apart by their place among equals, so each is taken or left by itself."""
    taken = mixture(docs, share, epochs, seed).groupBy(F.col("doc_id").alias("id"), "tx").agg(F.count("*").alias("n"))
    taken, size = sized(taken, "taken")
    rows = held(docs).withColumns({"own": F.col("row.doc_id"), "tz": text_hash("row.text")})
    both = rows.join(small(taken, size), F.col("own").eqNullSafe(F.col("id")) & (F.col("tz") == F.col("tx")))
    if rows.groupBy("own", "tz").agg(F.count("*").alias("c")).where("c > 1").limit(1).count():
        rank = F.row_number().over(Window.partitionBy("tz", "own").orderBy("tz"))
        size = F.count("*").over(Window.partitionBy("tz", "own"))
        both = both.withColumn("n", F.floor((F.col("n") + size - rank) / size))  # dealt to the equal rows in turn
    return freed(both.where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))), docs.columns)
