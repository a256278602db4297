"""Benchmark decontamination: broadcast n-gram hash set, scan of token windows, verification, removal.

Every 13-word window holds, whole, one of the text's seven-word grams that start at multiples of seven.  So the scan hashes
only those grams (a seventh of the positions), probes the hash set of all seven-word grams of the benchmark, and verifies the
few windows around each hit word by word against the benchmark's windows.  Items of m < 13 words are one window; their grams
have (m + 1) / 2 words, by the same argument.  One scan splits each text once and probes grams of all lengths.

The set is broadcast where its measured size allows; beyond that the hashes of the texts' grams meet it in a shuffle, and the
documents that hold any are read a second time.  Items join only the windows that were found.  Everything runs as DataFrame
expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, SEPARATORS, freed, held, let, materialize, sized, text_hash, without, word_array

#: Words of a window, and the windows of a benchmark that is broadcast at most (each has seven grams).
WINDOW, BLOCK_WINDOWS = 13, 200_000


def gram_of(m: int) -> int:
    """Longest gram for which every window of m words holds one that starts at a multiple of its length."""
    return (m + 1) // 2


def grams(words: Column, size: int, step: int) -> Column:
    """Hashes of the grams of `size` words that start at 0, step, ...; words must be bound (let)."""
    last = F.size(words) - size
    at = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(size), *(F.get(words, i + k) for k in range(size))))


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, m (words), win (its words), h (hash) of the distinct windows of each item; a null item_id counts as ''."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), word_array(F.col("text")).alias("w")).where(F.size("w") > 0)
    cut = words.select("item", "w", F.least(F.size("w"), F.lit(window)).alias("m"))
    each = cut.select("item", "m", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1), lambda i: F.slice("w", i, F.col("m")))).alias("win"))
    return each.distinct().withColumn("h", F.xxhash64("m", "win"))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of docs with the windows that stand in them: doc_id, tx, n_words, spans array<struct<s, e, item_ids>>, one row
    for each (doc_id, tx), with copies, the number of equal rows.  s and e are word positions, e exclusive."""
    asked = materialize(windows(items, window), "items")
    wins, size = sized(asked.select("m", "win", "h").distinct(), "windows")
    lengths = [r.m for r in wins.select("m").distinct().orderBy("m").collect()]  # at most `window` rows
    base = docs.select("doc_id", text_hash().alias("tx"), word_array(F.col("text")).alias("w"))
    base = base.select("doc_id", "tx", "w", F.size("w").alias("n_words"))
    none = base.select("doc_id", "tx", "n_words", F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e"), F.lit(None).cast("array<string>").alias("item_ids"))
    if not lengths:
        return _gathered(none)
    by_size = {g: [m for m in lengths if gram_of(m) == g] for g in sorted({gram_of(m) for m in lengths})}
    # g, m: the grams of every window, of the size that its length asks for
    of_m = reduce(lambda a, m: F.when(F.col("m") == m, let(F.col("win"), lambda w: grams(w, gram_of(m), 1))).otherwise(a), lengths, F.lit(None).cast("array<bigint>"))
    set_ = wins.select("m", F.explode(of_m).alias("g")).distinct()
    probe = let(F.col("w"), lambda w: F.concat(*(F.transform(grams(w, g, g), lambda h, k: F.struct((k * g).alias("p"), h.alias("g"))) for g in by_size)))
    few = size.rows <= BLOCK_WINDOWS and size.bytes <= BROADCAST_BYTES
    if few:
        near = base.select("doc_id", "tx", "w", "n_words", F.explode(probe).alias("x")).select("doc_id", "tx", "w", "n_words", "x.p", "x.g").join(F.broadcast(set_), "g")
    else:
        found = base.select("doc_id", "tx", F.explode(probe).alias("x")).select("doc_id", "tx", "x.p", "x.g").join(set_, "g")
        found = materialize(found.select(F.col("doc_id").alias("id"), F.col("tx").alias("tz"), "p", "m").distinct(), "near")
        near = base.join(found, base["doc_id"].eqNullSafe(found["id"]) & (base["tx"] == found["tz"])).select("doc_id", "tx", "w", "n_words", "p", "m")
    # all starts from which a window of m words holds the gram whole
    g = reduce(lambda a, m: F.when(F.col("m") == m, gram_of(m)).otherwise(a), lengths, F.lit(0))
    starts = F.sequence(F.greatest(F.lit(0), F.col("p") - (F.col("m") - g)), F.least(F.col("p"), F.col("n_words") - F.col("m")))
    around = F.when(F.col("n_words") >= F.col("m"), F.transform(starts, lambda s: F.struct(s.alias("s"), F.slice("w", s + 1, F.col("m")).alias("x"))))
    each = near.select("doc_id", "tx", "m", F.explode(around).alias("c")).select("doc_id", "tx", "m", F.col("c.s").alias("s"), F.col("c.x").alias("x"), F.xxhash64("m", "c.x").alias("h"))
    true = each.join(F.broadcast(wins) if few else wins, ["h", "m"]).where("x = win").select("doc_id", "tx", "s", (F.col("s") + F.col("m")).alias("e"), "h", "m")
    ids = asked.groupBy("h", "m", "win").agg(F.sort_array(F.collect_set("item")).alias("item_ids")).drop("win")
    named = true.distinct().join(ids, ["h", "m"]).select("doc_id", "tx", F.lit(None).cast("int").alias("n_words"), "s", "e", "item_ids")
    return _gathered(none.unionByName(named))


def _gathered(rows: DataFrame) -> DataFrame:
    span = F.when(F.col("s").isNotNull(), F.struct("s", "e", "item_ids"))
    return rows.groupBy("doc_id", "tx").agg(F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"), F.sort_array(F.collect_set(span)).alias("spans"))


def covered(spans: Column) -> Column:
    """Words inside the union of sorted spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to"))
    return F.aggregate(spans, start, step, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, tx, n_words, n_hit, item_ids, contaminated of each row of docs (doc_id, text) against items (item_id, text).

    Words: A-Z lower-cased, every ASCII character but letters and digits separates.  A word is hit inside any occurrence of a
    window.  Contaminated: n_hit > 0 and 20 * n_hit >= n_words.  Null and empty texts and items have no words and hit
    nothing; a null item_id counts as ''.  Repeated rows each give their row, null ids are ids; empty tables are fine; other
    columns are not read.
    """
    per = hits(docs, items, window)
    per = per.select("doc_id", "tx", "copies", F.col("n_words").cast("long").alias("n_words"), covered(F.col("spans")).cast("long").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.col("spans.item_ids")))).alias("item_ids"))
    per = per.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))
    return per.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copies", "copy")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, mode: str = "documents") -> DataFrame:
    """docs, columns unchanged, without contaminated rows (mode "documents"), or with the hit words of contaminated rows cut
    from their text (mode "spans"), each with the separators that follow it."""
    if mode == "documents":
        return without(docs, contamination(docs, items, window).where("contaminated").select(F.col("doc_id").alias("id"), "tx"))
    per = hits(docs, items, window).where(F.size("spans") > 0).withColumn("n", covered(F.col("spans"))).where("20 * n >= n_words")
    bad = per.select(F.col("doc_id").alias("id"), "tx", "spans")
    rows = held(docs).withColumn("tz", text_hash("row.text"))
    both = rows.join(bad, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("tz") == F.col("tx")), "left")
    own = SEPARATORS.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    words = F.array_remove(F.split("row.text", own), "")
    gaps = F.split("row.text", own.replace("[", "[^", 1))  # what stands before, between and after the words
    piece = lambda w, i: F.when(F.exists("spans", lambda x: (x["s"] <= i) & (i < x["e"])), F.lit("")).otherwise(F.concat(w, F.coalesce(F.get("gaps", i + 1), F.lit(""))))
    cut = F.concat(F.coalesce(F.get("gaps", F.lit(0)), F.lit("")), F.array_join(F.transform("words", piece), ""))
    made = both.withColumn("words", words).withColumn("gaps", gaps)
    return freed(made, docs.columns, text=F.when(F.col("spans").isNotNull(), cut).otherwise(F.col("row.text")))
