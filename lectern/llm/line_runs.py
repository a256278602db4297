"""Line dedup by a suffix array over line sequences, built by distributed prefix doubling.

Lines with a word, in order, are the letters of one long string (documents in order of id, never across their ends).  Round k
ranks the suffix at every place by its first 2^k lines: a suffix's rank is its rank by 2^(k-1) lines plus the number of
suffixes of that rank whose second halves rank lower.  Places that share their rank with no other drop out of all further
rounds; what is left after the last round is the suffix array of everything that repeats, ordered to the depth of that round.

Suffixes whose longest common prefix has n lines stand together in it: the interval of a run of n lines is named by two
ranks of depth 2^q <= n, at the run's start and 2^q lines before its end.  Every place of an interval but the first, in
document order, starts a later copy.

A maximal repeated run of MIN_WORDS words or more is deleted whole from its later copies.  It needs no other intervals than
those of minimal runs: the shortest run of MIN_WORDS words from each line, and the shortest one up to each line.  Each line
of a maximal run lies in the shortest run from the run's first line, or ends a shortest run that begins no earlier; both are
parts of the maximal run, so both have an earlier copy where it has one.  Conversely each of them is itself a repeated run.
A minimal run has at most MIN_WORDS lines, which bounds the depth of the suffix array, not the length of the runs found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, freed, held, materialize, sized

#: Repeated runs of at least so many words are deleted; so a minimal run has at most MIN_WORDS lines.
MIN_WORDS = 50
#: Ranks are summed within ranges that hold about so many values of the second half, and between ranges.
RANGE = 100_000
#: Words of a line, as the contract of the corpus operators has them.
BLANKS = r"[\x20\x09-\x0D]+"


def _lines(docs: DataFrame) -> DataFrame:
    """rid, doc_id, line (number in the text), c (hash of the line), w (its words): one row for each line with a word.  Each text
    is split once and unfolded, so the work is linear in its length."""
    whole = docs.select("rid", "doc_id", F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("line", "x"))
    words = F.size(F.array_remove(F.split("x", BLANKS), ""))
    return whole.where(F.col("x").rlike(r"[^\x20\x09-\x0D]")).select("rid", "doc_id", "line", F.xxhash64("x").alias("c"), words.alias("w"))


def _placed(lines: DataFrame, min_words: int) -> DataFrame:
    """lines with pos (from 0 among a text's lines with words), n_from and n_to: the lines of the shortest runs of min_words words
    from and up to the line, null where the text has too few.  Running sums stream through windows of one text."""
    text = Window.partitionBy("rid")
    order = text.orderBy("line")
    sums = lines.select("*", (F.row_number().over(order) - 1).alias("pos"), F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    sums = sums.withColumn("below", F.col("upto") - F.col("w"))
    ahead = F.count("*").over(text.orderBy("below").rangeBetween(0, min_words - 1))
    behind = F.count("*").over(text.orderBy("upto").rangeBetween(1 - min_words, 0))
    # a run is long enough if the words from its first line on, or up to its last, are
    reach = F.max("upto").over(text.orderBy("below").rangeBetween(0, min_words - 1)) - F.col("below")
    return sums.select("rid", "doc_id", "line", "pos", "c", F.when(reach >= min_words, ahead).alias("n_from"), F.when(F.col("upto") >= min_words, behind).alias("n_to"))


def _ranked(pairs: DataFrame, bucket: Column, tag: str) -> DataFrame:
    """r, s, rank: the order of the repeated (r, s) pairs, each standing for its number of places.

    Sums go over ranges of s within r first, then inside a range, so no task holds more than the ranges of one r, or a range:
    a very frequent line, which is one r with many s, is spread over its ranges.
    """
    counts = pairs.groupBy("r", "s").agg(F.count("*").alias("k")).where("k > 1").withColumn("range", bucket)
    by_range = Window.partitionBy("r").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("r", "range").agg(F.sum("k").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(by_range), F.lit(0))).drop("t")
    inside = Window.partitionBy("r", "range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("upto", F.coalesce(F.sum("k").over(inside), F.lit(0))).join(sums, ["r", "range"])
    return materialize(placed.select("r", "s", (F.col("r") + F.col("before") + F.col("upto")).alias("rank")), tag)


def suffix_ranks(lines: DataFrame, n_lines: int, depth: int) -> list[DataFrame]:
    """For k = 0, 1, ... while 2^k <= depth and anything repeats: rid, pos, r of each place whose first 2^k lines stand twice.

    Equal r means equal lines, and a smaller r a smaller run in the order of line hashes.  Lines are told apart by 64-bit hashes.
    """
    # the hash's upper bits range over as many values as keep RANGE lines in each, at any number of lines
    bits = (n_lines // RANGE).bit_length()
    first = lines.select("rid", "pos", F.lit(0).cast("long").alias("r"), F.col("c").alias("s"))
    bucket = F.shiftright("s", 64 - bits) if bits else F.lit(0).cast("long")
    step, levels, pairs = 1, [], first
    while True:
        ranks = _ranked(pairs, bucket, "ranks")
        level, size = sized(pairs.join(ranks, ["r", "s"]).select("rid", "pos", F.col("rank").alias("r")), "level")
        discard(ranks, *([pairs] if levels else []))
        levels.append(level)
        if 2 * step > depth or not size.rows:
            return levels
        ahead = level.select("rid", (F.col("pos") - step).alias("pos"), F.col("r").alias("s"))
        pairs = materialize(level.join(ahead, ["rid", "pos"]).select("rid", "pos", "r", "s"), "pairs")
        bucket = F.floor(F.col("s") / RANGE)
        step *= 2


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(placed lines, runs): rid, pos, n of the later copies of every minimal repeated run of docs (rid, doc_id, text; rid unique)."""
    placed, size = sized(_placed(_lines(docs), min_words), "lines")
    levels = suffix_ranks(placed.select("rid", "pos", "c"), size.rows, min_words)
    # a shortest run up to a line begins n_to - 1 lines before it; where that is also a shortest run from there, it is the same run
    forward = placed.where("n_from is not null").select("rid", "doc_id", "pos", F.col("n_from").alias("n"))
    backward = placed.where("n_to is not null").select("rid", "doc_id", (F.col("pos") - F.col("n_to") + 1).alias("pos"), F.col("n_to").alias("n"))
    named = None
    for q, level in enumerate(levels):
        mine = forward.unionByName(backward).where((F.col("n") >= 1 << q) & (F.col("n") < 2 << q))
        tail = level.select("rid", F.col("pos").alias("tail"), F.col("r").alias("to"))
        got = mine.join(level, ["rid", "pos"]).withColumn("tail", F.col("pos") + F.col("n") - (1 << q)).join(tail, ["rid", "tail"])
        got = got.select("rid", "doc_id", "pos", "n", "r", "to")
        named = got if named is None else named.unionByName(got)
    named = materialize(named, "runs")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "rid", "pos")
    first = named.groupBy("n", "r", "to").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last")
    first = materialize(first.select("n", "r", "to", F.col("first.rid").alias("f_rid"), F.col("first.pos").alias("f_pos")), "intervals")
    return placed, named.join(first, ["n", "r", "to"]).where("rid <> f_rid or pos <> f_pos").select("rid", "pos", "n")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """rid, line: the lines of docs (rid, doc_id, text; rid unique) that later copies of repeated runs cover."""
    placed, later = repeated_runs(docs, min_words)
    gone = later.select("rid", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("pos")).distinct()
    return placed.select("rid", "pos", "line").join(gone, ["rid", "pos"], "left_semi").select("rid", "line")


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines (split at newlines), n_removed, removed (array of line numbers from 0) of each row of docs (doc_id, text).

    A line is removed if it lies in a run of lines with words that has min_words words or more and an earlier copy, in order of
    doc_id (null last), then of the rows as read, then of the lines.  Null texts have one, empty, line.  Equal rows are told
    apart by their place as read.  An empty table gives no rows; other columns are not read.
    """
    keyed = materialize(docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id()), "numbered")
    gone = repeated_lines(keyed, min_words).groupBy("rid").agg(F.sort_array(F.collect_list("line")).alias("removed"))
    whole = keyed.select("rid", "doc_id", F.size(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).cast("long").alias("n_lines"))
    out = whole.join(gone, "rid", "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, columns unchanged, with the repeated lines deleted from text; texts left without lines are empty, null stays null."""
    keyed = materialize(held(docs).withColumn("rid", F.monotonically_increasing_id()), "numbered")
    gone = repeated_lines(keyed.select("rid", "row.doc_id", "row.text"), min_words).groupBy("rid").agg(F.collect_list("line").alias("gone"))
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept)
    return freed(keyed.join(gone, "rid", "left"), docs.columns, text=text)
