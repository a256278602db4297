"""Language-model scoring with a weighted backoff automaton of order three.

Texts are read once, into blocks of at most about 1.2 million tokens; a very long text is cut into pieces that know the two
words before them.  A block asks for what its own walks need, and only for that:

1. for its distinct words: each bucket of the vocabulary sums the counts of all blocks and sends back numbers (frequent
   words first) and totals;
2. for its distinct trigrams, as numbers, each as far as it differs from the one before: each bucket of pairs sums all
   blocks' counts and sends back the totals of the trigrams and of their pairs;
3. then it builds exactly the part of the automaton that its documents walk through.

No task holds the model, nothing is pruned, and what moves is at most one entry for each distinct word or trigram of a block.
Buckets are as many as the counted entries need, and a block writes to those that it has entries of.

Smoothing: p(w | uv) = (c(uvw) + mu * p(w | v)) / (c(uv) + mu), p(w | v) = (c(vw) + mu * p(w)) / (c(v) + mu), p(w) =
(c(w) + 0.1) / (N + 0.1 * (V + 1)).  A seen n-gram is an arc that weighs log10 of its probability; where a state has no arc
over a word, its failure arc, log10(mu / (c + mu)), leads to the state without its first word.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import kernels as K
from .common import discard, materialize, partitions

ROW = ", ".join(f"{c} {'long' if i < 2 else 'binary'}" for i, c in enumerate(K.LM_ROW))
#: A bucket's task gets about so many entries.
ENTRIES = 1_500_000


def _entries(packed: str) -> Column:
    """The sum of the lengths that packed columns begin with, eight bytes, lowest first."""
    bytes_ = [F.conv(F.hex(F.substring(packed, i, 1)), 16, 10).cast("long") * (1 << 8 * (i - 1)) for i in range(1, 6)]
    return F.coalesce(F.sum(reduce(add, bytes_)), F.lit(0))


def lm_scores(docs: DataFrame, mu: float = 20.0, held_out_of: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text).

    Rows whose crc32(doc_id as text; null as empty) is a multiple of held_out_of are scored but not learned from.  Words are
    runs other than ASCII white space, A-Z lower-cased; an end follows them, so null and empty texts have one token.  Rows
    that repeat are learned from and scored as often as they stand; an empty table gives no rows; other columns are not
    read.  Words, and pairs and trigrams within a bucket, are told apart by 64-bit hashes.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    blocks = materialize(docs.select("doc_id", "text").mapInArrow(lambda it: K.block_rows(it, held_out_of), ROW), "blocks")
    entries = blocks.agg(_entries("d").alias("words"), _entries("c").alias("tokens")).first()
    buckets = {"words": max(partitions(spark), entries.words // ENTRIES + 1), "pairs": max(partitions(spark), entries.tokens // ENTRIES + 1)}
    asks = blocks.select("block", "d", "f").mapInArrow(lambda it: K.word_asks(it, buckets["words"]), "block long, bucket long, a binary, b binary")
    words = materialize(asks.groupBy("bucket").applyInArrow(lambda t: K.word_totals(t, buckets["words"]), "block long, bucket long, a binary, b binary, c binary, d binary"), "words")
    whole = lambda c: F.coalesce(F.sum(F.when(F.length(c) == 8, F.conv(F.hex(c), 16, 10).cast("long"))), F.lit(0))
    total, kinds = words.agg(whole("c"), whole("d")).first()
    none = [F.lit(None).cast("binary").alias(c) for c in "cdef"]
    both = blocks.unionByName(words.select("block", "bucket", "a", "b", *none))
    asked = materialize(both.groupBy("block").applyInArrow(lambda t: K.trigram_asks(t, buckets), ROW), "trigrams")
    discard(blocks, words)
    replies = asked.where("bucket >= 0").groupBy("bucket").applyInArrow(lambda t: K.trigram_totals(t), ROW)
    each = [("rid", T.LongType()), ("doc_id", kind), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    arrow = pa.schema([(c, to_arrow_type(t)) for c, t in each])
    schema = T.StructType([T.StructField(c, t) for c, t in each])
    parts = asked.where("bucket < 0").unionByName(replies).groupBy("block").applyInArrow(lambda t: K.score_block(t, arrow, buckets["pairs"], total, kinds, mu), schema)
    sums = parts.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
