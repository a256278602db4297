"""N-gram Jaccard self-join with set-relation skipping.

1. Each text becomes its set of five-word shingles, written once to the shared folder.  Of equal sets one goes on, whatever
   tasks they stand in, so a group of copies costs its digests only.
2. Shingles of the low part of each set are counted; the frequent ones (a bounded table) come last in the order that
   fixes every set's prefix, so passages that many documents share start no candidate.
3. Sets that share a minimum under one of six mixes get a common label; labels are cut into chunks of similar sets.
4. Prefix entries meet in lists by shingle.  Short lists compare sizes and positions; long ones skip whole blocks
   (chunks) by the sizes and positions they can still reach.  What is left is pairs (chunk, set), not pairs of sets.
5. Each (chunk, set) is answered exactly: the intersection with the chunk's most typical set is computed, and the answer of
   each member that is similar enough to it is derived from that one by the shingles in which the two differ.  A member
   that differs in more shingles than it has is answered by itself, so a stray costs its own shingles only.
6. Links become components by alternating stars; their numbers are summed by set where they are found, so no pair is
   written for them.

No step is sampled or capped: the order of shingles, the labels and chunks decide only how much work is done.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import BROADCAST_ROWS, Size, components, freed, held, materialize, partitions, sized, small, text_hash, without

#: A shingle in the counted part of more sets than this is frequent; at most FREQUENT of them are kept (8 MB at the driver).
COMMON, FREQUENT = 8, 1 << 18


#: A list task gets about so many prefix entries, and a chunk at most so many shingles (but for one set of more).
ENTRIES, CHUNK_TOKENS = 2_000_000, 1 << 21


def shingle_sets(docs: DataFrame) -> tuple[DataFrame, Size]:
    """rid, doc_id, tx (hash of the text), n, dup_of, toks, mh, digest of each row of docs, as a table in the shared folder."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("doc_id", kind), T.StructField("tx", T.LongType()), T.StructField("n", T.LongType()), T.StructField("dup_of", T.LongType()), T.StructField("toks", T.BinaryType()), T.StructField("mh", T.ArrayType(T.LongType())), T.StructField("digest", T.BinaryType())])
    arrow = pa.schema([("rid", pa.int64()), ("doc_id", _arrow(kind)), ("tx", pa.int64()), ("n", pa.int64()), ("dup_of", pa.int64()), ("toks", pa.binary()), ("mh", pa.list_(pa.int64())), ("digest", pa.binary())])
    return sized(docs.select("doc_id", text_hash().alias("tx"), "text").mapInArrow(lambda it: K.set_rows(it, arrow), schema), "sets")


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _frequent(sets: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    least, most = COMMON, max(1, FREQUENT // buckets)
    blobs = sets.select("toks").mapInArrow(lambda it: K.count_rows(it, buckets), "bucket long, blob binary")
    got = blobs.groupBy("bucket").applyInArrow(lambda t: K.frequent(t, least, most), "keys binary, counts binary").collect()
    keys = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r.keys, np.int64) for r in got)])
    counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r.counts, np.int64) for r in got)])
    order = np.argsort(keys)
    return keys[order], counts[order]


def _chunks(sets: DataFrame) -> DataFrame:
    """(rid, chunk) of the sets that share a label with others; chunk is negative, so no rid is one.  A label's sets are dealt to
    as many chunks as keep CHUNK sets and CHUNK_TOKENS shingles in each."""
    mins = sets.select("rid", F.posexplode("mh").alias("k", "m"))
    lead = mins.groupBy("k", "m").agg(F.min("rid").alias("lead"), F.max("rid").alias("last")).where("lead <> last").drop("last")
    first = materialize(mins.join(materialize(lead, "minima"), ["k", "m"]).groupBy("rid").agg(F.min("lead").alias("lead")), "labels")
    up = first.select(F.col("rid").alias("lead"), F.col("lead").alias("label"))
    label = first.join(up, "lead", "left").select("rid", F.coalesce("label", "lead").alias("label")).join(sets.select("rid", "n"), "rid")
    label = materialize(label, "labelled")
    parts = F.ceil(F.greatest(F.col("c") / K.CHUNK, F.col("t") / CHUNK_TOKENS)).cast("long")
    many, size = sized(label.groupBy("label").agg(F.count("*").alias("c"), F.sum("n").alias("t")).where("c > 1").select("label", parts.alias("parts")), "families")
    chunk = F.xxhash64("label", F.pmod(F.xxhash64("rid"), "parts")).bitwiseOR(F.lit(-(1 << 63)).cast("long"))
    return label.join(small(many, size), "label").select("rid", chunk.alias("chunk"))


def _equal(sets: DataFrame) -> tuple[DataFrame, Size]:
    """(rid, lead) of the sets that equal one of another task; lead is the smallest rid of them.  Only digests move."""
    keyed = sets.where("n > 0 and dup_of is null").select("rid", "digest")
    lead, size = sized(keyed.groupBy("digest").agg(F.min("rid").alias("lead"), F.max("rid").alias("last")).where("lead <> last").drop("last"), "digests")
    return sized(keyed.join(small(lead, size), "digest").where("rid <> lead").select("rid", "lead"), "equal")


def _distinct(sets: DataFrame, equal: DataFrame, size: Size) -> DataFrame:
    """The sets with tokens that are not in equal.  Beyond a broadcast they are shuffled once, into a table."""
    whole = sets.where("toks is not null")
    if not size.rows:
        return whole
    left = whole.join(small(equal.select("rid"), size), "rid", "left_anti")
    return left if size.rows <= BROADCAST_ROWS else materialize(left, "distinct")


def _copies(sets: DataFrame, equal: DataFrame, size: Size) -> tuple[DataFrame, Size]:
    """(rid, copies): the rows that hold an equal set, itself among them, of each set that goes on for more than one."""
    task = sets.where("n > 0").groupBy(F.coalesce("dup_of", "rid").alias("rid")).agg(F.count("*").alias("c"))
    all_ = task.join(small(equal, size), "rid", "left").groupBy(F.coalesce("lead", "rid").alias("rid")).agg(F.sum("c").alias("copies"))
    return sized(all_.where("copies > 1"), "copies")


def links(sets: DataFrame, size: Size) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of rids that connect all sets that linked pairs connect: every link lies within a component of them; and
    (rid, n_links): the rows that link with the set, of each first set of its kind in a task that has links."""
    # a set's prefix is a quarter of its shingles, six bytes each
    buckets = max(partitions(sets.sparkSession), size.bytes // (6 * 4 * ENTRIES) + 1)
    equal, n_equal = _equal(sets)
    copies, n_copies = _copies(sets, equal, n_equal)
    whole = _distinct(sets, equal, n_equal)
    hot_keys, hot_counts = _frequent(whole, buckets)
    places, n_places = sized(_chunks(whole).join(copies, "rid", "full_outer"), "places")
    placed = whole.join(small(places, n_places), "rid", "left").withColumn("chunk", F.coalesce("chunk", "rid")).withColumn("copies", F.coalesce("copies", F.lit(1)))
    entries = placed.select("rid", "toks", "chunk").mapInArrow(lambda it: K.list_rows(it, buckets, hot_keys, hot_counts), "bucket long, head binary, q binary, pos binary, own binary")
    packed = entries.groupBy("bucket").applyInArrow(lambda t: K.list_pairs(t, buckets), "target long, blob binary")
    pairs, n_pairs = sized(packed.groupBy("target").applyInArrow(lambda t: K.merge_pairs(t), "chunk long, rid long"), "pairs")
    salts, n_salts = sized(pairs.groupBy("chunk").agg(F.ceil(F.count("*") / 4096).cast("int").alias("salts"), F.max((F.col("rid") < 0).cast("int")).alias("own")), "salts")
    right = pairs.where("rid >= 0").join(small(salts.select("chunk", "salts"), n_salts), "chunk")
    right = right.select("rid", F.col("chunk").alias("to"), F.pmod(F.xxhash64("rid"), "salts").cast("int").alias("salt"))
    right = right.join(small(copies, n_copies), "rid", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    right = whole.select("rid", "toks").join(small(right, n_pairs), "rid").select(F.col("to").alias("chunk"), "salt", F.lit(2).alias("role"), "rid", "toks", "copies")
    left = placed.select("rid", "toks", "chunk", "copies").join(small(salts, n_salts), "chunk").select("chunk", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(1).alias("role"), "rid", "toks", "copies")
    own = salts.where("own = 1").select("chunk", F.lit(0).alias("salt"), F.lit(0).alias("role"), F.lit(None).cast("long").alias("rid"), F.lit(None).cast("binary").alias("toks"), F.lit(0).cast("long").alias("copies"))
    rows = left.unionByName(right).unionByName(own).repartition(buckets, "chunk", "salt").sortWithinPartitions("chunk", "salt", "role")
    found = materialize(rows.select("chunk", "salt", "role", "rid", "toks", "copies").mapInArrow(K.verify_rows, "a long, b long, n long"), "found")
    edges = found.where("b is not null").select("a", "b").union(sets.where("dup_of is not null").select("rid", "dup_of")).union(equal)
    counts = found.where("b is null").select(F.col("a").alias("rid"), "n").union(copies.select("rid", F.col("copies") - 1))
    degrees = counts.groupBy("rid").agg(F.sum("n").alias("n_links"))
    others = equal.join(degrees.withColumnRenamed("rid", "lead"), "lead").select("rid", "n_links")
    return edges, degrees.union(others)


def ngram_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, n_links, rid.

    Words are runs other than ASCII white space, A-Z lower-cased; a set holds the distinct five-word shingles, a shorter
    text's whole sequence, and nothing for null or wordless text, which links with nothing.  Rows link when
    100 * intersection >= 75 * union.  n_links counts the other rows that a row
    links with, equal ones too.  component_id is the smallest doc_id reachable (null ids do not count; a component
    of null ids has null).  Rows that repeat, ids that repeat and null ids are rows of their own.  An empty table gives
    none.  Only doc_id and text are read, so other columns may have any name.  Sets hold 48-bit hashes of shingles: two
    different shingles of a compared pair agree with a chance of about n * n / 2.8e14.
    """
    sets, size = shingle_sets(docs)
    edges, degrees = links(sets, size)
    roots, n = sized(components(edges), "roots")
    named = sets.select("rid", "doc_id", "tx", "n", F.coalesce("dup_of", "rid").alias("first")).join(small(roots.select(F.col("node").alias("rid"), "root"), n), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    linked = roots.union(roots.select("root", "root").distinct()).toDF("rid", "root")
    twice = Size(2 * n.rows, 2 * n.bytes)
    least, n_least = sized(sets.select("rid", "doc_id").join(small(linked, twice), "rid").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    # only sets of roots have links
    out = named.join(small(least, n_least), "root", "left").join(small(degrees.withColumnRenamed("rid", "first"), twice), "first", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "rid", "root", "tx")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, columns unchanged, but for one row of each component of linked rows: that of the smallest id
    (null last), then the first as read.  Rows without words all stay; a row repeated in full stays once."""
    found = materialize(ngram_components(docs.select("doc_id", "text")), "components")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "rid", "tx")
    best, size = sized(found.groupBy("root").agg(F.min(rank).alias("b"), F.max(rank).alias("z")).where("b <> z").select("root", F.col("b.doc_id").alias("b_id"), F.col("b.tx").alias("b_tx")), "best")
    others = found.join(small(best, size), "root").where(~(F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("tx") == F.col("b_tx"))))
    kept = without(docs, others.select(F.col("doc_id").alias("id"), "tx"))
    again, size = sized(found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("id"), "tx").agg(F.count("*").alias("c")).where("c > 1").drop("c"), "again")
    if size.rows:
        rows = held(kept).withColumns({"own": F.col("row.doc_id"), "tz": text_hash("row.text")})
        once = rows.join(small(again, size), F.col("own").eqNullSafe(F.col("id")) & (F.col("tz") == F.col("tx")), "left_semi")
        once = freed(once.groupBy("own", "tz").agg(F.first("row").alias("row")), docs.columns)
        kept = without(kept, again).unionByName(once)
    return kept
