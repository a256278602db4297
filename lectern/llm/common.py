"""Helpers shared by the training-data operators: durable intermediate tables, native tokenising, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Word pattern of the benchmark and licence operators: every ASCII character but digits and lower-case letters separates.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters for which a full lower-casing may differ from lower-casing A-Z alone.
CASED = r"[^\x00-\x7F\p{Ll}\p{Lo}\p{P}\p{Z}\p{Nd}\p{Sm}\p{Sc}\p{M}]"
#: A side of a join is broadcast only if its rows and bytes were measured and hold at most so many.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share, spark.checkpoint.dir; it is deleted when the driver's
    JVM ends.  Where the setting is missing, a local session gets a temporary folder; any other is refused, as what one
    machine writes to a folder of its own the others do not see."""
    context = spark.sparkContext
    if context.applicationId not in _OWN:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = f"{(found or f'file://{tempfile.mkdtemp(prefix='lectern-')}').rstrip('/')}/lectern/{context.applicationId}"
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)
        _OWN[context.applicationId] = own
    return _OWN[context.applicationId]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, lost executors lose nothing."""
    return sized(df, tag)[0]


class Size(NamedTuple):
    rows: int
    bytes: int  # of the values, uncompressed; eight for each number


def sized(df: DataFrame, tag: str) -> tuple[DataFrame, Size]:
    """df as a table in the shared folder, and its size, counted while it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    text = {"string": lambda c: c, "binary": lambda c: c, "array<string>": lambda c: F.concat_ws(" ", c)}
    long = [F.coalesce(F.octet_length(text[t](F.col(f"`{c}`"))), F.lit(0)).cast("long") for c, t in df.dtypes if t in text]
    seen = Observation()
    df = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(reduce(add, long, F.lit(8 * len(df.columns)).cast("long"))).alias("bytes"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 2000) if int(before) > 0 else 2000))  # long texts: small Arrow buffers
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored = path
    return out, Size(seen.get["rows"], seen.get["bytes"] or 0)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small(df: DataFrame, size: Size) -> DataFrame:
    """df with a broadcast hint if its measured rows and bytes are few enough; else unchanged, for a shuffled join."""
    return F.broadcast(df) if size.rows <= BROADCAST_ROWS and size.bytes <= BROADCAST_BYTES else df


def held(docs: DataFrame) -> DataFrame:
    """docs as one column row, a struct of all of its columns: names beside it cannot clash with theirs."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def freed(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of a row that was held, those in new replaced or appended."""
    own = [new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in columns]
    return rows.select(*own, *(v.alias(c) for c, v in new.items() if c not in columns))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, other characters unchanged.  The full lower() is used where it gives the same."""
    same = (F.length(text) == F.octet_length(text)) | ~text.rlike(CASED)
    return F.when(same, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_array(text: Column) -> Column:
    """Lower-cased words of a text (SEPARATORS between them); null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def let(value: Column, body) -> Column:
    """Evaluate value once and use it many times: body gets it as a bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_hash(text: str = "text") -> Column:
    """A hash of the text column that tells null from empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("\0null")))


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows of docs, columns unchanged, whose (doc_id, text hash) is not in rejected (id, tx)."""
    rejected, size = sized(rejected.select("id", "tx").distinct(), "rejected")
    rows = held(docs).withColumn("tz", text_hash("row.text"))
    on = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("tz") == F.col("tx"))
    return freed(rows.join(small(rejected, size), on, "left_anti"), docs.columns)


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of (a, b) long pairs as (node, root), root the smallest node.

    Alternating large-star and small-star steps; each step's edges are at most those before, and no step gathers a
    component in one task: the minimum of each neighbourhood is a partial aggregate that is joined back.
    """
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag)
    for _ in range(60):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low2, "u")
        nxt = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low2.select("u", F.col("m").alias("v"))).distinct()
        nxt = materialize(nxt, tag)
        discard(cur)
        # settled when every larger node has one parent and no parent has a parent
        moved = nxt.select("v").distinct().join(nxt.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        many = nxt.groupBy("u").count().where("count > 1").limit(1).count() if not moved else 1
        cur = nxt
        if not moved and not many:
            break
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
