"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size (offset + j * skip); shards take turns
claiming their next free slot until the table is full.  The table has TABLE slots whatever the data, so it is broadcast, and
a document's slot is a hash of its id modulo TABLE: placement takes one probe.  Adding or dropping a shard moves few slots.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, held

#: Prime, and over a hundred times the number of shards, so shards differ by under one per cent in slots.
TABLE, SHARDS = 8191, 64


@lru_cache(maxsize=8)
def lookup_table(names: tuple[str, ...], size: int = TABLE) -> tuple[int, ...]:
    """slot -> position of the shard in names.  The fill is a loop over `size` slots on the driver, before any plan."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must be distinct, and at least one")
    if len(names) > size:
        raise ValueError("more shards than slots: some would get none")
    number = lambda name, salt: int(md5(f"{salt}:{name}".encode()).hexdigest()[:12], 16)
    at = [number(n, "offset") % size for n in names]
    skip = [number(n, "skip") % (size - 1) + 1 for n in names]
    table, free = [-1] * size, size
    while free:
        for s in range(len(names)):
            while table[at[s]] >= 0:
                at[s] = (at[s] + skip[s]) % size
            table[at[s]] = s
            free -= 1
            if not free:
                break
    return tuple(table)


def shard_names(n: int = SHARDS) -> tuple[str, ...]:
    return tuple(f"shard-{i:05d}" for i in range(n))


def assign_shards(docs: DataFrame, names: tuple[str, ...] | None = None, key: str = "doc_id") -> DataFrame:
    """docs, columns unchanged, with slot and shard (both long) appended.

    The slot is the first 12 hex digits of md5(key as text) modulo TABLE; a null key is placed as ''.  Rows with equal keys
    meet in one shard; an empty table stays empty.  Columns of docs named slot or shard are replaced.
    """
    names = names or shard_names()
    spark = docs.sparkSession
    listed = F.split(F.lit(" ".join(map(str, lookup_table(names)))), " ")
    table = spark.range(1).select(F.posexplode(listed).alias("slot", "shard")).select(F.col("slot").cast("long"), F.col("shard").cast("long"))
    digest = F.md5(F.coalesce(F.col("row").getField(key).cast("string"), F.lit("")))
    at = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % TABLE
    placed = held(docs).withColumn("at", at).join(F.broadcast(table), F.col("at") == F.col("slot"))  # TABLE rows, always
    return freed(placed, [c for c in docs.columns if c not in ("slot", "shard")], slot=F.col("at"), shard=F.col("shard"))
