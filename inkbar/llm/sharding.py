"""Shard placement by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: an offset
and a skip taken from hashes of its name.  The shards take turns, each claiming the
first free slot of its order, until the table is full.  All shards then hold the
same number of slots, give or take one, and taking a shard away moves few slots besides its own.
A document's slot is a hash of its id; the table is broadcast, so placing is one
lookup.  Its size is a parameter and does not depend on the data.

Defined cases: null ids are placed by their text, null in both by the hash of an empty string; equal rows
go to one shard.  Empty tables give empty results; extra columns are kept, but
a column ``shard`` is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkbar.llm.rows import boxed

SHARDS = 64
SLOTS = 16_381


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{name}".encode()).digest()[:7], "big")


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (its place in ``shards``) that holds each slot."""
    if any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not 0 < len(shards) <= slots:
        raise ValueError("there must be at least one shard and no more shards than slots")
    at = [_number(s, "offset") % slots for s in shards]
    skip = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    table, filled = [-1] * slots, 0
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            filled += 1
            if filled == slots:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A slot by the first 60 bits of the key's md5, as any SQL engine can state it."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"), F.lit(slots))


def place(docs: DataFrame, n_shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``docs`` with a column ``shard``, from 0 to ``n_shards`` - 1."""
    table = lookup_table([f"shard-{i}" for i in range(n_shards)], slots)
    spark = docs.sparkSession
    lookup = spark.createDataFrame(list(enumerate(table)), "_slot long, shard int")
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    rows = boxed(docs.drop("shard"), at=slot_of(key, slots))
    return rows.join(F.broadcast(lookup), F.col("at") == F.col("_slot"), "left").select("row.*", "shard")


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, lanes: int = 8) -> None:
    """Write placed documents in one folder per shard, ``lanes`` tasks for each."""
    lane = F.pmod(F.xxhash64("doc_id", "text"), F.lit(lanes))
    place(docs, n_shards).repartition(n_shards * lanes, "shard", lane).write.partitionBy(
        "shard"
    ).parquet(path)
