"""Placement of documents on shards through a permutation-filled lookup table.

Each shard has an order of preference over the slots of a table whose size is a prime:
``(offset + j * skip) mod size`` runs through all slots. The shards take turns; each claims
the first slot of its order that is still free, until the table is full. A key's digest
picks a slot, and the slot names the shard. Shards own equal numbers of slots, give or take
one, and adding or removing a shard moves few keys besides its own.

The table is filled on the driver. Its size is a parameter, bounded by ``MOST_SLOTS``, and
does not depend on the data. Placing a row costs a digest and one probe of a broadcast table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
MOST_SLOTS = 5_000_000


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot the place of its shard in ``shards``."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must have different names")
    if not _prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime between the number of shards and {MOST_SLOTS}")
    # Shards take turns in the order of their names, so their order in the list is of no concern.
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    digests = [hashlib.sha256(name.encode()).digest() for name in shards]
    offset = [int.from_bytes(d[:8], "big") % slots for d in digests]
    skip = [int.from_bytes(d[8:16], "big") % (slots - 1) + 1 if slots > 2 else 1 for d in digests]
    place, table, left = offset[:], [-1] * slots, slots
    while left:
        for shard in turns[:left]:
            while table[place[shard]] >= 0:
                place[shard] = (place[shard] + skip[shard]) % slots
            table[place[shard]] = shard
            left -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of its MD5 digest modulo the table size."""
    digits = F.substring(F.md5(key.cast("string").cast("binary")), 1, 15)
    return (F.conv(digits, 16, 10).cast("long") % slots).cast("int")


def table_frame(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """Columns ``slot`` and ``shard``."""
    owners, names = ",".join(map(str, lookup_table(shards, slots))), F.array(*map(F.lit, shards))
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
    return rows.select("slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def placed_on_shards(
    docs: DataFrame, shards: Sequence[str], slots: int = SLOTS, key: str = "doc_id"
) -> DataFrame:
    """Columns ``doc_id`` (the key), ``slot`` and ``shard``, one row per input row.

    Equal keys share a slot, so repeated rows stay together. A null key counts as the
    empty string. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("doc_id"), slot_of(F.coalesce(F.col(key).cast("string"), F.lit("")), slots).alias("slot"))
    return rows.join(F.broadcast(table_frame(docs.sparkSession, shards, slots)), "slot").select("doc_id", "slot", "shard")
