"""Sharding through a lookup table that shards fill in turns.

The table has a prime number of slots. Every shard has an order of preference over all slots, a permutation from an offset and
a step drawn from hashes of its name. Shards take turns, each claiming the slot it likes best of those still free, until
all are taken. So slots are shared out evenly, to one slot, and when a shard comes or goes few slots change hands besides its own.
The table is configuration of fixed size; it is broadcast, and a row finds its shard with one hash and one look.

The key is hashed as text (MD5); a NULL key counts as empty text, repeated keys go to one shard. Empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 4093  # a prime
SHARDS = tuple(f"shard-{i:02d}" for i in range(32))
HASH_DIGITS = 15  # hexadecimal digits of a hash that count: 60 bits


def _number(text: str) -> int:
    return int(md5(text.encode()).hexdigest()[:HASH_DIGITS], 16)


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[str]:
    """The shard of each slot."""
    if slots < 3 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"the number of slots must be a prime above 2, got {slots}")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must have different names, and be no more than the slots")
    starts = [_number(f"offset {s}") % slots for s in shards]
    steps = [_number(f"skip {s}") % (slots - 1) + 1 for s in shards]
    liked, owner = list(starts), [""] * slots
    for turn in range(slots):
        who = turn % len(shards)
        while owner[liked[who]]:
            liked[who] = (liked[who] + steps[who]) % slots
        owner[liked[who]] = shards[who]
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_DIGITS)
    return (F.conv(digits, 16, 10).cast("long") % slots).cast("int")


def table_frame(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``slot, shard``: one row per slot."""
    owner = lookup_table(shards, slots)
    number = {s: i for i, s in enumerate(shards)}
    numbers = F.split(F.lit(",".join(str(number[s]) for s in owner)), ",")
    placed = spark.range(1).select(F.posexplode(numbers).alias("slot", "number"))
    return placed.select("slot", F.element_at(F.array(*map(F.lit, shards)), F.col("number").cast("int") + 1).alias("shard"))


def sharded(rows: DataFrame, key_col: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``; columns of these names are replaced."""
    names = [c for c in rows.columns if c not in ("slot", "shard", key_col)]
    placed = rows.select(F.col(f"`{key_col}`"), *[F.col(f"`{c}`") for c in names], slot_of(F.col(f"`{key_col}`"), slots).alias("slot"))
    return placed.join(F.broadcast(table_frame(rows.sparkSession, shards, slots)), "slot").select(
        F.col(f"`{key_col}`"), *[F.col(f"`{c}`") for c in names], "slot", "shard")
