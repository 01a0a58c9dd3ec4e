"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table, a walk with its own start and stride. Shards
take turns claiming their next free slot until the table is full, so shares differ by at most one slot per unit of
weight, and adding or removing a shard moves few other slots. The table has a fixed size; it is broadcast, and a row
finds its shard with one hash and one lookup. Nothing is shuffled and no key is hot: a row's slot depends on its key
alone. Only the fixed table is filled in the driver; rows see DataFrame functions only.

Null keys have a slot of their own; rows with equal keys share a shard; columns of the input stay as they are, and the
slot and shard columns replace columns named alike. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 16381  # a prime, over 100 times the number of shards
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def digest(text: str) -> int:
    """The first 60 bits of MD5, as the same expression in SQL gives them."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: Sequence[str], slots: int = SLOTS, weights: Sequence[int] | None = None) -> list[int]:
    """Number of the shard that owns each slot. A shard of weight w claims w slots in each of its turns."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be named, each once")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime")
    if sum(weights or [1] * len(shards)) > slots:
        raise ValueError("more turns in a round than slots")
    walk = [(digest(f"start {s}") % slots, digest(f"stride {s}") % (slots - 1) + 1) for s in shards]
    owner, at, left = [-1] * slots, [0] * len(shards), slots
    while True:
        for i, (start, stride) in enumerate(walk):
            for _ in range(weights[i] if weights else 1):
                while owner[slot := (start + at[i] * stride) % slots] >= 0:
                    at[i] += 1
                owner[slot] = i
                left -= 1
                if not left:
                    return owner


def slot_of(keys: Sequence[str | Column], slots: int = SLOTS) -> Column:
    """Slot of a row by its key columns."""
    parts = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in (F.col(f"`{k}`") if isinstance(k, str) else k for k in keys)]
    text = parts[0] if len(parts) == 1 else F.concat_ws("\x1f", *parts)
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(rows: DataFrame, keys: Sequence[str | Column], shards: Sequence[str] = SHARDS, slots: int = SLOTS, weights: Sequence[int] | None = None, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """Adds slot and shard to every row."""
    names, owner = F.array(*[F.lit(s) for s in shards]), ",".join(map(str, fill(shards, slots, weights)))
    table = rows.sparkSession.range(1).select(F.posexplode(F.split(F.lit(owner), ",")).alias("__slot", "__owner"))
    table = table.select("__slot", F.element_at(names, F.col("__owner").cast("int") + 1).alias("__shard"))
    base = rows.select("*", slot_of(keys, slots).alias("__slot")).drop(slot, shard)
    out = base.join(F.broadcast(table), "__slot", "left")
    return out.select(*[F.col(f"`{c}`") for c in base.columns if c != "__slot"], F.col("__slot").alias(slot), F.col("__shard").alias(shard))


def balance(placed: DataFrame, shard: str = "shard") -> DataFrame:
    """Rows per shard."""
    return placed.groupBy(shard).agg(F.count("*").alias("rows"))
