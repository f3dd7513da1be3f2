"""Placement of keys on shards by a permutation-filled lookup table."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prime number of slots; it bounds the table that is broadcast.
SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (as an index into ``shards``) of every slot.

    Each shard has its own order of all slots, an arithmetic walk that starts and steps
    by hashes of its name. The shards take turns, each claiming the first slot of its
    order that is free, until all are taken; so shares differ by one slot at most, and a
    shard that comes or goes moves few slots of the others. Names are taken in sorted
    order: the table depends on the set of shards only.
    """
    if not _is_prime(slots):
        raise ValueError("the number of slots must be prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("needs distinct shards, at most one for each slot")
    order = sorted(range(len(shards)), key=lambda i: shards[i])
    at, step = {}, {}
    for i in order:
        digest = md5(shards[i].encode()).digest()
        at[i] = int.from_bytes(digest[:8], "big") % slots
        step[i] = int.from_bytes(digest[8:], "big") % (slots - 1) + 1 if slots > 2 else 1
    owner: list[int] = [-1] * slots
    taken = 0
    while taken < slots:
        for i in order:
            while owner[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            owner[at[i]] = i
            taken += 1
            if taken == slots:
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key by the MD5 of its text; null counts as an empty key."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(
    docs: DataFrame, shards: list[str], id_col: str = "doc_id", slots: int = SLOTS
) -> DataFrame:
    """``id``, ``slot`` and ``shard`` of every row.

    The table of ``slots`` rows is broadcast; placing a row is one hash and one probe,
    in the task that reads it. Rows with equal ids share a shard, as do null and empty
    ids. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    owners = spark.createDataFrame(
        [(slot, shards[i]) for slot, i in enumerate(lookup_table(shards, slots))],
        "slot int, shard string",
    )
    keyed = docs.select(F.col(id_col).alias("id"), slot_of(F.col(id_col), slots).alias("slot"))
    return keyed.join(F.broadcast(owners), "slot").select("id", "slot", "shard")
