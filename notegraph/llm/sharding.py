"""Placement by a permutation-filled lookup table, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table: a prime, well over 100 for each shard.
SLOTS = 65_537


def _hash(text: str, seed: int) -> int:
    h = 0xCBF29CE484222325 ^ seed
    for b in text.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    h ^= h >> 33
    h = (h * 0xFF51AFD7ED558CCD) & 0xFFFFFFFFFFFFFFFF
    return h ^ (h >> 33)


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that owns each slot.

    A shard's preference order is the arithmetic progression offset + i * skip modulo the prime number of slots, which
    is a permutation. Shards take turns, each claiming the first free slot it prefers, until all are taken, so
    their shares differ by one slot at most and few slots move when a shard comes or goes. Shards must be distinct;
    none: ValueError.
    """
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one, at most as many as slots")
    if slots < 2 or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    at = [_hash(s, 1) % slots for s in shards]
    skip = [_hash(s, 2) % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): as many rows as slots, whatever the data."""
    names = F.array(*[F.lit(s) for s in shards])
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",")
    return spark.range(1).select(F.posexplode(owners).alias("slot", "_i")).select("slot", names[F.col("_i").cast("int")].alias("shard"))


def place(df: DataFrame, key: Column, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """df with `slot` and `shard`, by the hash of key (null: of the empty string), without a shuffle.

    The table is broadcast; its size is the parameter `slots`, not the data's. Columns of df with these names are
    replaced. Equal keys share a shard; repeated rows keep a row each; an empty table gives no rows.
    """
    slot = F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots)).cast("int")
    rest = [F.col(c) for c in df.columns if c not in ("slot", "shard")]
    placed = df.select(*rest, slot.alias("slot"))
    return placed.join(F.broadcast(table_frame(df.sparkSession, shards, slots)), "slot").select(*[c for c in placed.columns if c != "slot"], "slot", "shard")


def write_shards(df: DataFrame, path: str, parts_per_shard: int = 8) -> None:
    """Write placed rows to a folder for each shard; a shard's rows are dealt over several tasks, so a large one is no bottleneck."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(parts_per_shard))
    df.withColumn("_salt", salt).repartition("shard", "_salt").drop("_salt").write.partitionBy("shard").parquet(path)
