"""Sharding by rendezvous hashing of record keys over weighted shards.

Each shard draws a number u in (0, 1) for a key from a hash of (key, shard) and scores
``-ln(u) / weight``; the smallest score takes the key. A shard's score knows nothing of the
other shards, so a new shard takes keys only into itself, and one that goes gives up only its
own: about weight / total weight of the keys move.

Edge cases: a null key hashes like the word null; a null text has 0 bytes and the checksum of
no bytes; rows that are equal in key, size and checksum get adjacent slots; an empty table
gives an empty result; further columns of the input are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinvote.llm.common import key_text, numbered


def _score(key: Column, shard: int, weight: float) -> Column:
    digest = F.md5(F.concat_ws(":", key_text(key), F.lit(str(shard))))
    drawn = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return -F.log((drawn + 0.5) / float(1 << 52)) / F.lit(float(weight))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to ``len(weights) - 1``) of a key; equal scores go to the lower shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    scored = [F.struct(_score(key, i, w).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.array_min(F.array(*scored))["shard"]


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard") -> DataFrame:
    """All rows and columns, and the shard of each row."""
    return df.withColumn(shard, rendezvous(F.col(key), weights))


def shard_slots(
    df: DataFrame, key: str, text: str, weights: Sequence[float], grown: Sequence[float] | None = None
) -> DataFrame:
    """Per row: key, size, text_crc32, law, shard, slot and, with more shards, grown_shard.

    ``size`` is the text's bytes plus 1; ``slot`` numbers the rows of a shard from 0 without
    gaps. Rows are counted per (key, size, checksum) first, so a key that repeats in a third
    of all rows is one row when slots are given out.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("_key"),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
    )
    counted = rows.groupBy("_key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n"))
    placed = counted.withColumn("shard", rendezvous(F.col("_key"), weights)).withColumn(
        "grown_shard", rendezvous(F.col("_key"), grown) if grown else F.lit(None).cast("int")
    )
    slotted = numbered(placed, ["shard"], ["_key", "size", "text_crc32"], "_slot", F.col("_n"))
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))
    return slotted.withColumn("_copy", copies).select(
        F.col("_key").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_slot") + F.col("_copy")).alias("slot"),
        "grown_shard",
    )


def write_shards(df: DataFrame, path: str, shard: str = "shard") -> None:
    """Write the rows as Parquet with a folder for each shard."""
    df.write.partitionBy(shard).parquet(path)
