"""Jump consistent hashing: stable keys to shards without a table of ring positions.

A key draws a fixed sequence of numbers in (0, 1]. Starting in shard 0, each draw names the next
shard count at which the key moves; the last move below the shard count is its shard. The sequence
does not depend on the shard count, so one more shard takes keys only into itself.

All of it is column expressions. Keys may repeat, be null (one key of its own) or hold any share of
the rows; a key has one shard by definition, and places within a shard are dealt by buckets that
spread equal keys, so no shard is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.places import numbered
from loomwork.session import materialize

#: About as many rows of a shard as one task numbers.
ROWS_PER_BUCKET = 20_000


def jump_shard(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards - 1``, of a key. A key jumps at most ``shards`` times."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def step(state: Column, turn: Column) -> Column:
        draw = (F.shiftrightunsigned(F.xxhash64(key, turn), 33) + 1) / F.lit(float(1 << 31))
        onward = F.struct(
            state["next"].alias("shard"),
            F.floor((state["next"] + 1) / draw).cast("long").alias("next"),
        )
        return F.when(state["next"] < shards, onward).otherwise(state)

    start = F.struct(F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["shard"].cast("int"))


def with_slots(rows: DataFrame, shard: str, slot: str, label: str = "shard-rows") -> DataFrame:
    """Number the rows of each shard from 0 without gaps; the rows are written once, so that all steps see the same ones."""
    turn = f"{slot}__turn"
    kept = materialize(rows.withColumn(turn, F.monotonically_increasing_id()), label)
    buckets = max(1, -(-kept.count() // ROWS_PER_BUCKET))
    return numbered(kept, shard, turn, F.lit(buckets), slot).select(*rows.columns, slot)


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place documents in shards by their key.

    Returns key, size, text_crc32, law, shard, slot and grown_shard, one row per row of ``docs``;
    other columns are not read. A null text counts as empty, a null key as a key of its own, rows that
    repeat get places of their own, and an empty table gives no rows.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key),
        (F.octet_length(content) + 8).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(F.col(key), shards).alias("shard"),
        jump_shard(F.col(key), shards + 1).alias("grown_shard"),
    )
    return with_slots(placed, "shard", "slot").select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
