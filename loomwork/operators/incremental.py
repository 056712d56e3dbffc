"""Idempotent loads: which rows of a batch are new, and how edges are kept unique."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import ids
from loomwork.session import materialize

EDGE_KEY = ["src_id", "dst_id", "relation"]


def one_per_key(df: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key in ``order``. Map tasks keep one row per key before the
    shuffle, so a key with very many copies is already reduced when it is exchanged."""
    ranked = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(ranked)).filter("_rn = 1").drop("_rn")


def not_yet_in(new: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing``.

    The stored keys are first reduced to those the batch mentions. For a batch whose keys are
    small enough to broadcast (the optimizer checks its size) the stored table is only scanned,
    never shuffled; a larger one falls back to sort-merge joins.
    """
    keys = list(key)
    known = existing.select(*keys).join(new.select(*keys), keys, "left_semi")
    return new.join(known, keys, "left_anti")


def new_artifacts(batch: DataFrame, existing: DataFrame, mode: str = "first") -> DataFrame:
    """Rows of a batch to append.

    ``mode="first"``: a known id is never written again, and the oldest row of an id in the
    batch wins. ``mode="latest"``: a changed content hash of a known id is appended too, and
    readers take the newest (see ``latest_artifacts``).
    """
    if mode == "first":
        return _first_artifacts(batch, existing)
    if mode == "latest":
        rows = one_per_key(batch, ["id"], [F.desc("created_at"), F.col("content_hash")])
        version = F.coalesce("content_hash", F.lit(""))
        seen = existing.select("id", version.alias("_version"))
        return not_yet_in(rows.withColumn("_version", version), seen, ["id", "_version"]).drop("_version")
    raise ValueError(f"unknown mode {mode!r}")


def _first_artifacts(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """The first row of each id of a batch that is not in ``existing``.

    Ids are compared with the stored ones, as bytes, before any row is dealt. Of a load that is sent again only the
    months that hold the first row of a new id are dealt then.
    """
    # Neither key can be absent (no id packs to no bytes), so no join filters its side of the keys and they are dealt once for both.
    rows = ids.pack(batch, "id")
    month = F.coalesce(F.year("created_at") * 12 + F.month("created_at"), F.lit(-1 << 30))
    keys = rows.select("id", month.alias("month")).groupBy("id").agg(F.coalesce(F.min("month"), F.lit(0)).alias("month"))
    # As in ``not_yet_in``; the month of a known key is its own, and named so that both joins read the same columns.
    known = ids.pack(existing.select("id"), "id").join(keys, "id").select("id", F.col("month").alias("known"))
    fresh = materialize(
        keys.alias("k").join(known.alias("s"), (F.col("k.id") == F.col("s.id")) & (F.col("known") <= F.col("month")), "left_anti"),
        "fresh-ids",
    )
    months = F.broadcast(fresh.select("month").distinct())  # twelve for each year
    near = rows.withColumn("month", month).join(months, "month", "left_semi").drop("month")
    first = one_per_key(near, ["id"], [F.col("created_at"), F.col("content_hash")])
    rows = first.join(fresh.select("id"), "id", "left_semi")
    return ids.unpack(rows, "id").select(*batch.columns)


def latest_artifacts(rows: DataFrame, *newest_first) -> DataFrame:
    """One row per id, the newest."""
    return one_per_key(rows, ["id"], [*newest_first, F.desc("created_at"), F.col("content_hash")])


def latest_edges(rows: DataFrame, version: str | Column) -> DataFrame:
    """One edge per (source, target, relation): weight and time of the highest version."""
    return rows.groupBy(*EDGE_KEY).agg(
        F.max_by("weight", version).alias("weight"),
        F.max_by("created_at", version).alias("created_at"),
    )


def current_edges(rows: DataFrame, version: str | Column) -> DataFrame:
    """One edge per key from an append log, whatever the relation: any of them may be sent again."""
    return latest_edges(rows, version).select(*EDGE_KEY, "weight", "created_at")


def upsert_edges(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """The edge table after a batch: known edges take the batch's weight, others are added."""
    both = existing.withColumn("_version", F.lit(0)).unionByName(batch.withColumn("_version", F.lit(1)))
    return latest_edges(both, "_version")


def _one_per_edge(batch: DataFrame) -> DataFrame:
    return batch.groupBy(*EDGE_KEY).agg(F.max("weight").alias("weight"), F.max("created_at").alias("created_at"))


def changed_edges(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Edges of a batch that are new or carry another weight or time than the stored edge, of which there is one per key."""
    rows = _one_per_edge(batch)
    # Both are compared as text, in which an absent one is a value like any other.
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("weight", "created_at")]
    weighed = F.concat_ws(" ", *shown)
    known = existing.select(*EDGE_KEY, weighed.alias("_weight"))
    # The stored edges have one row per key, so both sides are dealt by the key as they stand.
    fresh = rows.join(known, EDGE_KEY, "left").filter(F.col("_weight").isNull() | (F.col("_weight") != weighed))
    return fresh.select(*EDGE_KEY, "weight", "created_at")


def edges_to_append(log: DataFrame, batch: DataFrame, version: Column) -> DataFrame:
    """``changed_edges`` of a batch against an append log, whose rows are told apart by ``version``.

    The rows of the batch meet the log once and what is unchanged once. Where no part of the key can be NULL, both joins
    read the batch alike, so that it is dealt once for both, as the log is; a small batch is broadcast.
    """
    rows = _one_per_edge(batch)
    sent = rows.withColumnsRenamed({"weight": "_weight", "created_at": "_at"})
    newest = [F.max_by(c, version).alias(c) for c in ("weight", "created_at")]
    met = log.join(sent, EDGE_KEY).groupBy(*EDGE_KEY).agg(*newest, F.max("_weight").alias("_weight"), F.max("_at").alias("_at"))
    same = F.col("weight").eqNullSafe(F.col("_weight")) & F.col("created_at").eqNullSafe(F.col("_at"))
    return rows.join(met.filter(same).select(*EDGE_KEY), EDGE_KEY, "left_anti")
