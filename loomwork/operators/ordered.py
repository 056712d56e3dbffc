"""Ordered per-key operators that never put one key's whole history into one task.

A plain ``Window.partitionBy(key)`` sorts everything a key has in a single task. Here the
history of a key is cut into buckets (a time slice, a block of a file); rows are ordered inside
``(key, bucket)``, and only one summary row per bucket crosses bucket borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _carry(summary: DataFrame, key: Sequence[str], bucket: str, value: Column, out: str) -> DataFrame:
    """Aggregate of the earlier buckets of the same key, one row per (key, bucket)."""
    earlier = (
        Window.partitionBy(*key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    )
    return summary.select(*key, bucket, value.over(earlier).alias(out))


def row_number(
    df: DataFrame, key: Sequence[str], bucket: str, order: Sequence[str], out: str
) -> DataFrame:
    """Zero-based position of each row in its key; ``bucket`` must rise with ``order``."""
    inner = Window.partitionBy(*key, bucket).orderBy(*order)
    numbered = df.withColumn("_n", F.row_number().over(inner) - 1)
    sizes = df.groupBy(*key, bucket).agg(F.count("*").alias("_size"))
    before = _carry(sizes, key, bucket, F.sum("_size"), "_before")
    return (
        numbered.join(before, [*key, bucket], "left")
        .withColumn(out, F.coalesce("_before", F.lit(0)) + F.col("_n"))
        .drop("_n", "_before")
    )


def previous(
    df: DataFrame, key: Sequence[str], bucket: str, order: Sequence[str], value: str, out: str
) -> DataFrame:
    """Value of the row before, per key; NULL for the first row of a key.

    ``value`` must not be NULL.
    """
    inner = Window.partitionBy(*key, bucket).orderBy(*order)
    ranked = df.withColumn("_lag", F.lag(value).over(inner)).withColumn(
        "_last", F.lead(value).over(inner).isNull()
    )
    ends = ranked.filter("_last").select(*key, bucket, F.col(value).alias("_end"))
    carried = _carry(ends, key, bucket, F.last("_end"), "_carried")
    return (
        ranked.join(carried, [*key, bucket], "left")
        .withColumn(out, F.coalesce("_lag", "_carried"))
        .drop("_lag", "_last", "_carried")
    )


def last_before(
    probes: DataFrame,
    facts: DataFrame,
    key: Sequence[str],
    at: str,
    bucket: Column,
    value: str,
    out: str,
) -> DataFrame:
    """As-of join: for each probe the newest fact of the same key at or before its time.

    ``bucket`` is an expression over ``at`` that rises with it; ``value`` must not be NULL.
    """
    mine = [c for c in probes.columns if c not in (*key, at)]
    both = (
        facts.select(*key, at, F.col(value).alias("_fact"), F.lit(0).alias("_probe"),
                     F.lit(None).alias("_row"))
        .unionByName(
            probes.select(*key, at, F.lit(None).alias("_fact"), F.lit(1).alias("_probe"),
                          F.struct(*mine).alias("_row"))
        )
        .withColumn("_bucket", bucket)
    )
    so_far = (
        Window.partitionBy(*key, "_bucket")
        .orderBy(at, "_probe", "_fact")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = both.withColumn("_seen", F.last("_fact", ignorenulls=True).over(so_far))
    ends = both.groupBy(*key, "_bucket").agg(F.max(F.struct(F.col("_fact").isNotNull(), at, "_fact")).alias("_end"))
    ends = ends.select(*key, "_bucket", F.col("_end._fact").alias("_end"))
    carried = _carry(ends, key, "_bucket", F.last("_end", ignorenulls=True), "_carried")
    return (
        inside.filter("_probe = 1")
        .join(carried, [*key, "_bucket"], "left")
        .select(*key, at, "_row.*", F.coalesce("_seen", "_carried").alias(out))
    )
