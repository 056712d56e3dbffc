"""Append history: what each append added, the running total, and reads as of a time.

A log has one row per append. Totals run within each day, after the totals of earlier days, so that
a stream's many appends are not ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHOWN = 8


def log_from_rows(rows: DataFrame, batch: Column, committed_at: Column) -> DataFrame:
    """batch_id, committed_at, added: the append log of rows that carry their batch."""
    return rows.groupBy(batch.alias("batch_id")).agg(
        F.max(committed_at).alias("committed_at"), F.count("*").alias("added")
    )


def snapshots(log: DataFrame) -> DataFrame:
    """Each append with the number of rows the table had after it."""
    timed = log.withColumn("_day", F.to_date("committed_at"))
    earlier = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    before = timed.groupBy("_day").agg(F.sum("added").alias("n")).select(
        "_day", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before")
    )
    so_far = Window.partitionBy("_day").orderBy("committed_at", "batch_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return timed.join(before, "_day").select(
        F.col("batch_id").alias("snapshot_id"),
        F.date_format("committed_at", "yyyy-MM-dd HH:mm:ss").alias("committed_at"),
        F.lit("append").alias("operation"),
        F.col("added").alias("added_records"),
        (F.col("_before") + F.sum("added").over(so_far)).alias("total_records"),
    )


def recent(history: DataFrame, n: int = SHOWN) -> DataFrame:
    return history.orderBy(F.desc("committed_at"), F.desc("snapshot_id")).limit(n)


def as_of(rows: DataFrame, committed_at: Column, ts: str) -> DataFrame:
    """Rows of the appends committed at or before ``ts``."""
    return rows.filter(committed_at <= F.lit(ts).cast("timestamp"))
