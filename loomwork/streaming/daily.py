"""Daily activity kept up to date by a stream instead of being recomputed.

Rows are counted by event-time day, source and kind in keyed state. Each source partition of a micro-batch
is counted before the state, so a key that most rows have costs one small row per partition. A day
leaves the state when the watermark has passed its end. Rows of a day that has left are late: they change no
stored count and are kept aside, in counts of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from loomwork.schemas import GOLD, conform
from loomwork.session import materialize

KEYS = ["day", "source", "kind"]
COUNTS = "day string, source string, kind string, count long"
DAY_MS = 86_400_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map step: the counts of a part of the rows."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by(KEYS).aggregate([("count", "sum")])
        yield from table.rename_columns([*KEYS, "count"]).select([*KEYS, "count"]).combine_chunks().to_batches()


class DayCounts(StatefulProcessor):
    """Running counts of days that are open; a day that the watermark has passed takes no more rows."""

    def init(self, handle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "count long")

    @staticmethod
    def _end_ms(day: str) -> int:
        return int(datetime.fromisoformat(day).replace(tzinfo=timezone.utc).timestamp() * 1000) + DAY_MS

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        added = sum(r["count"] for r in rows)
        day, source, kind = key
        if day is None or self._end_ms(day) <= timerValues.getCurrentWatermarkInMs():
            yield Row(day=day, source=source, kind=kind, count=added, late=True)
            return
        if self.total.exists():
            added += self.total.get()[0]
        else:
            self.handle.registerTimer(self._end_ms(day))
        self.total.update((added,))
        yield Row(day=day, source=source, kind=kind, count=added, late=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.total.clear()
        return iter(())

    def close(self) -> None:
        pass


def _stored(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(COUNTS).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COUNTS)


def start(artifacts: DataFrame, folder: str, lateness: str = "2 days", **trigger) -> StreamingQuery:
    """Keep the counts of each day as one partition of ``<folder>/counts``.

    ``lateness`` is how far behind the newest row a day stays open. A micro-batch rewrites the days it
    changed and no others; its counts are totals, so that a repeated one changes nothing. Late counts
    lie in ``<folder>/late``, one part for each micro-batch that has some. A row without a time has no
    day and is late.
    """
    timed = artifacts.withWatermark("created_at", lateness)
    daily = timed.select(F.date_format("created_at", "yyyy-MM-dd").alias("day"), "source", "kind", F.lit(1).cast("long").alias("count"))
    counts = daily.mapInArrow(_counted, COUNTS).groupBy(*KEYS).transformWithState(DayCounts(), f"{COUNTS}, late boolean", "Update", "EventTime")

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        made = materialize(batch, "daily-counts")
        totals, late = made.where("not late").drop("late"), made.where("late").drop("late")
        if not late.isEmpty():
            late.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{folder}/late/epoch={epoch}")
        if not totals.isEmpty():
            before = _stored(spark, f"{folder}/counts").join(totals.select("day").distinct(), "day", "left_semi")
            both = before.select(*KEYS, "count", F.lit(0).alias("turn")).unionByName(totals.withColumn("turn", F.lit(1)))
            days = materialize(both.groupBy(*KEYS).agg(F.max_by("count", "turn").alias("count")), "daily-counts")
            writer = days.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("day").parquet(f"{folder}/counts")

    return (
        counts.writeStream.foreachBatch(step)
        .outputMode("update")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"processingTime": "120 seconds"}))
        .start()
    )


def late(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of rows that came after their day had left."""
    return _stored(spark, f"{folder}/late").groupBy(*KEYS).agg(F.sum("count").alias("count"))


def read(spark: SparkSession, folder: str, with_late: bool = True) -> DataFrame:
    """The counts so far, with or without those of late rows."""
    parts = _stored(spark, f"{folder}/counts").select(*KEYS, "count")
    if with_late:
        parts = parts.unionByName(late(spark, folder))
    return conform(parts.groupBy(*KEYS).agg(F.sum("count").alias("count")), GOLD["gold_daily_activity"])


def state(spark: SparkSession, folder: str) -> DataFrame:
    """The open days of a stopped stream: day, source, kind, count."""
    stored = spark.read.format("statestore").option("stateVarName", "total").load(f"{folder}/checkpoint")
    return stored.select("key.*", "value.*")
