"""Change detection: which observations of a key carry another version than the one before.

Observations are (key, at, version) rows, for instance directory listings (path, time, mtime).
Batch and stream share one rule. The stream keeps the last version per key as keyed state of
``transformWithState``, so a micro-batch costs what its own rows cost, and event-time timers let
keys go that were not observed for a while. Before the state, the rows of a micro-batch are reduced
by (key, slice of time): a slice finds its inner changes by itself and sends one row, so a key that
most rows have is worked on by as many tasks as it has slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from loomwork.operators import ordered


def changes(
    rows: DataFrame,
    key: Sequence[str],
    at: str,
    version: str,
    bucket: Column,
    known: DataFrame | None = None,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Rows whose version differs from the previous one of their key.

    ``known`` (key, version) is what was seen before; a key not in it is new, and its first row
    is a change. ``bucket`` cuts the history of a key into slices by ``at``.
    """
    seen = ordered.previous(
        rows.withColumn("_bucket", bucket), key, "_bucket", [at, *tie], version, "_prev"
    )
    if known is not None:
        primed = known.select(*key, F.col(version).alias("_known"))
        seen = seen.join(primed, list(key), "left").withColumn("_prev", F.coalesce("_prev", "_known"))
    return seen.filter(~F.col("_prev").eqNullSafe(F.col(version))).select(*rows.columns)


def _reduce(key: Sequence[str], at: str, version: str, tie: Sequence[str], columns: Sequence[str]):
    """One row for a slice of a key: its first row, its changes after that, its last version and times."""

    def step(rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, [(c, "ascending") for c in (at, *tie)], null_placement="at_start")
        rows = rows.select(columns).take(order).combine_chunks()
        versions = rows.column(version)
        turned = pc.fill_null(pc.not_equal(versions.slice(1), versions.slice(0, len(versions) - 1)), True)
        inner = rows.slice(1).filter(turned)

        def packed(part: pa.Table) -> pa.Array:
            return pa.StructArray.from_arrays([part.column(c).combine_chunks() for c in columns], names=list(columns))

        ends = pa.array([0, len(inner)], pa.int32())
        cells = {c: rows.column(c).slice(0, 1) for c in key}
        cells |= {"from_at": rows.column(at).slice(0, 1), "last_at": rows.column(at).slice(len(rows) - 1)}
        cells |= {"opening": versions.slice(0, 1), "closing": versions.slice(len(rows) - 1), "head": packed(rows.slice(0, 1))}
        return pa.table(cells | {"inner": pa.ListArray.from_arrays(ends, packed(inner))})

    return step


class LastVersion(StatefulProcessor):
    """Keeps (version, at) per key; a slice opens with a change if its first version is not the kept one."""

    def __init__(self, key: Sequence[str], state: T.StructType, ttl_ms: int | None) -> None:
        self.key, self.state, self.ttl_ms = list(key), state, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.state)

    def _keep(self, version, at) -> None:
        self.last.update((version, at))
        if self.ttl_ms is not None and at is not None:
            self.handle.registerTimer(int(at.timestamp() * 1000) + self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.last.get()[0] if self.last.exists() else None
        newest = None
        for row in sorted(rows, key=lambda r: r["from_at"]):
            yield Row(head=row["head"] if row["opening"] != known else None, inner=row["inner"])
            known, newest = row["closing"], row["last_at"]
        self._keep(known, newest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # Only the timer of the newest observation ends a key; those of earlier ones find it renewed.
        at = self.last.get()[1] if self.last.exists() else None
        if at is not None and int(at.timestamp() * 1000) + self.ttl_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._keep(initialState["version"], initialState["at"])

    def close(self) -> None:
        pass


def start(
    stream: DataFrame,
    key: Sequence[str],
    at: str,
    version: str,
    bucket: Column,
    sink: Callable[[DataFrame, int], None],
    folder: str,
    primed: DataFrame | None = None,
    ttl: str | None = None,
    tie: Sequence[str] = (),
    **trigger,
) -> StreamingQuery:
    """Run ``changes`` on a stream and hand each micro-batch's changes to ``sink``.

    Micro-batches follow one another in time; inside one, rows are ordered. ``bucket`` must rise with
    ``at``. ``primed`` (key, version) is the state before the first micro-batch. With ``ttl`` (an interval
    such as ``"30 days"``) keys not observed for that long leave the state, by event time; a row that comes
    late counts like any other. ``at`` and ``version`` must not be null.
    """
    columns, fields = stream.columns, {f.name: f for f in stream.schema}
    kept = T.StructType([T.StructField("version", fields[version].dataType), T.StructField("at", fields[at].dataType)])
    whole = stream.schema.simpleString()
    keys = ", ".join(f"`{c}` {fields[c].dataType.simpleString()}" for c in key)
    ttl_ms = None
    if ttl is not None:
        span = stream.sparkSession.sql(f"SELECT (TIMESTAMP_NTZ'1970-01-01' + INTERVAL {ttl}) - TIMESTAMP_NTZ'1970-01-01' AS span").first()["span"]
        ttl_ms = int(span.total_seconds() * 1000)
        stream = stream.withWatermark(at, "0 seconds")
    kinds = {c: fields[c].dataType.simpleString() for c in (at, version)}
    slices = stream.withColumn("_bucket", bucket).groupBy(*key, "_bucket").applyInArrow(
        _reduce(key, at, version, tie, columns),
        f"{keys}, from_at {kinds[at]}, last_at {kinds[at]}, opening {kinds[version]}, closing {kinds[version]}, head {whole}, inner array<{whole}>",
    )
    initial = None
    if primed is not None:
        seen = F.col(at) if at in primed.columns else F.lit(None)
        initial = primed.select(*key, F.col(version).cast(kinds[version]).alias("version"), seen.cast(kinds[at]).alias("at")).groupBy(*key)
    found = slices.groupBy(*key).transformWithState(
        LastVersion(key, kept, ttl_ms), f"head {whole}, inner array<{whole}>", "Append", "None" if ttl is None else "EventTime", initial
    )
    head = F.when(F.col("head").isNotNull(), F.array("head")).otherwise(F.array().cast(f"array<{whole}>"))
    rows = found.select(F.explode(F.concat(head, "inner")).alias("row")).select("row.*")
    return (
        rows.writeStream.foreachBatch(sink)
        .outputMode("append")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(**(trigger or {"processingTime": "2 seconds"}))
        .start()
    )


def state(spark, folder: str) -> DataFrame:
    """The kept versions of a stopped stream: key, version, at."""
    stored = spark.read.format("statestore").option("stateVarName", "last").load(f"{folder}/checkpoint")
    return stored.select("key.*", "value.*")
