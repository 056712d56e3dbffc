"""File events to silver: decode, drop repeats, read the file, append what is new, embed it.

An event that repeats one of the last hours (``horizon``) is dropped by the stream's own state, which holds
the ids of that time only. What comes again later is caught by the ids already stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from loomwork.functions import files, ids, text
from loomwork.operators import blobs, silver, vectors
from loomwork.operators.incremental import not_yet_in, one_per_key
from loomwork.session import materialize
from loomwork.sources import folder
from loomwork.sources.lake import Lake

EVENT = T.StructType([T.StructField(n, T.StringType()) for n in ("repo", "abspath", "rel", "ts")])


def decode(raw: DataFrame, column: str = "value") -> DataFrame:
    """repo, abspath, rel, ts, id and the raw text of JSON events; ``rel`` defaults to the name.

    ``id`` is NULL for an event that cannot be used, see ``poison``.
    """
    event = F.from_json(F.col(column).cast("string"), EVENT)
    rows = raw.select(F.col(column).cast("string").alias("raw"), event.alias("e"))
    rel = F.coalesce(
        text.blank_to_null(F.col("e.rel")), F.substring_index(F.col("e.abspath"), "/", -1)
    )
    return rows.select(
        F.col("e.repo").alias("repo"),
        F.col("e.abspath").alias("abspath"),
        rel.alias("rel"),
        text.parse_iso(F.col("e.ts")).alias("ts"),
        F.when(F.col("e.abspath").isNotNull(), ids.file_id(F.col("e.repo"), rel)).alias("id"),
        "raw",
    )


def usable(events: DataFrame) -> DataFrame:
    return events.filter(F.col("id").isNotNull())


def poison(events: DataFrame) -> DataFrame:
    """Events that are skipped: not JSON, or without a repo or path."""
    return events.filter(F.col("id").isNull()).select("raw")


def event_files(events: DataFrame) -> DataFrame:
    """repo, rel, content and size of the files that events name; missing and empty files give none."""
    wanted = one_per_key(usable(events), ["id"], [F.col("ts"), F.col("abspath")])
    read = folder.with_bytes(wanted.select("repo", "abspath", "rel"), "/")
    return read.withColumn("size", F.octet_length("content").cast("long")).filter(F.col("size") > 0)


def event_artifacts(read: DataFrame, bucket: str = "work") -> DataFrame:
    """File artifacts of read files, as of now."""
    rows = read.withColumn("modality", files.classify(F.col("rel"), F.col("content"))).withColumn(
        "content_hash", F.sha2("content", 256)
    )
    return silver.file_artifacts(
        rows.select(
            "repo",
            F.col("rel").alias("path"),
            F.current_timestamp().alias("created_at"),
            files.file_text(F.col("rel"), F.col("content"), F.col("size"), F.col("modality")).alias("said"),
            "content_hash",
            blobs.object_uri(F.col("content_hash"), bucket).alias("object_uri"),
            files.file_extra(F.col("rel"), F.col("size"), F.col("modality"), streamed=F.lit(True)).alias("extra"),
        )
    )


def _firsts(rows: pa.Table) -> pa.Table:
    """The first row of each event by time and path."""
    order = pc.sort_indices(rows, [(c, "ascending") for c in ("event", "ts", "abspath")], null_placement="at_start")
    rows = rows.take(order).combine_chunks()
    names = rows.column("event")
    opens = pc.not_equal(names.slice(1), names.slice(0, max(len(names) - 1, 0)))
    return rows.filter(pa.chunked_array([pa.array([True] * min(len(names), 1), pa.bool_()), *opens.chunks]))


def _firsts_of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _firsts(pa.Table.from_batches([batch])).combine_chunks().to_batches()


def without_repeats(events: DataFrame, horizon: str = "1 hour") -> DataFrame:
    """A stream's decoded events without those that repeat an id (or a poison text) within ``horizon`` of arrival.

    The first of a micro-batch is its earliest; parts are reduced before they are exchanged. Time is that of
    arrival, so no event is too late to count.
    """
    named = events.withColumn("event", F.coalesce("id", F.concat(F.lit("poison:"), F.sha2(F.coalesce("raw", F.lit("")), 256))))
    schema = named.schema.simpleString().removeprefix("struct<").removesuffix(">")
    firsts = named.mapInArrow(_firsts_of_part, schema).groupBy("event").applyInArrow(_firsts, schema)
    arrived = firsts.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", horizon)
    return arrived.dropDuplicatesWithinWatermark(["event"]).drop("event", "arrived")


def start(
    raw: DataFrame,
    lake: Lake,
    folder_path: str,
    to_artifacts: Callable[[DataFrame], DataFrame] | None = None,
    make_encoder: Callable[[], vectors.Encoder] | None = None,
    embed: bool = True,
    column: str = "value",
    horizon: str = "1 hour",
    **trigger,
) -> StreamingQuery:
    """Append the files of a stream of JSON events to the lake with their bytes, and embed them.

    Events that repeat within ``horizon`` are dropped first. Each micro-batch is a batch of the lake, named after the query's folder and its epoch. What it
    adds is decided by ids, so a repeated micro-batch adds what the first try did not. Ids already
    stored are ignored whatever their content. Poison events go to ``<folder>/poison``.
    ``to_artifacts`` replaces reading the files, and then no bytes are stored.
    """
    events = without_repeats(decode(raw, column), horizon)
    writer = hashlib.sha256(folder_path.encode()).hexdigest()[:16]

    def step(batch: DataFrame, epoch: int) -> None:
        name = f"{writer}-{epoch}"
        poison(batch).write.mode("overwrite").text(f"{folder_path}/poison/epoch={epoch}")
        fresh = not_yet_in(usable(batch), lake.existing_ids(), ["id"])
        if to_artifacts is None:
            read = materialize(event_files(fresh), "event-files")
            put = blobs.put(read.select(F.col("content").alias("bytes"), F.col("rel").alias("filename")), lake.blobs(), "work")
            lake.append_blobs(put, name)
            made = event_artifacts(read)
        else:
            made = to_artifacts(fresh)
        lake.append_artifacts(made, name)
        if embed:
            lake.append_vectors(vectors.embed_new(lake.appended(name), lake.vectors(), make_encoder), name)

    return (
        events.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{folder_path}/checkpoint")
        .trigger(**(trigger or {"processingTime": "2 seconds"}))
        .start()
    )
