"""The stored tables: silver by append, gold by overwrite, and lookups on them.

A silver table is a Parquet folder, artifacts partitioned by month and edges by relation. Every row
names the batch that appended it and when. Batches have ids of their own, so writers cannot collide,
and an append is one job that becomes visible as a whole or not at all. What is new is decided by
keys, so a repeated append adds nothing. Two writers that add the same id at the same time both
succeed; the check after each append notes which of the rows came later, and readers leave it out.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork import schemas
from loomwork.functions import ids
from loomwork.operators import history, incremental, quality
from loomwork.session import materialize, shuffles_dropped

_BATCH = T.StructField("batch_id", T.StringType())
_AT = T.StructField("appended_at", T.TimestampType())
_MONTH = T.StructField("created_month", T.StringType())
LATER = T.StructType([T.StructField("id", T.StringType()), _BATCH])
# Marts that are kept up to date by key: their files are parted by a bucket of the key.
KEYED_MARTS, BUCKETS = {"gold_file_hotspots": "file_id", "gold_author_activity": "person_id"}, 64
# Columns by which rows are looked up: Bloom filters and the order within files let a reader skip files and row groups.
LOOKED_UP = {"artifacts": ["id"], "vectors": ["id"], "blobs": ["object_uri"]}
ENDS = ("src_id", "dst_id")
# The order of appends; ties are broken by the batch.
VERSION = ["appended_at", "batch_id"]


def with_month(artifacts: DataFrame) -> DataFrame:
    """Adds the partition column ``created_month``."""
    return artifacts.withColumn("created_month", F.date_format("created_at", "yyyy-MM"))


def partition_counts(artifacts: DataFrame) -> DataFrame:
    """Rows per month partition."""
    return with_month(artifacts).groupBy("created_month").agg(F.count("*").alias("n"))


def scan_artifacts(artifacts: DataFrame, kind: str | None = None) -> DataFrame:
    return artifacts if kind is None else artifacts.filter(F.col("kind") == kind)


def scan_edges(edges: DataFrame, relation: str | None = None) -> DataFrame:
    return edges if relation is None else edges.filter(F.col("relation") == relation)


def lookup(artifacts: DataFrame, wanted: DataFrame | Sequence[str]) -> DataFrame:
    """Artifacts by id: a short list becomes a pushed-down IN, a frame a semi join."""
    if isinstance(wanted, DataFrame):
        return artifacts.join(wanted.select("id"), "id", "left_semi")
    return artifacts.filter(F.col("id").isin(*wanted)) if wanted else artifacts.limit(0)


def detail(artifacts: DataFrame) -> DataFrame:
    """The detail page of artifacts: ISO time, and a raw URL only where bytes are stored."""
    has_blob = F.coalesce("object_uri", F.lit("")) != ""
    return artifacts.withColumn(
        "created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    ).select(
        *artifacts.columns,
        has_blob.alias("has_blob"),
        F.when(has_blob, F.concat(F.lit("/artifact/"), "id", F.lit("/raw"))).alias("raw_url"),
    )


class Lake:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.metrics: list[tuple[str, str, str, int]] = []

    # --- reading ---

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        """A table with its declared schema; one that was never written is empty."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return schemas.empty(self.spark, schema)

    def _rows(self, table: str, schema: T.StructType, as_of: str | None = None) -> DataFrame:
        rows = self.read(table, T.StructType([*schema.fields, _BATCH, _AT]))
        return rows if as_of is None else history.as_of(rows, F.col("appended_at"), as_of)

    def _stored_artifacts(self, as_of: str | None = None) -> DataFrame:
        rows = self._rows("artifacts", T.StructType([*schemas.ARTIFACTS.fields, _MONTH]), as_of)
        return rows.join(self.read("artifacts_later", LATER), ["id", "batch_id"], "left_anti")

    def artifacts(self, as_of: str | None = None, mode: str = "first", since: str | None = None) -> DataFrame:
        """Artifacts, as of a time of appending, or created ``since`` a day; older months are not read."""
        rows = self._stored_artifacts(as_of)
        if since is not None:
            rows = rows.filter((F.col("created_month") >= since[:7]) & (F.col("created_at") >= F.lit(since).cast("timestamp")))
        if mode == "latest":
            rows = incremental.latest_artifacts(rows, F.desc("appended_at"), F.desc("batch_id"))
        return rows.select(*schemas.ARTIFACTS.names)

    def _stored_edges(self, as_of: str | None = None) -> DataFrame:
        return self._rows("edges", schemas.EDGES, as_of)

    def appended(self, batch_id: str) -> DataFrame:
        """The artifacts one batch added; files of other batches are skipped by their statistics."""
        rows = self._stored_artifacts().filter(F.col("batch_id") == batch_id)
        return rows.select(*schemas.ARTIFACTS.names)

    def edges(self, as_of: str | None = None) -> DataFrame:
        """One edge per key; a negative weight takes an edge back."""
        rows = incremental.current_edges(ids.pack(self._stored_edges(as_of), *ENDS), F.struct(*VERSION))
        left = rows.filter(F.coalesce(F.col("weight") >= 0, F.lit(True)))
        return ids.unpack(left, *ENDS).select(*schemas.EDGES.names)

    def unapplied(self, table: str) -> DataFrame:
        """Stored rows of the appends that the keyed marts have not taken in yet."""
        rows = {"artifacts": self._stored_artifacts, "edges": self._stored_edges}[table]()
        done = self.facts("mart_batches").filter(F.col("stored") == table).select(F.col("applied").alias("batch_id"))
        return rows.join(done, "batch_id", "left_anti")

    def vectors(self) -> DataFrame:
        return self._rows("vectors", schemas.VECTORS).select(*schemas.VECTORS.names)

    def quarantine(self) -> DataFrame:
        """Rows that were set apart: those of artifacts, the reason, the batch and its time."""
        loose = [T.StructField(f.name, f.dataType) for f in schemas.ARTIFACTS]
        return self._rows("quarantine", T.StructType([*loose, T.StructField("reason", T.StringType())]))

    def blobs(self) -> DataFrame:
        return self._rows("blobs", schemas.BLOBS).select(*schemas.BLOBS.names)

    def gold(self, name: str) -> DataFrame:
        return self.read(name, schemas.GOLD[name]).select(*schemas.GOLD[name].names)

    def facts(self, name: str) -> DataFrame:
        """An append-only table behind the marts."""
        return self._rows(name, schemas.FACTS[name])

    def existing_ids(self) -> DataFrame:
        """Only the id column is read."""
        return self._stored_artifacts().select("id").distinct()

    def get_artifact(self, artifact_id: str) -> DataFrame:
        return lookup(self.artifacts(), [artifact_id])

    def log(self, table: str) -> DataFrame:
        """batch_id, committed_at, added: one row for each append that added rows."""
        stored = {"artifacts": self._stored_artifacts, "edges": self._stored_edges}[table]()
        return history.log_from_rows(stored, F.col("batch_id"), F.col("appended_at"))

    def snapshots(self, table: str = "artifacts") -> DataFrame:
        return history.snapshots(self.log(table))

    # --- writing ---

    def new_batch(self) -> str:
        """An id no other writer has."""
        return uuid.uuid4().hex

    def _append(
        self, table: str, rows: DataFrame, batch_id: str, by: list[str], at: datetime | None = None, dealt: bool = False
    ) -> int:
        """Append rows in one job, which also counts them; the counts stay for ``note_metrics``.

        ``dealt``: the rows come out of a shuffle by their key, which leaves even tasks, and ``by`` has few values, so
        they are written as they stand.
        """
        when = F.lit(at or datetime.now(timezone.utc)).cast("timestamp")
        stamped = rows.withColumns({"batch_id": F.lit(batch_id), "appended_at": when})
        # Rebalancing gives each partition value few files, and splits a value that is large.
        spread = stamped if dealt else stamped.hint("rebalance", *[F.col(c) for c in by])
        looked_up = LOOKED_UP.get(table, [])
        if looked_up:  # in order, so that row groups are told apart by their least and greatest key
            spread = spread.sortWithinPartitions(*by, *looked_up)
        kinds = {"edges": ("relation", schemas.EDGE_RELATIONS), "artifacts": ("kind", schemas.ARTIFACT_KINDS)}.get(table)
        counts = {"rows": F.count(F.lit(1))}
        if kinds:
            counts |= {f"{kinds[0]}:{v}": F.count_if(F.col(kinds[0]) == v) for v in kinds[1]}
        seen = Observation()
        writer = spread.observe(seen, *[c.alias(n) for n, c in counts.items()]).write.mode("append")
        for column in looked_up:
            # Adaptive: a file of few rows gets a small filter.
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        with shuffles_dropped(self.spark):
            (writer.partitionBy(*by) if by else writer).parquet(f"{self.root}/{table}")
        found = seen.get
        self.metrics += [(batch_id, table, name, int(found.get(name, 0))) for name in counts]
        return int(found.get("rows", 0))

    def note_metrics(self) -> int:
        """Write what the appends since the last call have counted: batch_id, asset, metric, value."""
        noted, self.metrics = self.metrics, []
        if noted:
            self.spark.createDataFrame(noted, schemas.METRICS).coalesce(1).write.mode("append").parquet(f"{self.root}/run_metrics")
        return len(noted)

    def run_metrics(self) -> DataFrame:
        return self.read("run_metrics", schemas.METRICS)

    def _note_later(self, batch_id: str) -> int:
        """Of ids that several batches added at the same time, note the rows that came later."""
        stored = self._stored_artifacts().select("id", "batch_id", "appended_at").withColumn("tag", F.xxhash64("id"))
        mine = stored.filter(F.col("batch_id") == batch_id)
        # Only rows that share the hash of their id with another one are compared by their ids.
        near = stored.select("tag").join(mine.select("tag"), "tag", "left_semi").groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
        twice = materialize(near.filter("n > 1").select("tag"), "later-tags")
        if twice.isEmpty():
            return 0
        shared = stored.join(twice, "tag", "left_semi")
        shared = shared.join(mine.join(twice, "tag", "left_semi").select("id"), "id", "left_semi")
        first = shared.groupBy("id").agg(F.min(F.struct(*VERSION)).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        later = shared.join(first, "id").filter(F.struct(*VERSION) > F.col("first")).select("id", "batch_id")
        count = later.count()
        if count:
            later.write.mode("append").parquet(f"{self.root}/artifacts_later")
        return count

    def append_artifacts(self, batch: DataFrame, batch_id: str, mode: str = "first", at: datetime | None = None) -> int:
        """Append the artifacts that are new; returns how many were."""
        rows = incremental.new_artifacts(schemas.conform(batch, schemas.ARTIFACTS), self._stored_artifacts(), mode)
        added = self._append("artifacts", with_month(rows), batch_id, ["created_month"], at)
        return added - self._note_later(batch_id) if mode == "first" and added else added

    def append_checked(self, batch: DataFrame, batch_id: str, at: datetime | None = None) -> int:
        """Append the artifacts that the model allows; the others go to ``quarantine`` with the reason."""
        told = materialize(quality.reasons(schemas.conform(batch, schemas.ARTIFACTS)), "checked")
        self._append("quarantine", told.filter("reason IS NOT NULL"), batch_id, [], at)
        return self.append_artifacts(told.filter("reason IS NULL").drop("reason"), batch_id, at=at)

    def append_edges(self, batch: DataFrame, batch_id: str) -> int:
        """Append the edges that are new or changed their weight; returns how many did."""
        rows, stored = (
            ids.pack(e, *ENDS).withColumn("relation", F.coalesce("relation", F.lit("")))
            for e in (schemas.conform(batch, schemas.EDGES), self._stored_edges())
        )
        changed = ids.unpack(incremental.edges_to_append(stored, rows, F.struct(*VERSION)), *ENDS)
        return self._append("edges", changed, batch_id, ["relation"], dealt=True)

    def append_vectors(self, rows: DataFrame, batch_id: str) -> int:
        return self._append("vectors", schemas.conform(rows, schemas.VECTORS), batch_id, [])

    def append_blobs(self, rows: DataFrame, batch_id: str) -> int:
        return self._append("blobs", schemas.conform(rows, schemas.BLOBS), batch_id, [])

    def overwrite(self, name: str, rows: DataFrame, schema: T.StructType) -> DataFrame:
        """Recompute a derived table: full overwrite, then read back."""
        writer = schemas.conform(rows, schema).write.mode("overwrite").option("partitionOverwriteMode", "static")
        with shuffles_dropped(self.spark):
            writer.parquet(f"{self.root}/{name}")
        return self.read(name, schema)

    def append_facts(self, name: str, rows: DataFrame, batch_id: str) -> int:
        return self._append(name, schemas.conform(rows, schemas.FACTS[name]), batch_id, [], dealt=True)

    def overwrite_gold(self, name: str, rows: DataFrame) -> DataFrame:
        if name not in KEYED_MARTS:
            return self.overwrite(name, rows, schemas.GOLD[name])
        self._write_keyed(name, schemas.conform(rows, schemas.GOLD[name]).withColumn("bucket", self._bucket(name)), "static")
        return self.gold(name)

    @staticmethod
    def _bucket(name: str) -> Column:
        return F.pmod(F.xxhash64(KEYED_MARTS[name]), F.lit(BUCKETS)).cast("int")

    def _write_keyed(self, name: str, rows: DataFrame, mode: str) -> None:
        writer = rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", mode)
        with shuffles_dropped(self.spark):
            writer.partitionBy("bucket").parquet(f"{self.root}/{name}")

    def publish(self, name: str, rows: DataFrame) -> int:
        """Replace the rows of the given keys of a keyed mart; files of buckets without such a key are left alone."""
        key = KEYED_MARTS[name]
        fresh = materialize(schemas.conform(rows, schemas.GOLD[name]).withColumn("bucket", self._bucket(name)), "mart-rows")
        stored = self.read(name, T.StructType([*schemas.GOLD[name].fields, T.StructField("bucket", T.IntegerType())]))
        near = stored.join(fresh.select("bucket").distinct(), "bucket", "left_semi")
        others = near.join(fresh.select(key), key, "left_anti").select(*fresh.columns)
        self._write_keyed(name, materialize(others.unionByName(fresh), "mart-rows"), "dynamic")
        return fresh.count()
