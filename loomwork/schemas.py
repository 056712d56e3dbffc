"""Declared schemas of the silver and gold tables, and the enums they allow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The enums of the stored model.
ARTIFACT_KINDS = ("file", "commit", "ai_session", "ai_message")
ARTIFACT_SOURCES = ("git", "claude_code")
EDGE_RELATIONS = (
    "authored",
    "modified",
    "co_edited",
    "ai_touched_file",
    "message_of_session",
)


def _struct(*fields: tuple[str, T.DataType], required: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([T.StructField(n, t, n not in required) for n, t in fields])


_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()

ARTIFACTS = _struct(
    ("id", _S), ("kind", _S), ("source", _S), ("repo", _S), ("actor", _S),
    ("created_at", _TS), ("title", _S), ("text", _S), ("content_hash", _S),
    ("object_uri", _S), ("extra", _S),
    required=("id", "kind", "source", "created_at"),
)

EDGES = _struct(
    ("src_id", _S), ("dst_id", _S), ("relation", _S), ("weight", _D), ("created_at", _TS),
    required=("src_id", "dst_id", "relation"),
)

BLOBS = _struct(
    ("content_hash", _S), ("object_uri", _S), ("filename", _S), ("size", _L), ("bytes", T.BinaryType()),
    required=("content_hash", "object_uri"),
)

VECTORS = _struct(
    ("id", _S), ("vector", T.ArrayType(T.FloatType())), ("kind", _S), ("source", _S),
    ("repo", _S), ("actor", _S), ("title", _S), ("text", _S), ("object_uri", _S),
    ("created_at", _S),
)

GRAPH_NODES = _struct(
    ("id", _S), ("label", _S), ("kind", _S), ("modality", _S),
    ("artifact_count", _L),
)

GRAPH_MEMBERS = _struct(("node", _S), ("artifact", _S))

GRAPH_EDGES = _struct(
    ("id", _S), ("source", _S), ("target", _S), ("relation", _S), ("weight", _D),
)

GOLD = {
    "gold_daily_activity": _struct(("day", _S), ("source", _S), ("kind", _S), ("count", _L)),
    "gold_file_hotspots": _struct(
        ("file_id", _S), ("repo", _S), ("path", _S), ("modality", _S),
        ("times_modified", _L), ("ai_touches", _L), ("coedit_degree", _L),
    ),
    "gold_author_activity": _struct(
        ("person_id", _S), ("name", _S), ("commits", _L), ("ai_sessions", _L),
        ("files_touched", _L), ("first_activity", _S), ("last_activity", _S),
    ),
    "gold_topic_summary": _struct(
        ("topic", _S), ("n_artifacts", _L), ("n_people", _L), ("n_files", _L), ("n_sessions", _L),
    ),
    "gold_cross_silo": _struct(
        ("person_a", _S), ("person_a_name", _S), ("person_b", _S), ("person_b_name", _S),
        ("shared_topics", _L), ("topics", _S),
    ),
}

# Append-only tables from which marts and weights are kept up to date.
FACTS = {
    "touches": _struct(("commit_id", _S), ("file_id", _S), ("created_at", _TS)),
    "file_facts": _struct(("file_id", _S), ("relation", _S), ("other", _S), ("sign", T.IntegerType())),
    "author_facts": _struct(("person_id", _S), ("dst_id", _S), ("kind", _S), ("created_at", _TS)),
    "author_files": _struct(("person_id", _S), ("file_id", _S)),
    "author_names": _struct(("person_id", _S), ("actor", _S), ("at", _TS)),
    "mart_batches": _struct(("stored", _S), ("applied", _S)),
}

METRICS = _struct(("batch_id", _S), ("asset", _S), ("metric", _S), ("value", _L))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto a declared schema: order, cast, and NULL for absent columns."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A frame with the declared types and no rows; the limit tells the optimizer, so that joins with it are not run."""
    return spark.createDataFrame([], schema).limit(0)
