"""Content-addressed bytes: one row per distinct content, found by its digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.incremental import not_yet_in, one_per_key

BLOB_PREFIX = "blobs"


def object_uri(content_hash: Column, bucket: str) -> Column:
    return F.concat(F.lit(f"s3://{bucket}/{BLOB_PREFIX}/"), content_hash)


def encoded_name(filename: Column) -> Column:
    """Percent-encoded file name; '/', '.', '_' and '-' stay as they are."""
    form = F.url_encode(filename)
    for have, want in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        form = F.replace(form, F.lit(have), F.lit(want))
    return form


def put(files: DataFrame, stored: DataFrame, bucket: str) -> DataFrame:
    """Blob rows to write: contents not stored yet, once each, under the smallest name.

    ``files``: bytes, filename. The winning file of a content is found on hash and name alone; only
    the bytes of winners are exchanged, and of equal winners one.
    """
    hashed = files.select(F.sha2("bytes", 256).alias("content_hash"), "filename", "bytes")
    names = hashed.groupBy("content_hash").agg(F.min("filename").alias("filename"))
    fresh = not_yet_in(names, stored, ["content_hash"])
    winners = hashed.join(fresh, ["content_hash", "filename"], "left_semi")
    rows = one_per_key(winners, ["content_hash"], ["filename"])
    return rows.select(
        "content_hash",
        object_uri(F.col("content_hash"), bucket).alias("object_uri"),
        encoded_name(F.col("filename")).alias("filename"),
        F.octet_length("bytes").cast("long").alias("size"),
        "bytes",
    )


def resolve(artifacts: DataFrame, blobs: DataFrame) -> DataFrame:
    """id, content_hash, size of the bytes behind each artifact that has any."""
    stored = blobs.select("object_uri", "size")
    return artifacts.filter(F.col("object_uri").isNotNull()).select("id", "object_uri").join(
        stored, "object_uri"
    )


def fetch(blobs: DataFrame, uri: str) -> DataFrame:
    """The row of one URI; a malformed URI is an error."""
    bucket, _, key = uri.removeprefix("s3://").partition("/")
    if not uri.startswith("s3://") or not bucket or not key:
        raise ValueError(f"not an s3://bucket/key URI: {uri!r}")
    return blobs.filter(F.col("object_uri") == uri)


def exists(blobs: DataFrame, uri: str) -> bool:
    return fetch(blobs.select("object_uri"), uri).limit(1).count() > 0
