"""Folder source: every file below a root as a row, with its bytes.

Spark's own file listing leaves out names that start with '_' or '.', which work folders are
full of (``__init__.py``, ``.env``), and would read ignored trees before they could be
filtered. So directories are listed inside tasks, and bytes are read only for kept files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import files, ids
from loomwork.functions.files import IGNORE_DIRS
from loomwork.operators import blobs, silver
from loomwork.operators.incremental import not_yet_in
from loomwork.session import materialize

ENTRY = "abspath string, size long, mtime timestamp, is_dir boolean"
# Bytes one task reads.
TASK_BYTES = 128 * 1024 * 1024


class FolderError(ValueError):
    """The path is not a usable directory."""


def _pruned(name: str) -> bool:
    return name in IGNORE_DIRS or name.startswith(".")


def _local(root: str) -> str:
    return root if "://" in root else f"file://{root}"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """abspath, rel, size, mtime of all files outside ignored directories.

    One round per level of the tree: tasks list the directories found in the round before. What
    they find is written to the shared folder, so neither files nor directories pass through the
    driver, and a deep branch is spread like any other.
    """
    filesystem, base = pafs.FileSystem.from_uri(_local(root))
    base = base.rstrip("/")
    if filesystem.get_file_info(base).type != pafs.FileType.Directory:
        raise FolderError(f"{root!r} is not a directory")

    def list_level(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = filesystem_of(root)
        for frame in frames:
            for directory in frame["abspath"]:
                try:
                    found = source.get_file_info(pafs.FileSelector(directory))
                except FileNotFoundError:  # gone meanwhile; any other error fails the listing
                    continue
                rows = [
                    (e.path, e.size, e.mtime, e.type == pafs.FileType.Directory)
                    for e in found
                    if e.type == pafs.FileType.File
                    or (e.type == pafs.FileType.Directory and not _pruned(e.base_name))
                ]
                if rows:
                    yield pd.DataFrame(rows, columns=["abspath", "size", "mtime", "is_dir"])

    slots = spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([(base,)], "abspath string")
    n_dirs, levels = 1, None
    while n_dirs:
        spread = frontier.repartition(min(n_dirs, slots), "abspath")
        found = materialize(spread.mapInPandas(list_level, ENTRY), "listing")
        levels = found if levels is None else levels.unionByName(found)
        frontier = found.filter("is_dir").select("abspath")
        n_dirs = frontier.count()
    return levels.filter("NOT is_dir").select(
        "abspath", F.expr(f"substring(abspath, {len(base) + 2})").alias("rel"), "size", "mtime"
    )


def filesystem_of(root: str) -> pafs.FileSystem:
    return pafs.FileSystem.from_uri(_local(root))[0]


def accepted(listed: DataFrame) -> DataFrame:
    """Files with an ingested extension and a size in bounds."""
    return listed.filter(~files.is_ignored(F.col("rel")) & files.size_in_bounds(F.col("size")))


def skipped(listed: DataFrame) -> DataFrame:
    """How many listed files the extension and size rules leave out."""
    out = files.is_ignored(F.col("rel")) | ~files.size_in_bounds(F.col("size"))
    return listed.agg(F.count_if(out).alias("skipped_ignored"))


def with_bytes(listed: DataFrame, root: str, total_bytes: int = 0) -> DataFrame:
    """Adds ``content``; files that are gone meanwhile are left out, any other error fails the read.

    A listing is small however much it names, so the number of reading tasks is set from the
    bytes behind it and not left to the size of the rows.
    """
    names = listed.columns
    slots = listed.sparkSession.sparkContext.defaultParallelism
    tasks = max(slots, -(-total_bytes // TASK_BYTES))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem = filesystem_of(root)
        for frame in frames:
            for rows in (frame.iloc[i : i + 16] for i in range(0, len(frame), 16)):
                content: list[bytes | None] = []
                for path in rows["abspath"]:
                    try:
                        with filesystem.open_input_stream(path) as stream:
                            content.append(stream.read())
                    except FileNotFoundError:
                        content.append(None)
                yield rows.assign(content=content)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema)
    spread = listed.repartition(tasks, "abspath")
    return spread.mapInPandas(read, f"{fields}, content binary").filter("content IS NOT NULL").select(
        *names, "content"
    )


def describe(read: DataFrame, repo: str, bucket: str, **extra) -> DataFrame:
    """File artifacts of read files: rel, content, mtime. ``extra`` adds to the JSON."""
    size = F.octet_length("content").cast("long")
    rows = (
        read.withColumn("size", size)
        .withColumn("modality", files.classify(F.col("rel"), F.col("content")))
        .withColumn("content_hash", F.sha2("content", 256))
    )
    return silver.file_artifacts(
        rows.select(
            F.lit(repo).alias("repo"),
            F.col("rel").alias("path"),
            F.col("mtime").alias("created_at"),
            files.file_text(F.col("rel"), F.col("content"), F.col("size"), F.col("modality")).alias("said"),
            "content_hash",
            blobs.object_uri(F.col("content_hash"), bucket).alias("object_uri"),
            files.file_extra(F.col("rel"), F.col("size"), F.col("modality"), **extra).alias("extra"),
        )
    )


def new_files(listed: DataFrame, existing: DataFrame, repo: str, max_files: int | None = None) -> DataFrame:
    """Accepted files whose artifact is not stored yet; with a bound, the first by path."""
    rows = accepted(listed).withColumn("id", ids.file_id(F.lit(repo), F.col("rel")))
    fresh = not_yet_in(rows, existing, ["id"]).drop("id")
    return fresh if max_files is None else fresh.orderBy("rel").limit(max_files)


def folder_index(listed: DataFrame, repo: str) -> DataFrame:
    """Absolute path -> file id of all accepted files."""
    return accepted(listed).select("abspath", ids.file_id(F.lit(repo), F.col("rel")).alias("file_id"))
